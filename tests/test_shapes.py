"""Distances and polygons on grids, against every cell and every edge."""

import json
import random
from fractions import Fraction

import pytest

from tidemark.operators import distance, rasterise
from tidemark.sources import vectors

CELLS = "aoi_id int, y int, x int"


def near(cells, reach):
    k = int(reach) + 1
    disc = [(dy, dx) for dy in range(-k, k + 1) for dx in range(-k, k + 1) if dy * dy + dx * dx <= reach * reach + 1e-9]
    return disc, {(y + dy, x + dx) for y, x in cells for dy, dx in disc}


@pytest.mark.parametrize("close_m,buffer_m,cell_m", [(60.0, 90.0, 30.0), (150.0, 0.0, 40.0), (0.0, 100.0, 30.0), (20.0, 20.0, 30.0)])
def test_wet_areas_by_all_distances(spark, close_m, buffer_m, cell_m):
    rng = random.Random(6)
    areas = {a: {(rng.randrange(25), rng.randrange(25)) for _ in range(n)} for a, n in ((1, 3), (2, 60), (3, 300))}
    rows = [(a, y, x) for a, own in areas.items() for y, x in own]
    got = distance.wet_area(spark.createDataFrame(rows + rows[:5], CELLS).repartition(3), cell_m=cell_m, close_m=close_m, buffer_m=buffer_m).collect()
    assert len(got) == len(set(got))
    for a, own in areas.items():
        disc, grown = near(own, close_m / cell_m)
        shut = {(y, x) for y, x in grown if all((y + dy, x + dx) in grown for dy, dx in disc)}
        assert own <= shut
        assert {(r.y, r.x) for r in got if r.aoi_id == a} == near(shut, buffer_m / cell_m)[1]


def test_wet_areas_without_cells_and_with_bad_distances(spark):
    empty = spark.createDataFrame([], CELLS)
    assert not distance.wet_area(empty).collect()
    with pytest.raises(ValueError):
        distance.wet_area(empty, cell_m=0)


def touched(rings, height, width):
    """Cells by exact fractions: the centre's parity, or an edge that passes through the open square."""
    edges = []
    for ring in rings:
        p = [(Fraction(x), Fraction(y)) for x, y in ring]
        edges += [(a, b) for a, b in zip(p, p[1:] + p[:1], strict=True) if a != b]
    out = set()
    for r in range(height):
        for c in range(width):
            cx, cy = c + Fraction(1, 2), r + Fraction(1, 2)
            parity = sum(min(a[1], b[1]) <= cy < max(a[1], b[1]) and a[0] + (cy - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) <= cx for a, b in edges) % 2
            through = False
            for a, b in edges:
                low, high = Fraction(0), Fraction(1)
                for k, at in ((0, c), (1, r)):
                    d = b[k] - a[k]
                    if d:
                        s, t = sorted(((at - a[k]) / d, (at + 1 - a[k]) / d))
                        low, high = max(low, s), min(high, t)
                    elif not at < a[k] < at + 1:
                        high = Fraction(-1)
                through |= low < high
            if parity or through:
                out.add((r, c))
    return out


def test_polygons_by_every_cell_and_edge(spark):
    rng = random.Random(12)
    grid = (0.0, 0.0, 1.0, 1.0, 14, 16)
    shapes = {
        1: [[(2, 2), (6, 2), (6, 5), (2, 5)]],  # on the grid's lines: no more than its own cells
        2: [[(1.5, 1.5), (12.25, 3.5), (9.75, 12.5), (3.25, 10.5), (1.5, 1.5)], [(5, 5), (8, 5), (8, 8), (5, 8)]],
        3: [[(0.25, 0.5), (15.5, 0.75), (0.25, 1.0)]],
        4: [[(-5.5, -4.25), (30.5, 6.5), (-3.25, 40.5)]],
        5: [[(3.5, 3.5), (3.5, 3.5)], [(9.0, 1.0), (9.0, 7.0)], [(4.5, 9.5), (7.5, 9.5)]],
        6: [[(20.0, 20.0), (22.0, 20.0), (21.0, 25.0)]],
    }
    for a in range(7, 27):
        n = rng.randrange(3, 9)
        shapes[a] = [[(8 + rng.choice([0.25, 0.5, 1]) * rng.randrange(-9, 10), 7 + rng.choice([0.25, 0.5, 1]) * rng.randrange(-9, 10)) for _ in range(n)] for _ in range(rng.choice([1, 1, 2]))]
    rings = spark.createDataFrame([(a, [(float(x), float(y)) for x, y in ring]) for a, own in shapes.items() for ring in own] + [(99, [(1.0, 1.0), (3.0, 1.0), (2.0, 3.0)])], "aoi_id int, points array<struct<x:double,y:double>>")
    grids = spark.createDataFrame([(a, *grid) for a in shapes], "aoi_id int, x0 double, y0 double, dx double, dy double, height int, width int")
    got = rasterise.cells_touched(rings.repartition(3), grids).collect()
    assert len(got) == len(set(got))
    for a, own in shapes.items():
        assert {(r.y, r.x) for r in got if r.aoi_id == a} == touched(own, 14, 16), a
    assert {r.aoi_id for r in got} <= set(shapes) - {6}


def test_grids_downwards_and_in_metres(spark):
    rings = spark.createDataFrame([(1, [(1000.0, 5000.0), (1090.0, 5000.0), (1090.0, 4955.0), (1000.0, 4955.0)])], "aoi_id int, points array<struct<x:double,y:double>>")
    grids = spark.createDataFrame([(1, 970.0, 5030.0, 30.0, -30.0, 10, 10)], "aoi_id int, x0 double, y0 double, dx double, dy double, height int, width int")
    assert {(r.y, r.x) for r in rasterise.cells_touched(rings, grids).collect()} == {(y, x) for y in (1, 2) for x in (1, 2, 3)}


def test_geojson_and_what_is_wrong_with_it(spark, tmp_path):
    def feature(name, kind, coordinates):
        return {"type": "Feature", "properties": {"name": name, "n": 3}, "geometry": kind and {"type": kind, "coordinates": coordinates}}

    square = [[0, 0], [4, 0], [4, 4], [0, 4], [0, 0]]
    hole = [[1, 1], [2, 1], [2, 2], [1, 2], [1, 1]]
    doc = {"type": "FeatureCollection", "features": [
        feature("plain", "Polygon", [square, hole]), feature("many", "MultiPolygon", [[square], [[[9, 9], [10, 9], [9, 10.5], [9, 9]]]]), feature("none", None, None), feature("point", "Point", [1, 2]),
        feature("bow", "Polygon", [[[0, 0], [4, 4], [4, 0], [0, 4], [0, 0]]]), feature("open", "Polygon", [square[:-1]]), feature("short", "Polygon", [[[0, 0], [1, 1], [0, 0]]]), feature("empty", "Polygon", []), feature("text", "Polygon", [[[0, 0], [4, None], [4, 4], [0, 0]]]),
    ]}
    (tmp_path / "areas.geojson").write_text(json.dumps(doc, indent=1))
    (tmp_path / "one.geojson").write_text(json.dumps(feature(None, "Polygon", [square])))
    rings = vectors.read_geojson(spark, str(tmp_path)).cache()
    by = {(r.area, r.part, r.ring): [(p.x, p.y) for p in r.points or []] for r in rings.collect()}
    assert by["plain", 0, 0] == [(float(x), float(y)) for x, y in square] and by["plain", 0, 1][2] == (2.0, 2.0)
    assert by["many", 1, 0][2] == (9.0, 10.5) and any(a.endswith("one.geojson#0") for a, _, _ in by)
    errors = {(r.area, r.error) for r in vectors.area_errors(rings, bands=8).collect()}
    assert errors == {("none", "null or empty geometry"), ("point", "null or empty geometry"), ("empty", "null or empty geometry"), ("bow", "edges that cross"), ("open", "a ring that does not close"), ("short", "a ring of fewer than four points"), ("text", "places that are not numbers")}
