"""Tile plans against every tile counted, pruned scans, and masks that grow by years."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history, tiles

CELLS = "aoi_id int, y int, x int"


def plan_by_hand(cells, shape, sizes, overhead, least):
    h, w = shape
    scored = [((h * w + overhead), 0, 0, None, 1, h * w)]
    for t in sizes:
        own = {(y // t, x // t) for y, x in cells}
        px = sum((min((a + 1) * t, h) - a * t) * (min((b + 1) * t, w) - b * t) for a, b in own)
        scored.append((px + overhead * len(own), 1, -t, t, len(own), px))
    best, whole = min(scored, key=lambda s: s[:3]), scored[0]
    return best[3:] if best[3] and (whole[0] - best[0]) / whole[0] >= least else whole[3:]


def test_plans(spark):
    rng = random.Random(1)
    areas = {a: ({(rng.randrange(h), rng.randrange(w)) for _ in range(n)}, (h, w)) for a, (n, h, w) in enumerate([(3, 90, 70), (40, 90, 70), (2000, 64, 64), (1, 5, 5), (60, 200, 33)])}
    # a corner full of cells
    areas[9] = ({(y, x) for y in range(10) for x in range(12)}, (160, 160))
    cells = spark.createDataFrame([(a, y, x) for a, (own, _) in areas.items() for y, x in own], CELLS)
    shapes = spark.createDataFrame([(a, *shape) for a, (_, shape) in areas.items()] + [(77, 10, 10)], "aoi_id int, height int, width int")
    for sizes, overhead, least in (((48, 24, 12), 30.0, 0.15), ((32, 20), 0.0, 0.0), ((16,), 500.0, 0.5)):
        plan = tiles.plan_tiles(cells, shapes, candidates=sizes, tile_overhead=overhead, min_improvement=least)
        got = {r.aoi_id: (r.tile_pixels, r.n_tiles, r.intersecting_pixels) for r in plan.collect()}
        assert got == {a: plan_by_hand(own, shape, sizes, overhead, least) for a, (own, shape) in areas.items()}
        windows = tiles.planned_windows(plan, cells, shapes).collect()
        for a, (own, _) in areas.items():
            mine = [r for r in windows if r.aoi_id == a]
            assert sum((r.y1 - r.y0) * (r.x1 - r.x0) for r in mine) == got[a][2] and len(mine) == got[a][1]
            assert all(any(r.y0 <= y < r.y1 and r.x0 <= x < r.x1 for r in mine) for y, x in own)
    for bad in ({"pixel_cost": 0}, {"tile_overhead": -1}, {"min_improvement": 2}):
        with pytest.raises(ValueError):
            tiles.plan_tiles(cells, shapes, **bad)


def test_other_tiles_are_not_read(spark, tmp_path):
    path = f"file://{tmp_path}/pixels"
    tiles.write_tiles(spark.range(64 * 64).select(F.lit(1).alias("aoi_id"), F.expr("cast(id div 64 as int)").alias("y"), F.expr("cast(id % 64 as int)").alias("x"), F.lit(1).alias("code")), path, 8)
    cells = spark.createDataFrame([(1, 3, 3), (1, 20, 60), (2, 0, 30)], CELLS)
    scan = tiles.read_tiles(spark, path, cells, 8, skip=spark.createDataFrame([(1, 0, 0)], "aoi_id int, tile_y int, tile_x int"))
    rows = scan.collect()
    assert {(r.tile_y, r.tile_x) for r in rows} == {(2, 7)} and len(rows) == 64
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert tiles.read_tiles(spark, path, None, 8).count() == 64 * 64


MASK = "aoi_id int, month date, y int, x int, code int"


def mask(spark, years, seed=3):
    rng = random.Random(seed)
    rows = [(a, f"{yr}-{m:02d}-01", y, x, rng.choice([-1, 0, 0, 1])) for yr in range(1990, 2000) for a in (1, 2) for m in (1, 6) for y in range(3) for x in range(3)]
    return spark.createDataFrame([r for r in rows if int(r[1][:4]) in years], MASK.replace("month date", "month string")).withColumn("month", F.to_date("month"))


def test_versions_grow_by_new_years_only(spark, tmp_path):
    h = history.MaskHistory(spark, f"file://{tmp_path}/v")
    with pytest.raises(ValueError, match="offline"):
        h.resolve(history.yearly_counts(mask(spark, range(1990, 1993))), 1990, 1992, offline=True)
    every = history.yearly_counts(mask(spark, range(1990, 2000)))
    first, v = h.resolve(every, 1990, 1994)
    before = sorted(first.collect())
    assert v == (1990, 1994) and h.versions() == [v]
    # reaches far enough, or must not be built
    assert h.resolve(every.where("false"), 1990, 1993)[1] == v and h.resolve(every, 1990, 1999, offline=True)[1] == v
    # nothing new at hand: the old one stays
    assert h.resolve(every.where("yr < 1995"), 1990, 1999)[1] == v
    grown, w = h.resolve(every.where("yr > 1994"), 1990, 1999)
    assert w == (1990, 1999) and h.versions() == [v, w]
    assert sorted(grown.collect()) == sorted(history.summed(every.select("aoi_id", "y", "x", "count_wet", "count_clear")).collect())
    assert sorted(h.read(v).collect()) == before
    # a version without its mark of success isn't one
    (tmp_path / "v" / "years=1990-2050").mkdir()
    assert h.versions() == [v, w]


def test_gaps(spark):
    cases = [("1990-05-20", "1999-12-31", None, None), ("1990-05-01", "1995-01-01", None, None), ("1989-12-31", "1999-01-01", 5, None), ("1990-04-30", "2000-01-01", 1, 1), ("1991-01-01", "2002-03-31", None, 27), ("1980-05-01", "1990-01-01", 120, None)]
    rows = spark.createDataFrame(cases, "a string, b string, before int, after int")
    day = lambda c: F.to_date(F.lit(c) if c[0].isdigit() else F.col(c))
    for r in rows.select("before", "after", history.coverage_gap(day("a"), day("b"), day("1990-05-01"), day("1999-12-31")).alias("g")).collect():
        assert (r.g.before, r.g.after) == (r.before, r.after)
        assert (r.g.note is None) == (r.before is None and r.after is None) and ("first wet" in (r.g.note or "")) == (r.after is not None)


def test_sources_in_their_order_and_nothing_means_everything(spark):
    m = mask(spark, range(1990, 1994))
    counts, stats = history.yearly_counts(m), history.summed(history.yearly_counts(m).drop("yr"))
    given = spark.createDataFrame([(1, 5, 5)], CELLS)
    assert history.choose_wet_cells(given, counts, stats, years=(1990, 1993))[1] == "given"
    assert history.choose_wet_cells(None, counts, stats, years=(1990, 1993))[1] == "counts"
    assert history.choose_wet_cells(None, counts.where("NOT (aoi_id = 2 AND yr = 1991)"), stats, years=(1990, 1993))[1] == "statistics"
    dry = stats.withColumn("count_wet", F.lit(0).cast("long"))
    assert history.choose_wet_cells(None, counts, dry, years=(1990, 1996)) == (None, "none")
    area = spark.createDataFrame([(1, 0, 0), (1, 1, 1), (2, 9, 9)], CELLS)
    with pytest.raises(ValueError, match="area 2"):
        history.mask_of(stats, area)
    assert {r.aoi_id for r in history.mask_of(stats, area.where("aoi_id = 1")).collect()} == {1}
