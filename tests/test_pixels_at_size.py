"""Sets of cells are as large as a month's pixels: they reach no driver, and tiles of any size make few folders."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import pixels as px
from tidemark.operators import tiles

HEIGHT, WIDTH, AREAS = 8, 40, 3
MONTHS = [dt.date(2001, m, 1) for m in (1, 2)]


@pytest.fixture
def tables(spark, tmp_path):
    """(mask, cells): every third cell of a month is water; cells are exploded from a small file, as areas by key arithmetic are."""
    spark.range(HEIGHT * WIDTH).select(F.expr(f"cast(id div {WIDTH} as int)").alias("y"), F.expr(f"cast(id % {WIDTH} as int)").alias("x")).write.parquet(f"file://{tmp_path}/grid")
    grid = spark.read.parquet(f"file://{tmp_path}/grid")
    every = grid.withColumn("aoi_id", F.explode(F.sequence(F.lit(0), F.lit(AREAS - 1))))
    mask = every.withColumn("month", F.explode(F.array(*[F.lit(m) for m in MONTHS]))).withColumn("code", ((F.col("x") + F.col("y") + F.month("month")) % 3 == 0).cast("int"))
    mask.write.parquet(f"file://{tmp_path}/mask")
    return spark.read.parquet(f"file://{tmp_path}/mask"), every.where("(y + x + aoi_id) % 8 <> 0").select("aoi_id", "y", "x")


def inside(a, y, x):
    return (y + x + a) % 8 != 0


def code(m, y, x):
    return int((x + y + m.month) % 3 == 0)


def all_cells():
    return [(a, y, x) for a in range(AREAS) for y in range(HEIGHT) for x in range(WIDTH)]


def ran(df):
    """The rows, and the plan that they were made by."""
    rows = df.collect()
    return rows, df._jdf.queryExecution().executedPlan().toString()


OPERATORS = {
    "clip": (lambda m, c: px.monthly_reduction(px.clip(m, c)).select("aoi_id", "month", "n_water"), lambda a, m, y, x: inside(a, y, x) and code(m, y, x) == 1),
    "fill_inside": (lambda m, c: px.monthly_reduction(px.fill_inside(m.withColumn("code", F.when(F.col("code") == 0, -2).otherwise(1)), c)).select("aoi_id", "month", "n_invalid"), lambda a, m, y, x: inside(a, y, x) and code(m, y, x) == 0),
    "wet": (lambda m, c: px.monthly_reduction(m, wet=c).select("aoi_id", "month", "n_wet_aoi"), lambda a, m, y, x: inside(a, y, x)),
    "uncontained": (lambda m, c: px.uncontained(m, c), lambda a, m, y, x: not inside(a, y, x) and code(m, y, x) == 1),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_cells_are_not_broadcast(tables, name):
    run, counted = OPERATORS[name]
    rows, plan = ran(run(*tables))
    assert {tuple(r) for r in rows} == {(a, m, sum(counted(a, m, y, x) for b, y, x in all_cells() if b == a)) for a in range(AREAS) for m in MONTHS}
    assert "BroadcastExchange" not in plan


def test_areas_and_histories_are_not_broadcast(tables):
    mask, cells = tables
    wet = {(a, y, x) for a, y, x in all_cells() if any(code(m, y, x) for m in MONTHS)}
    for got in (px.historical_mask(px.statistics(mask), cells), px.union_inside([px.ever_wet(px.statistics(mask.where(F.col("month") == m))) for m in MONTHS], cells)):
        rows, plan = ran(got)
        assert {(r.aoi_id, r.y, r.x) for r in rows} == {c for c in wet if inside(*c)}
        assert len(rows) == len(set(rows)) and "BroadcastExchange" not in plan


def test_windows_of_cells_are_not_broadcast(tables):
    cells = tables[1]
    rows, plan = ran(px.tiles_in(px.active_windows(cells, 1), cells.where("x < 9"), 1))
    assert {tuple(r) for r in rows} == {(a, y, x) for a, y, x in all_cells() if inside(a, y, x) and x < 9}
    assert "BroadcastExchange" not in plan


def test_pixels_move_once(spark):
    """Mosaic, composite, statistics: one shuffle, by cell."""
    obs = spark.createDataFrame([(0, dt.date(2001, 1, 1), dt.datetime(2001, 1, d, 10), s, 1, 2, 3, raw) for d, s, raw in ((1, 5, 1), (1, 6, 128), (2, 7, 0), (3, 8, 128))], "aoi_id int, month date, obs_ts timestamp, scene_id long, part int, y int, x int, raw int")
    days = px.day_mosaic(obs).withColumn("code", px.decode(F.col("raw")))
    rows, plan = ran(px.statistics(px.monthly_composite(days)))
    assert [(r.count_wet, r.count_clear) for r in rows] == [(1, 1)]
    assert plan.split("== Initial Plan ==")[0].count("Exchange hashpartitioning") == 1


def test_small_tiles_share_folders(spark, tmp_path):
    """Tiles of 8 x 8 pixels, 260 of them: a folder for each 512 pixels, and only those of the wanted tiles are read."""
    path = f"{tmp_path}/pixels"
    grid = spark.range(16 * 1040).select(F.lit(1).alias("aoi_id"), F.expr("cast(id div 1040 as int)").alias("y"), F.expr("cast(id % 1040 as int)").alias("x"))
    tiles.write_tiles(grid, f"file://{path}", 8)
    folders = [d for d, _, files in os.walk(path) if any(f.startswith("part-") for f in files)]
    assert len(folders) == 3
    cells = spark.createDataFrame([(1, 3, 1), (1, 9, 1030), (1, 3, 700), (2, 3, 600)], "aoi_id int, y int, x int")
    got = tiles.read_tiles(spark, f"file://{path}", cells, 8, skip=spark.createDataFrame([(1, 0, 87)], "aoi_id int, tile_y int, tile_x int"))
    assert sorted(got.columns) == ["aoi_id", "tile_x", "tile_y", "x", "y"]
    assert {(r.y, r.x) for r in got.collect()} == {(y, x) for y in range(16) for x in range(1040) if (y // 8, x // 8) in ((0, 0), (1, 128))}
    assert sorted(tiles.read_tiles(spark, f"file://{path}", None, 8).columns) == ["aoi_id", "tile_x", "tile_y", "x", "y"]
