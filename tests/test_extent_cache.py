"""Counts that are built once, and again only where they were damaged."""

import datetime as dt
import os
import pathlib

import pytest
from pyspark.sql import functions as F

from tidemark.sources import extent_cache as ca


class Builder:
    """Counts made from area and month; remembers what it was asked for."""

    def __init__(self, plus=0, leave=()):
        self.asked, self.plus, self.leave = [], plus, set(leave)

    def __call__(self, pairs):
        got = sorted((r.aoi_id, r.yr) for r in pairs.collect())
        self.asked.append(got)
        rows = [(a, dt.date(y, m, 1), m + self.plus, 20, 80, 100) for a, y in got if (a, y) not in self.leave for m in range(1, 13)]
        return pairs.sparkSession.createDataFrame(rows, "aoi_id int, month date, n_water long, n_valid long, n_invalid long, n_aoi long")


def files(root, **parts):
    return [p for p in pathlib.Path(root).rglob("part-*.parquet") if all(f"/{k}={v}/" in str(p) for k, v in parts.items())]


def test_a_second_run_builds_nothing_and_damage_only_itself(spark, tmp_path):
    cache = ca.ExtentCache(spark, f"file://{tmp_path}", buckets=2)
    areas = spark.createDataFrame([(a,) for a in range(6)], "aoi_id int")
    wanted, build = ca.wanted_years(areas, "2001-01-05", "2003-12-31"), Builder()
    assert cache.load("r", wanted.where("yr < 2003"), build).count() == 6 * 24
    out = cache.load("r", wanted, build)
    assert build.asked == [[(a, y) for a in range(6) for y in (2001, 2002)], [(a, 2003) for a in range(6)]]
    assert out.count() == 6 * 36 and {(r.n_water, r.extent_pct, r.invalid_pct) for r in out.where("month = '2002-07-01'").collect()} == {(7, 35.0, 80.0)}
    assert cache.load("r", wanted, build).count() == 6 * 36 and len(build.asked) == 2

    # a file that can't be read: its bucket and year are built again, nothing else
    bucket = {r.aoi_id: r.b for r in areas.select("aoi_id", F.pmod(F.xxhash64("aoi_id"), F.lit(2)).alias("b")).collect()}
    (broken,) = files(tmp_path, yr=2002, bucket=1)
    broken.write_bytes(b"PAR1 not at all PAR1")
    for crc in broken.parent.glob(".*.crc"):
        os.remove(crc)
    assert cache.load("r", wanted, build).count() == 6 * 36
    assert build.asked[2:] == [[(a, 2002) for a in range(6) if bucket[a] == 1]]

    # numbers that were changed behind the cache's back: one area's year
    rows = cache._rows("r").where("yr = 2001 AND bucket = 0")
    victim = min(a for a in range(6) if bucket[a] == 0)
    rows = rows.withColumn("n_water", F.when((F.col("aoi_id") == victim) & (F.month("month") == 5), 6).otherwise(F.col("n_water")))
    spark.createDataFrame(rows.collect(), rows.schema).repartition("yr", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("request", "yr", "bucket").parquet(cache.path)
    assert cache.missing("r", wanted).select("aoi_id", "yr").collect() == [(victim, 2001)]
    assert cache.load("r", wanted, build).where(f"aoi_id = {victim} AND month = '2001-05-01'").first().n_water == 5
    assert build.asked[3:] == [[(victim, 2001)]]

    # another request shares nothing with this one
    other = Builder(plus=3)
    assert cache.load("q", wanted.where("aoi_id = 1"), other).agg(F.min("n_water")).first()[0] == 4
    assert other.asked == [[(1, 2001), (1, 2002), (1, 2003)]] and cache.load("r", wanted, build).agg(F.min("n_water")).first()[0] == 1


def test_all_or_none(spark, tmp_path):
    cache = ca.ExtentCache(spark, f"file://{tmp_path}", buckets=2)
    wanted = ca.wanted_years(spark.createDataFrame([(1,), (2,)], "aoi_id int"), "2001-01-01", "2002-12-01")
    with pytest.raises(ValueError, match="area 2, year 2002"):
        cache.load("r", wanted, Builder(leave=[(2, 2002)]))
    # what was built stays, and only the rest is asked for
    build = Builder()
    assert cache.load("r", wanted, build).count() == 48 and build.asked == [[(2, 2002)]]
    # a year of which fewer months were wanted before isn't taken for the whole year
    part = ca.wanted_years(spark.createDataFrame([(1,)], "aoi_id int"), "2001-01-01", "2001-06-01")
    assert [tuple(r) for r in cache.missing("r", part).collect()] == [(1, 2001, 6)]


def test_digests(spark):
    one = ca.request_digest(start="2001-01-01", resolution=30, tiles=None)
    assert one == ca.request_digest(resolution=30, start="2001-01-01") != ca.request_digest(resolution=60, start="2001-01-01")
    cells = spark.createDataFrame([(1, 0, 1), (1, 2, 0), (2, 2, 0), (2, 0, 1), (2, 0, 1), (3, 1, 0), (3, 0, 2)], "aoi_id int, y int, x int")
    got = {r.aoi_id: r.area_digest for r in ca.area_digests(cells.repartition(3)).collect()}
    assert got[1] == got[2] != got[3]
