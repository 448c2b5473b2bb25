"""Batches with broken areas, and what is refused."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_season_engine import ramp, record

from tidemark.operators import pixels, prepare
from tidemark.plans import batch


def test_bad_areas_cost_the_others_nothing(spark):
    year = [ramp(m) for m in range(1, 13)]
    good = record(spark, year * 12, start=(2001, 1), area=1)
    rows = good
    for a, values in ((2, year * 3), (3, year * 2), (4, year[:7]), (5, [140.0, *year]), (6, year)):
        rows = rows.union(record(spark, values, start=(2001, 1) if a != 6 else (1980, 1), area=a))
    rows = rows.union(record(spark, [5.0], start=(2002, 4), area=2))
    asked = spark.createDataFrame([(a,) for a in range(1, 8)], "aoi_id int")
    b = batch.run_many(rows.repartition(3), asked, start="2001-01-15", end="2012-12-01", n_resamples=20)
    got = {r.aoi_id: r for r in b.outcomes.collect()}
    assert {a: r.error_type for a, r in got.items()} == {1: None, 2: "BadRecord", 3: None, 4: "ShortRecord", 5: "BadRecord", 6: "NoMonths", 7: "NoRecord"}
    assert "2002-04-01" in got[2].error and got[4].error == "months with a value: 7, needed: 12" and "extent_pct" in got[5].error
    assert (got[1].n_months, got[1].first_month, got[1].last_month) == (144, dt.date(2001, 1, 1), dt.date(2012, 12, 1))
    assert {r.aoi_id for r in b.records.select("aoi_id").distinct().collect()} == {1, 3}
    alone = batch.run_many(good, n_resamples=20).analysis
    key = ["aoi_id", "hy_year", "peak_month", "end_dry_month"]
    assert sorted(b.analysis.hydro_years.where("aoi_id = 1").select(*key).collect()) == sorted(alone.hydro_years.select(*key).collect())
    assert alone.hydro_years.count() >= 10
    with pytest.raises(ValueError, match="5 areas: 2: duplicate months"):
        b.raise_for_failures()


def test_names(spark):
    areas = spark.createDataFrame([(1, " Upper Reach "), (2, "Élan & Tide"), (3, "b.2")], "position int, label string")
    assert [(r.name, r.safe_name) for r in batch.area_names(areas, "label").orderBy("position").collect()] == [("Upper Reach", "upper-reach"), ("Élan & Tide", "lan-tide"), ("b.2", "b-2")]
    assert [r.name for r in batch.area_names(areas).orderBy("position").collect()] == ["aoi-0001", "aoi-0002", "aoi-0003"]
    for bad, word in (((None, "a"), "null"), (("a", "  "), "blank"), (("a", "a "), "repeated"), (("A-b", "a b"), "safe name")):
        with pytest.raises(ValueError, match=word):
            batch.area_names(spark.createDataFrame([(i, x) for i, x in enumerate(bad, 1)], "position int, label string"), "label")


def test_sources_and_axes_refuse_repeated_months(spark):
    twice = record(spark, [4.0, 6.0]).union(record(spark, [8.0]).withColumn("month", F.date_add("month", 12)))
    for run in (prepare.prepare_checked, prepare.frame_source, lambda x: prepare.coerce_monthly(x, duplicates="raise"), lambda x: prepare.normalise_rainfall(x, "extent_pct")):
        with pytest.raises(ValueError, match="1997-03-01"):
            run(twice)
    assert prepare.prepare_checked(record(spark, [4.0, 6.0])).count() == prepare.frame_source(record(spark, [4.0, 6.0])).count() == 2
    with pytest.raises(ValueError, match="no months"):
        prepare.frame_source(record(spark, [4.0]), start="2005-01-01")
    cells = spark.createDataFrame([(1, 0, 0)], "aoi_id int, y int, x int")
    mask = spark.createDataFrame([(1, dt.date(2001, 1, 1), 0, 0, 1, 1), (1, dt.date(2001, 1, 1), 0, 0, 0, 2), (1, dt.date(2001, 3, 1), 0, 0, 0, 3)], "aoi_id int, month date, y int, x int, code int, n int")
    with pytest.raises(ValueError, match="repeated rows"):
        pixels.complete_cube(mask, cells, duplicates="raise")
    assert [r.code for r in pixels.complete_cube(mask, cells, duplicates="first", order="n").orderBy("month").collect()] == [1, -1, 0]
