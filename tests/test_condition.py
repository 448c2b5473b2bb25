"""Conditions of years whose ranks are plain to see."""

import pytest

from tidemark.operators import condition, prepare

#: Ranks of the lows of fifteen years; peaks rise year by year.
LOW_RANKS = [0, 13, 5, 2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 1, 14]


def years(spark, n=15):
    rows = [(1, 2001 + i, 20.0 + 4 * i, 0.5 * LOW_RANKS[i], True) for i in range(n)]
    return spark.createDataFrame(rows, "aoi_id int, hy_year int, peak_extent_pct double, trough_extent_pct double, eligible boolean")


def test_names_of_extremes(spark):
    noise = spark.createDataFrame([(1, 60.0)], "aoi_id int, noise_pp double")
    got = {r.hy_year: r for r in condition.annual_condition(years(spark), noise=noise).collect()}
    assert {y: got[y].annual_condition for y in (2001, 2002, 2003, 2014, 2015)} == {2001: "dry_low_refuge", 2002: "buffered_low_recharge", 2003: "typical_or_mixed", 2014: "recharged_then_contracting", 2015: "wet_persistent"}
    assert got[2003].peak_percentile == pytest.approx(200 / 14) and got[2002].trough_percentile == pytest.approx(1300 / 14)
    assert [got[y].consecutive_dry_cycles for y in (2001, 2002)] == [1, 0] and got[2015].consecutive_wet_cycles == 1
    assert got[2015].recharge_condition_qualified == "typical_uncertain" and got[2015].timing_confidence == "low"


def test_baselines_before_each_year(spark):
    got = [(r.baseline_mode, r.n_baseline) for r in condition.annual_condition(years(spark, 13), mode="rolling").orderBy("hy_year").collect()]
    assert [m for m, _ in got] == ["insufficient"] * 5 + ["expanding"] * 5 + ["rolling"] * 3 and [n for _, n in got[5:]] == [5, 6, 7, 8, 9, 10, 10, 10]


def test_too_few_years(spark):
    assert {r.annual_condition for r in condition.annual_condition(years(spark, 6)).collect()} == {"insufficient_baseline"}


def test_areas_of_low_variability_get_no_names(spark):
    got = condition.annual_condition(years(spark), low_variability=spark.createDataFrame([(1,)], "aoi_id int")).select("annual_condition").distinct().collect()
    assert [r[0] for r in got] == ["not_applicable_low_variability"]


def test_half_an_interval_is_refused(spark):
    with pytest.raises(ValueError):
        condition.monthly_condition(prepare.prepare(spark.createDataFrame([], "aoi_id int, month date, extent_pct double, invalid_pct double")), reference_end="2009-12-01")
