"""Small records whose answers were worked out by hand."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import events, fixed_year, prepare, season
from tidemark.sources import csv
from tidemark.streaming import monthly


def record(spark, values, start=(1997, 3), invalid=0.0, area=1):
    rows = []
    for i, v in enumerate(values):
        m = start[0] * 12 + start[1] - 1 + i
        rows.append((area, dt.date(m // 12, m % 12 + 1, 1), v, invalid))
    return spark.createDataFrame(rows, "aoi_id int, month date, extent_pct double, invalid_pct double")


def ramp(month, top=3):
    """100 in the top month, 15 less for each month away from it, 10 half a year away."""
    away = abs(month - top) % 12
    return 100.0 - 15.0 * min(away, 12 - away)


def test_two_high_months_are_one_event(spark):
    found = events.extract(prepare.prepare(record(spark, [7.0] * 15 + [21.0, 34.0] + [7.0] * 9)))[0].collect()
    assert [(r.start_month, r.end_month, r.duration_months, r.peak_month, r.peak_extent_pct, r.magnitude_pp_months) for r in found] == [(dt.date(1998, 6, 1), dt.date(1998, 7, 1), 2, dt.date(1998, 7, 1), 34.0, 41.0)]


def test_unseen_months_end_events(spark):
    assert events.extract(prepare.prepare(record(spark, [7.0] * 10 + [30.0, None, 25.0] + [7.0] * 10)))[0].count() == 2


def test_constant_records_have_no_events(spark):
    assert events.extract(prepare.prepare(record(spark, [13.0] * 40)))[0].count() == 0


def test_low_threshold_drops_below_the_baseline(spark):
    spells = events.extract(prepare.prepare(record(spark, [40.0] * 25 + [2.0] * 7 + [40.0] * 6 + [90.0] * 2)))[1].collect()
    assert [(r.duration_months, r.start_month, r.min_extent_pct) for r in spells] == [(7, dt.date(1999, 4, 1), 2.0)]


def test_percentages_need_a_weight(spark):
    with pytest.raises(ValueError):
        prepare.basin_weighted(record(spark, [5.0]), None)


def test_basin_adds_counts_before_it_divides(spark):
    rows = [(1, dt.date(2011, 5, 1), 3, 6, 2, 8), (2, dt.date(2011, 5, 1), 50, 194, 6, 200)]
    r = prepare.basin_from_counts(spark.createDataFrame(rows, "aoi_id int, month date, n_water long, n_valid long, n_invalid long, n_aoi long")).first()
    assert (r.n_water, r.n_valid, r.n_aoi_reporting) == (53, 200, 2) and r.extent_pct == pytest.approx(26.5) and r.invalid_pct == pytest.approx(100 * 8 / 208)


def test_years_of_a_ramp(spark):
    p = prepare.prepare(record(spark, [ramp(i % 12 + 1) for i in range(36)], (2010, 1)))
    got = fixed_year.detect(p).orderBy("hy_year").collect()
    assert [(r.hy_year, r.peak_month, r.end_dry_month, r.amplitude_pct) for r in got] == [(y, dt.date(y, 3, 1), dt.date(y, 9, 1), 90.0) for y in (2010, 2011, 2012)]


def test_windows_differ_by_area(spark):
    p = prepare.prepare(record(spark, [ramp(i % 12 + 1, 8) for i in range(36)], (2010, 1), area=2).union(record(spark, [ramp(i % 12 + 1) for i in range(36)], (2010, 1))))
    win = spark.createDataFrame([(1, 1, 5, 6, 7), (2, 6, 5, 12, 5)], "aoi_id int, wet_start int, wet_len int, dry_start int, dry_len int")
    got = fixed_year.detect(p, win).where("hy_year = 2011").orderBy("aoi_id").collect()
    assert [(r.peak_month, r.end_dry_month) for r in got] == [(dt.date(2011, 3, 1), dt.date(2011, 9, 1)), (dt.date(2011, 8, 1), dt.date(2012, 2, 1))]


def test_windows_from_the_climatology(spark):
    r = fixed_year.from_climatology(record(spark, [ramp(i % 12 + 1) for i in range(24)], (2010, 1))).first()
    assert (r.peak_month, r.trough_month, r.wet_start, r.wet_len, r.dry_start, r.dry_len) == (3, 9, 1, 5, 6, 7)
    assert fixed_year.from_climatology(record(spark, [1.0, 2.0])).count() == 0


def test_windows_that_do_not_serve(spark):
    rows = [(1, 13, 2, 5, 2), (2, 11, 6, 4, 3), (3, 1, 12, 2, 8), (4, 11, 6, 7, 6)]
    got = [r.error for r in fixed_year.checked(spark.createDataFrame(rows, "aoi_id int, wet_start int, wet_len int, dry_start int, dry_len int")).orderBy("aoi_id").collect()]
    assert got[3] is None and all(got[:3])
    p = prepare.prepare(record(spark, [1.0] * 24, area=2))
    with pytest.raises(Exception, match="last month"):
        fixed_year.detect(p, spark.createDataFrame(rows[1:2], "aoi_id int, wet_start int, wet_len int, dry_start int, dry_len int")).collect()
    with pytest.raises(ValueError):
        fixed_year.detect(p, shares=(0.6, 0.5))


def test_patterns(spark):
    def label(f, years=7):
        return season.pattern(prepare.prepare(record(spark, [f(i % 12 + 1) for i in range(12 * years)], (2001, 1)))).first().pattern

    wave = lambda size, times, at: lambda m: 45 + size * math.cos(2 * math.pi * times * (m - at) / 12)
    assert label(wave(7, 1, 5)) == "unimodal_annual" and label(wave(6, 2, 2)) == "bimodal_or_complex"
    assert label(lambda m: 3.3) == "low_variability" and label(wave(7, 1, 5), 4) == "insufficient_record"


def test_regimes_side_by_side(spark):
    names = ["seasonal", "marginal", "aseasonal", "insufficient_record"]
    e = spark.createDataFrame([(4 * i + j, a, 1.0, 11) for i, a in enumerate(names) for j in range(4)], "aoi_id int, regime string, snr double, peak_month int")
    r = spark.createDataFrame([(4 * i + j, b, 1.0, 2) for i in range(4) for j, b in enumerate(names)], "aoi_id int, regime string, snr double, peak_month int")
    got = {(x.extent_regime, x.rain_regime): (x.divergence, x.lag_months) for x in season.compare_rainfall(e, r).collect()}
    assert [got[a, b][0] for a in names[:3] for b in names[:3]] == ["agree", "extent_more_seasonal", "extent_more_seasonal", "extent_damped", "partial", "extent_more_seasonal", "extent_damped", "extent_damped", "agree"]
    assert {got[a, "insufficient_record"][0] for a in names} == {"rainfall_insufficient"} and got["insufficient_record", "seasonal"][0] == "extent_insufficient"
    assert got["seasonal", "marginal"][1] == -3 and got["seasonal", "aseasonal"][1] is None


def test_validation_names_what_is_wrong(spark):
    assert "1997-03-01" in prepare.check_extent(record(spark, [4.0]).union(record(spark, [6.0]))).first().error
    assert prepare.check_extent(record(spark, [4.0, 6.0])).first().error is None and prepare.check_extent(record(spark, [-3.0])).first().error is not None


def test_csv_in_and_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,extent_pct,site\n2004-02-17,12.5,x\n2004-03-01,,y\n")
    got = csv.extent(spark, str(tmp_path / "a.csv")).orderBy("month").collect()
    assert [(r.month, r.extent_pct, r.site) for r in got] == [(dt.date(2004, 2, 1), 12.5, "x"), (dt.date(2004, 3, 1), None, "y")]
    with pytest.raises(ValueError, match="rain"):
        csv.extent(spark, str(tmp_path / "a.csv"), value_col="rain")
    (tmp_path / "b.csv").write_text("date,rainfall_mm\n2004-02-17,many\n")
    with pytest.raises(Exception, match="no number"):
        csv.rainfall(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "c.csv").write_text("date,rainfall_mm\n2004-02-17,3\n2004-02-18,4\n")
    with pytest.raises(Exception, match="twice"):
        csv.rainfall(spark, str(tmp_path / "c.csv")).collect()
    csv.write_reports(str(tmp_path / "out"), monthly=record(spark, [5.0, 6.0]))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "monthly")).count() == 2


def test_streamed_days_add_up(spark, tmp_path):
    rows = [(1, dt.datetime(2020, 1, d, 3), raw) for d, raw in ((1, 128), (1, 0), (2, 1), (31, 128))] + [(1, dt.datetime(2020, 5, 1), 0)]
    spark.createDataFrame(rows, "aoi_id int, obs_ts timestamp, raw int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monthly.daily_counts(spark.readStream.schema("aoi_id int, obs_ts timestamp, raw int").parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = monthly.add_up(spark.read.parquet(str(tmp_path / "out"))).collect()
    assert [(r.month, r.n_water, r.n_valid, r.n_seen) for r in got] == [(dt.date(2020, 1, 1), 2, 3, 4)]


def test_registry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).agg(F.count("*")).first()[0] > 0
