"""Coarser records beside native ones: every figure by hand, matching by brute force over all pairings."""

import datetime as dt
import itertools
import random

import pytest

from tidemark.operators import evaluate, fidelity, season
from tidemark.plans import routing


def month(n):
    return dt.date(2000 + n // 12, n % 12 + 1, 1)


def months(spark, values):
    return spark.createDataFrame([(a, month(i), v) for a, xs in values.items() for i, v in enumerate(xs)], "aoi_id int, month date, extent_pct double")


def record(spark, values, labels, summary, years):
    return fidelity.Record(
        months(spark, values), spark.createDataFrame(labels, "aoi_id int, snr double, regime string, route string"), spark.createDataFrame(summary, "aoi_id int, n_events long, longest_low_spell_months int"),
        spark.createDataFrame(years, "aoi_id int, hy_year int, peak_month date, low_month date"),
    )


def test_figures_by_hand(spark):
    native = record(spark, {1: [1.0, 2.0, None, 5.0], 2: [3.0, 3.0], 3: [1.0]}, [(1, 2.5, "seasonal", "a"), (2, 1.0, "marginal", "b")], [(1, 3, 4), (2, 0, 0)], [(1, 2001, month(0), month(6)), (1, 2002, month(14), None), (1, 2003, month(26), month(30))])
    coarse = record(spark, {1: [2.0, 2.0, 9.0, 4.0], 2: [3.0, 4.0], 4: [1.0]}, [(1, 2.0, "seasonal", "b"), (2, 1.5, "marginal", "b")], [(1, 1, 7)], [(1, 2001, month(11), month(8)), (1, 2002, month(15), month(18)), (1, 2004, month(1), month(2))])
    got = {r.aoi_id: r for r in fidelity.compare(native, {60: coarse}).collect()}
    assert sorted(got) == [1, 2]  # 3 and 4 share no month
    one, two = got[1], got[2]
    assert (one.n_months, one.mean_absolute_difference, one.max_absolute_difference, one.correlation_status) == (3, pytest.approx(2 / 3), 1.0, "ok")
    assert one.normalized_mae == pytest.approx(2 / 15) and one.correlation == pytest.approx(0.970725, abs=1e-6)
    assert (one.amplitude_bias, one.regime_match, one.route_match, one.event_count_delta, one.longest_low_spell_delta) == (-0.5, True, False, -2, 3)
    # January against December is one month; a missing low is never near
    assert (one.peak_within_one_month_fraction, one.trough_within_one_month_fraction) == (1.0, 0.0)
    assert (two.correlation, two.correlation_status, two.event_count_delta, two.peak_within_one_month_fraction) == (None, "constant_input", 0, 1.0)
    flat = {r.aoi_id: r.correlation for r in evaluate.compare_series(native.months, coarse.months).collect()}
    assert flat == {1: pytest.approx(0.970725, abs=1e-6), 2: None}
    with pytest.raises(ValueError, match="no candidate"):
        fidelity.compare(native, {})
    empty = record(spark, {1: []}, [(1, 1.0, "x", "y")], [(1, 0, 0)], [(1, 2001, month(0), month(1))])
    assert fidelity.compare(empty, {60: coarse, 90: empty}).count() == 0


def test_matches_are_one_to_one(spark):
    rng = random.Random(5)
    own, other = ({(a, i): m for a in (1, 2) for i, m in enumerate(rng.sample(range(60), 22))} for _ in (0, 1))
    rows = lambda side: [(a, i, month(m)) for (a, i), m in side.items()] + [(1, 99, None)]
    got = {(r.aoi_id, r.k, r.candidate_k): r.delta_months for r in fidelity.match_spans(*[spark.createDataFrame(rows(x), "aoi_id int, k int, peak_month date") for x in (own, other)], "k").collect()}
    near = lambda side, a, m: min(((abs(x - m), x, j) for (b, j), x in side.items() if b == a and abs(x - m) <= 1), default=None)
    want = {(a, i, j): y - x for ((a, i), x), ((b, j), y) in itertools.product(own.items(), other.items()) if a == b and abs(x - y) <= 1 and near(other, a, x)[2] == j and near(own, a, y)[2] == i}
    assert got == want and len({k[:2] for k in got}) == len({(k[0], k[2]) for k in got}) == len(got) > 10


def test_gates(spark):
    cols = "candidate_resolution_m int, route_match boolean, correlation double, normalized_mae double, peak_within_one_month_fraction double, trough_within_one_month_fraction double, event_count_delta long, longest_low_spell_delta long"
    fine = (True, 0.999, 0.01, 1.0, 0.9, -1, 2)
    rows = [(60, *fine), (60, *fine), (90, *fine), (90, False, 0.9, 0.2, 0.5, 0.5, -2, -3), (300, True, None, 0.01, 1.0, 1.0, 0, 0)]
    got = {r.candidate_resolution_m: r for r in fidelity.recommend(spark.createDataFrame(rows, cols)).collect()}
    assert got[60].recommended and got[60].decision_reason == "passes all gates" and got[60].route_agreement_count == "2/2"
    assert got[90].decision_reason == (
        "fails: route agreement 1/2; median correlation 0.9495 < 0.995; median nMAE 0.1050 > 0.05; peak within 1 month fraction 0.750 < 0.90; "
        "trough within 1 month fraction 0.700 < 0.90; max event delta 2 > 1; max low spell delta 3 > 2"
    )
    assert got[300].median_correlation is None and got[300].decision_reason == "fails: median correlation nan < 0.995"


def test_acquisition(spark):
    runs = [(30, "off", 10.0, 100.0), (30, "off", 20.0, 300.0), (30, "on", 5.0, None), (60, "on", 4.0, 1.0)]
    got = {(r.resolution_m, r.pruning): r for r in fidelity.acquisition(spark.createDataFrame(runs, "resolution_m int, pruning string, seconds double, peak_rss_mb double")).collect()}
    assert (got[30, "off"].n_runs, got[30, "off"].median_seconds, got[30, "off"].median_speedup) == (2, 15.0, 1.0)
    assert (got[30, "on"].median_peak_rss_mb, got[30, "on"].median_speedup, got[60, "on"].median_speedup) == (None, 3.0, 0.25)


def test_assessments_explained(spark):
    """Each rule of regimes, routes, caveats and fall-back by an area made for it."""
    cols = "aoi_id int, n_usable_months long, n_years long, snr double, peak_month int, trough_month int, " + ", ".join(f"{k}_{c} double" for k in ("peak", "trough") for c in ("concentration", "ci_low", "ci_high", "iqr_months", "uniformity_p"))
    strong, loose, even = (0.9, 0.8, 1.0, 1.0, 0.01), (0.5, 0.4, 0.6, 3.0, 0.05), (0.2, 0.1, 0.4, 5.0, 0.5)
    rows = [
        (1, 400, 35, 3.0, 2, 9, *strong, *strong), (2, 100, 9, 3.0, 2, 9, *strong, *loose), (3, 100, 9, 1.0, 2, 9, *loose, *loose), (4, 100, 9, 2.5, 2, 9, *even, *even),
        (5, 100, 12, 2.5, 2, 9, *even, *even), (6, 50, 9, 0.5, 2, 9, *strong, *strong), (7, 30, 3, None, None, None, *[None] * 10), (8, 400, 35, 3.0, 2, None, *strong, *strong), (9, 100, 9, 1.0, None, 9, *loose, *loose), (10, 0, None, None, None, None, *[None] * 10),
    ]
    summary = spark.createDataFrame([(1, 4, 2, 0), (2, 3, 5, 6), (7, 1, 1, 1)], "aoi_id int, n_events long, longest_low_spell_months int, n_years_without_event long")
    got = {r.aoi_id: r for r in routing.reasons(season.explain(season.conclude(spark.createDataFrame(rows, cols)), summary)).collect()}
    assert [got[a].regime for a in range(1, 11)] == ["seasonal", "seasonal", "marginal", "marginal", "aseasonal", "aseasonal", "insufficient_record", "seasonal", "marginal", "insufficient_record"]
    own, one, none = "per_year_detection", "fixed_climatological_window", "event_characterisation"
    assert [got[a].route for a in range(1, 11)] == [own, one, one, none, none, none, "insufficient_record", none, none, "insufficient_record"]
    keys = {v: k for k, v in season.CAVEATS.items()}
    notes = {a: [keys.get(c, c) for c in got[a].caveats[2:]] for a in got}
    assert notes[1] == [] and notes[2] == ["few_timings", "years without a wet event: 6 of 9"] and notes[3] == ["few_timings", "marginal"]
    assert notes[4] == ["few_timings", "weak_test", "marginal"] and notes[6] == ["few_timings", "aseasonal"] and notes[7] == notes[10] == []
    assert (got[7].n_timing_years, got[7].n_wet_events, got[7].years_without_wet_event, got[3].n_timing_years, got[10].n_years, got[10].snr) == (0, 0, 0, 9, 0, 0.0)
    assert [got[a].warnings[-1] for a in (8, 9)] == ["fell back to events: no usual low", "fell back to events: no usual peak"] and got[1].warnings == got[1].caveats
    assert got[1].route_reason == "seasonal (SNR 3.00, lows' concentration at least 0.80): own boundaries each year" and got[7].route_reason.startswith("usable years: 3;")
