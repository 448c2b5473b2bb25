"""Tables for readers, on months and years made by hand."""

import datetime as dt

from tidemark.plans import exports


def month(n):
    return dt.date(2000 + n // 12, n % 12 + 1, 1)


def test_labels_cards_and_annotations(spark):
    months = spark.createDataFrame([(1, month(i), float(i), q, s) for i, (q, s) in enumerate([(0.0, "usable"), (20.0, "usable"), (20.5, "usable"), (None, "unknown"), (5.0, "missing"), (30.0, "low"), (1.0, "usable"), (1.0, "usable")])] + [(2, month(0), None, None, "missing")], "aoi_id int, month date, extent_pct double, invalid_pct double, quality_state string")
    spans = lambda *s: spark.createDataFrame([(a, month(x), month(y)) for a, x, y in s], "aoi_id int, start_month date, end_month date")
    got = {(r.aoi_id, r.month): r for r in exports.annotated_months(months, spans((1, 1, 2), (1, 2, 3)), spans((1, 5, 5), (3, 0, 1))).collect()}
    one = [got[1, month(i)] for i in range(8)]
    assert [r.quality_filter for r in one] == ["good", "good", "flagged", "missing", "missing", "flagged", "good", "good"] and got[2, month(0)].quality_filter == "missing"
    assert [r.wet_event for r in one] == ["No", "Yes", "Yes", "Yes", "No", "No", "No", "No"] and [r.low_extent_spell for r in one].index("Yes") == 5
    assert (one[3].display_date, one[3].year, len(got)) == ("Apr 2000", 2000, 9)

    cols = "aoi_id int, hy_year int, status string, status_reason string, hy_start date, hy_end date, peak_month date, temporal_mid_dry_month date, trough_month date, cycle_months int, drawdown_pct double, confidence string"
    years = [(1, 2000, "complete", "ok", month(0), month(3), month(1), month(2), month(3), 4, 1.5, "high"), (1, 2001, "complete", "ok", month(3), month(5), None, None, month(5), 3, None, None), (1, 2002, "partial", "boundary_provisional", month(6), month(7), month(6), month(6), month(7), 2, 2.0, "low"), (1, 2003, "unresolved", "no_previous_boundary", None, None, None, None, None, None, None, "low")]
    annual = spark.createDataFrame(years, cols)
    labels = {r.month: (r.hy_year, r.season) for r in exports.season_labels(months.where("aoi_id = 1"), annual).collect()}
    assert [labels[month(i)] for i in range(8)] == [(2000, "Wet"), (2000, "Wet"), (2000, "Dry"), (2001, "Dry"), (2001, "Dry"), (2001, "Dry"), (None, "unassigned"), (None, "unassigned")]

    phases = spark.createDataFrame([(1, month(0), "wet"), (1, month(1), "unspecified")], "aoi_id int, month date, phase string")
    rows = exports.year_cards(months, annual, phases).orderBy("card", "month").collect()
    assert [(r.card, r.hy_year, r.month and r.month.month, r.phase, r.marker) for r in rows] == [
        (1, 2003, None, None, None), (2, 2002, 7, "Unassigned", "Wet Peak"), (2, 2002, 8, "Unassigned", "Dry End"), (3, 2001, 4, "Unassigned", None), (3, 2001, 5, "Unassigned", None), (3, 2001, 6, "Unassigned", "Dry End"),
        (4, 2000, 1, "Wet", None), (4, 2000, 2, "Unassigned", "Wet Peak"), (4, 2000, 3, "Unassigned", "Mid Dry"), (4, 2000, 4, "Unassigned", "Dry End"),
    ]
    assert {r.confidence for r in rows if r.card == 3} == {"unassigned"}

    routes = spark.createDataFrame([(1, "seasonal", "per_year_detection"), (2, "aseasonal", "event_characterisation")], "aoi_id int, regime string, route string")
    wide = exports.wide_hydro_years(annual.unionByName(spark.createDataFrame([(2, *years[0][1:])], cols)), routes).collect()
    assert {(r.aoi_id, r.route, r.boundary_basis) for r in wide} == {(1, "per_year_detection", "detected_per_year")} and len(wide) == 4
    none = annual.where("false")
    assert exports.season_labels(months.where("false"), none).count() == exports.year_cards(months, none, phases).count() == exports.annotated_months(months.where("false"), spans(), spans()).count() == 0
