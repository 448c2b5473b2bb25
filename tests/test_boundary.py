"""Lows chosen together against every possible choice, and how ties are relabelled."""

import datetime as dt
import itertools
import random

import pytest
from test_season_engine import record

from tidemark.operators import boundary, dynamic_year, prepare

SCHEMA = "aoi_id int, hy_year int, expected date, candidates array<struct<month:date,extent_pct:double>>"


def number(day):
    return day.year * 12 + day.month


def month(year, k):
    return dt.date(year + (k - 1) // 12, (k - 1) % 12 + 1, 1)


def by_hand(years, tolerance):
    """{year: month}: of all choices the least cost; ties by the latest last month, then by the earliest months before, from the end on."""
    out = {y: None for y, _, c in years if not c}
    blocks = [list(g) for full, g in itertools.groupby(years, key=lambda t: bool(t[2])) if full]
    for block in blocks:
        lows = [[m for m, v in c if tolerance is None or v <= min(x for _, x in c) * (1 + tolerance)] for _, _, c in block]

        def rank(choice, block=block):
            cost = sum(abs(number(m) - number(e)) for m, (_, e, _) in zip(choice, block, strict=True))
            cost += sum(abs(number(b) - number(a) - 12) for a, b in itertools.pairwise(choice))
            return cost, -number(choice[-1]), *map(number, reversed(choice[:-1]))

        out |= dict(zip([y for y, _, _ in block], min(itertools.product(*lows), key=rank), strict=True))
    return out


@pytest.mark.parametrize("tolerance", [None, 0.0, 0.05, 0.5])
def test_sequences_against_every_choice(spark, tolerance):
    rng = random.Random(11)
    areas = {}
    for a in range(40):
        areas[a] = []
        for y in range(2001, 2001 + rng.randrange(1, 8)):
            lows = sorted(rng.sample(range(3, 14), rng.choice([0, 1, 1, 2, 3, 4])))
            areas[a].append((y, month(y, 8), [(month(y, k), rng.choice([4.0, 4.1, 4.2, 5.0, 6.5])) for k in lows]))
    rows = [(a, *t) for a, own in areas.items() for t in own]
    got = boundary.boundary_sequence(spark.createDataFrame(rows, SCHEMA).repartition(3), relative_tolerance=tolerance).collect()
    assert len(got) == len(rows)
    assert {(r.aoi_id, r.hy_year): r.month for r in got} == {(a, y): m for a, own in areas.items() for y, m in by_hand(own, tolerance).items()}


def test_no_opportunities(spark):
    assert not boundary.boundary_sequence(spark.createDataFrame([], SCHEMA)).collect()


def test_equal_lows_follow_the_neighbouring_years(spark):
    """The second year's least value stands in June and July, side by side; its neighbours' lows are in July."""
    year = [60.0, 70.0, 80.0, 70.0, 55.0, 40.0, 20.0, 40.0, 50.0, 55.0, 58.0, 59.0]
    tied = [*year[:5], 20.0, 20.0, *year[7:]]
    p = prepare.prepare(record(spark, [*year, *tied, *year], start=(2001, 1)))
    got = {r.hy_year: r for r in dynamic_year.troughs(p, 7).collect()}
    assert [got[y].trough_month for y in (2001, 2002, 2003)] == [dt.date(y, 7, 1) for y in (2001, 2002, 2003)]
    assert (got[2002].raw_trough_month, got[2002].selection_status, got[2002].boundary_status) == (dt.date(2002, 6, 1), "coherence_adjusted", "provisional")
    assert got[2001].selection_status == got[2003].selection_status == "raw"


def test_options(spark):
    with pytest.raises(ValueError, match="1 and 12"):
        dynamic_year.YearOptions(0)
    for bad in ({"trough_search_radius_months": 6}, {"max_invalid_pct": 101}, {"quality_policy": "drop"}):
        with pytest.raises(ValueError):
            dynamic_year.YearOptions(9, **bad)
    year = [60.0, 70.0, 80.0, 70.0, 55.0, 40.0, 20.0, 40.0, 50.0, 55.0, 58.0, 59.0]
    rows = record(spark, year * 4, start=(2001, 1))
    got = dynamic_year.detect_with(rows, dynamic_year.YearOptions(7, trough_search_radius_months=2)).where("trough_month IS NOT NULL").collect()
    assert [r.trough_month for r in sorted(got, key=lambda r: r.hy_year)] == [dt.date(y, 7, 1) for y in range(2001, 2005)]
    with pytest.raises(ValueError, match="duplicate months"):
        dynamic_year.detect_with(rows.union(rows), dynamic_year.YearOptions(7))


def test_suggested_months(spark):
    rows = spark.createDataFrame([(1, "unimodal_annual", 9, 2), (2, "low_variability", None, None), (3, "bimodal_or_complex", None, 3)], "aoi_id int, pattern string, trough_month int, peak_month int")
    got = {r.aoi_id: (r.expected_trough_month, r.expected_peak_month, r.error) for r in dynamic_year.suggest(rows).collect()}
    assert got[1] == (9, 2, None) and got[2] == (None, None, "no stable trough phase: low_variability") and got[3][:2] == (None, None) and got[3][2]
