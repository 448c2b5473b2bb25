"""The years' bootstrap against least squares on whole resampled records."""

import math

import numpy as np
import pytest
from test_season_engine import record

from tidemark.operators import prepare, support

ANGLE = 2 * np.pi * np.arange(12) / 12


def fitted(years):
    """(label, curve) of whole years, by least squares on all months."""
    y = np.concatenate(years)
    t = np.tile(ANGLE, len(years))
    best = None
    for order in (0, 1, 2):
        columns = [np.ones_like(t)] + [f(h * t) for h in range(1, order + 1) for f in (np.sin, np.cos)]
        x = np.stack(columns, axis=1)
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        n, k = x.shape
        score = n * math.log(max(((y - x @ beta) ** 2).sum(), np.finfo(float).tiny) / n) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
        if best is None or score < best[0]:
            best = score, order, x[:12] @ beta
    _, order, v = best
    tops = [i for i in range(12) if v[i] > v[i - 1] and v[i] >= v[(i + 1) % 12]]
    label = "low_variability" if np.ptp(v) <= 1 else "weak_or_irregular" if not order else "unimodal_annual" if len(tops) == 1 else "bimodal_or_complex"
    return label, v


def spread(months):
    t = 2 * np.pi * (np.array(months) - 1) / 12
    off = np.angle(np.exp(1j * (t - np.angle(np.exp(1j * t).mean())))) * 12 / (2 * np.pi)
    return np.percentile(off, 75) - np.percentile(off, 25)


def areas():
    rng = np.random.default_rng(5)
    wave = lambda a, b, noise, n: [40 + a * np.cos(ANGLE - 1) + b * np.cos(2 * ANGLE - 2) + rng.normal(0, noise, 12) for _ in range(n)]
    return {1: wave(25, 0, 3, 8), 2: wave(2, 2, 9, 6), 3: wave(3, 14, 4, 7), 4: wave(0.2, 0, 0.05, 6), 5: wave(20, 0, 2, 4), 6: wave(6, 7, 8, 9)}


def test_support_against_least_squares(spark):
    made = areas()
    frames = [record(spark, [float(v) for y in years for v in y], start=(2001, 1), area=a) for a, years in made.items()]
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.union(f)
    # an unfinished year at the end is no complete year
    got = {r.aoi_id: r for r in support.seasonal_pattern(prepare.prepare(rows), n_bootstrap=60, seed=3).collect()}
    for a, years in made.items():
        r = got[a]
        if len(years) < 5:
            assert (r.pattern, r.bootstrap_support, r.peak_phase_iqr_months, r.peak_month) == ("insufficient_record", 0.0, None, None)
            continue
        label, v = fitted(years)
        draw = np.random.default_rng(3)
        boots = [fitted([years[i] for i in draw.choice(len(years), len(years), replace=True)]) for _ in range(60)]
        share = sum(b[0] == label for b in boots) / 60
        assert r.bootstrap_support == pytest.approx(share)
        assert r.pattern == (label if label == "low_variability" or share >= 0.8 else "weak_or_irregular")
        assert r.peak_phase_iqr_months == pytest.approx(spread([b[1].argmax() + 1 for b in boots]), abs=1e-6)
        assert r.trough_phase_iqr_months == pytest.approx(spread([b[1].argmin() + 1 for b in boots]), abs=1e-6)
        if label != "low_variability":
            assert r.peak_month == v.argmax() + 1 and r.trough_month == v.argmin() + 1
    assert got[3].secondary_peak_month is not None and got[1].secondary_peak_month is None
    assert got[2].pattern == "weak_or_irregular" and got[1].pattern == "unimodal_annual" and got[4].pattern == "low_variability"


def test_no_complete_years(spark):
    r = support.seasonal_pattern(prepare.prepare(record(spark, [1.0] * 30))).first()
    assert (r.pattern, r.bootstrap_support, r.n_complete_years) == ("insufficient_record", 0.0, 1)
