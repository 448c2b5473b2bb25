"""Seasonality, timing on the month circle, and the regime."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import cyclic_offset, first_max, first_min, quantile, r6

#: Regime thresholds, fixed values.
SEASONAL_SNR, ASEASONAL_SNR = 2.0, 0.7
STRONG_R, WEAK_R, ALPHA = 0.7, 0.3, 0.1
MIN_UNIFORMITY_YEARS, MIN_YEARS, MIN_MONTHS = 10, 5, 9
MIN_SUPPORT = 0.80
#: Fewer annual timings than this are noted.
CAUTION_YEARS = 30

#: What to do with a record of each regime.
ACTIONS = {
    "seasonal": "Detect a hydrological year's own boundaries each year; peaks and lows recur.",
    "marginal": "Report no yearly peak or low; at most one fixed window, named as imposed, beside events.",
    "aseasonal": "Define no hydrological year; describe the area by wet events and low spells.",
    "insufficient_record": "Lengthen the record or loosen the quality screen; too few years say nothing on seasonality.",
}
#: What a reader of an assessment is told: the first two always, the others where they apply.
CAVEATS = {
    "scope": "extent is surface water as observed, neither rainfall nor a climate variable",
    "drivers": "regulation, extraction, diversion and land use move extent apart from rainfall",
    "few_timings": "under 30 annual timings: the regime stands, intervals may be wide",
    "weak_test": "under 10 annual timings the test of uniformity has little power, so the record stays marginal",
    "marginal": "peaks are too scattered for yearly boundaries; the usual peak is an average only",
    "aseasonal": "no annual cycle recurs, so no peak or low is given",
}


def years_with(prepared: DataFrame, months: int) -> DataFrame:
    """Usable months of years that have at least ``months`` of them."""
    use = prepared.where("candidate_usable").withColumn("yr", F.year("month"))
    full = use.groupBy("aoi_id", "yr").agg(F.countDistinct(F.month("month")).alias("k")).where(F.col("k") >= months)
    return use.join(full, ["aoi_id", "yr"], "left_semi")


def harmonics(complete: DataFrame) -> DataFrame:
    """Best harmonic order (0 to 2) by AICc on complete years, with its coefficients and strength.

    On complete years the harmonics are orthogonal, so each coefficient is a plain average.
    """
    t = (F.month("month") - 1) * (2 * math.pi / 12)
    y = F.col("extent_pct")
    beta = complete.groupBy("aoi_id").agg(F.avg(y).alias("b0"), *[(2 * F.avg(y * f(h * t))).alias(f"{n}{h}") for h in (1, 2) for n, f in (("s", F.sin), ("c", F.cos))])
    rows = complete.join(beta, "aoi_id")
    e1 = F.col("s1") * F.sin(t) + F.col("c1") * F.cos(t)
    e2 = F.col("s2") * F.sin(2 * t) + F.col("c2") * F.cos(2 * t)
    tiny = F.lit(2.2250738585072014e-308)
    rss = rows.groupBy("aoi_id", "b0", "s1", "c1", "s2", "c2").agg(F.count("*").alias("n"), *[F.greatest(tiny, F.sum(F.pow(y - F.col("b0") - x, F.lit(2.0)))).alias(f"rss{k}") for k, x in enumerate((F.lit(0.0), e1, e1 + e2))])
    aicc = [F.col("n") * F.log(F.col(f"rss{o}") / F.col("n")) + 2 * k + F.lit(2.0 * k * (k + 1)) / (F.col("n") - k - 1) for o, k in ((0, 1), (1, 3), (2, 5))]
    order = F.when((aicc[0] <= aicc[1]) & (aicc[0] <= aicc[2]), 0).when(aicc[1] <= aicc[2], 1).otherwise(2)
    chosen = F.when(order == 0, F.col("rss0")).when(order == 1, F.col("rss1")).otherwise(F.col("rss2"))
    return rss.select("aoi_id", "n", order.alias("fit_order"), "b0", "s1", "c1", "s2", "c2", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - chosen / F.col("rss0"))).alias("strength"))


def curve(fit: DataFrame) -> DataFrame:
    """The fitted value of each calendar month, and whether it is a local extreme of the year's circle."""
    m = fit.withColumn("moy", F.explode(F.sequence(F.lit(1), F.lit(12))))
    t = (F.col("moy") - 1) * (2 * math.pi / 12)
    value = F.col("b0") + F.when(F.col("fit_order") >= 1, F.col("s1") * F.sin(t) + F.col("c1") * F.cos(t)).otherwise(0.0) + F.when(F.col("fit_order") >= 2, F.col("s2") * F.sin(2 * t) + F.col("c2") * F.cos(2 * t)).otherwise(0.0)
    rows = m.select("aoi_id", "fit_order", "strength", "moy", value.alias("value"))
    w = Window.partitionBy("aoi_id").orderBy("moy")
    first, last = F.first("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.last("value").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left, right, v = F.coalesce(F.lag("value").over(w), last), F.coalesce(F.lead("value").over(w), first), F.col("value")
    return rows.withColumn("is_max", (v > left) & (v >= right)).withColumn("is_min", (v < left) & (v <= right))


def pattern(prepared: DataFrame, *, tolerance_pct: float = 1.0) -> DataFrame:
    """Seasonal pattern per area without resampling: (aoi_id, pattern, peak_month, trough_month, strength, n_complete_years)."""
    complete = years_with(prepared, 12)
    n = complete.groupBy("aoi_id").agg(F.countDistinct("yr").alias("n_complete_years"))
    c = curve(harmonics(complete))
    found = c.groupBy("aoi_id").agg(
        F.max("strength").alias("strength"), F.max("fit_order").alias("fit_order"), (F.max("value") - F.min("value")).alias("range"), F.count_if("is_max").alias("maxima"),
        F.coalesce(first_max(F.when(F.col("is_max"), F.col("value")), F.col("moy")), first_max(F.col("value"), F.col("moy"))).alias("peak_month"),
        F.coalesce(first_min(F.when(F.col("is_min"), F.col("value")), F.col("moy")), first_min(F.col("value"), F.col("moy"))).alias("trough_month"),
    )
    label = F.when(F.col("range") <= tolerance_pct, "low_variability").when(F.col("fit_order") == 0, "weak_or_irregular").when(F.col("maxima") == 1, "unimodal_annual").otherwise("bimodal_or_complex")
    out = prepared.select("aoi_id").distinct().join(n, "aoi_id", "left").join(found, "aoi_id", "left")
    few = F.coalesce("n_complete_years", F.lit(0)) < MIN_YEARS
    hide = lambda c: F.when(~few & (label != "low_variability"), F.col(c)).alias(c)
    return out.select("aoi_id", F.when(few, "insufficient_record").otherwise(label).alias("pattern"), hide("peak_month"), hide("trough_month"), F.when(few, 0.0).otherwise(F.col("strength")).alias("strength"), F.coalesce("n_complete_years", F.lit(0)).alias("n_complete_years"))


def annual_extremes(prepared: DataFrame) -> DataFrame:
    """Peak and trough month of each qualifying year; the first on ties."""
    rows = years_with(prepared, MIN_MONTHS)
    return rows.groupBy("aoi_id", "yr").agg(F.month(first_max(F.col("extent_pct"), F.col("month"))).alias("peak"), F.month(first_min(F.col("extent_pct"), F.col("month"))).alias("trough"))


def amplitude_snr(prepared: DataFrame) -> DataFrame:
    """Range of calendar-month means over the mean spread within months."""
    by = years_with(prepared, MIN_MONTHS).groupBy("aoi_id", F.month("month").alias("moy")).agg(F.avg("extent_pct").alias("m"), F.stddev_samp("extent_pct").alias("s"))
    out = by.groupBy("aoi_id").agg((F.max("m") - F.min("m")).alias("amplitude"), F.avg("s").alias("spread"))
    return out.select("aoi_id", F.when(F.coalesce("spread", F.lit(0.0)) == 0, F.lit(float("inf"))).otherwise(F.col("amplitude") / F.col("spread")).alias("snr"))


def circular(months: DataFrame, value: str) -> DataFrame:
    """Concentration, inter-quartile spread (from four values) and Kuiper statistic of months on the circle."""
    t = (F.col(value) - 1) * (2 * math.pi / 12)
    centre = months.groupBy("aoi_id").agg(F.avg(F.cos(t)).alias("_c"), F.avg(F.sin(t)).alias("_s"), F.count(value).alias("n"))
    rows = months.join(centre, "aoi_id")
    off = t - F.atan2("_s", "_c")
    rows = rows.withColumn("_o", F.atan2(F.round(F.sin(off), 12) + F.lit(0.0), F.cos(off)) * (12 / (2 * math.pi)))
    u = (F.col(value) - 1) / 12.0
    i = F.row_number().over(Window.partitionBy("aoi_id").orderBy(value, "yr"))
    rows = rows.withColumn("_hi", i / F.col("n") - u).withColumn("_lo", u - (i - 1) / F.col("n"))
    out = rows.groupBy("aoi_id", "n", "_c", "_s").agg((quantile("_o", 0.75) - quantile("_o", 0.25)).alias("_iqr"), (F.max("_hi") + F.max("_lo")).alias("kuiper"))
    return out.select("aoi_id", "n", F.sqrt(F.col("_c") ** 2 + F.col("_s") ** 2).alias("concentration"), F.when(F.col("n") >= 4, F.col("_iqr")).alias("iqr_months"), "kuiper")


def _kuiper(x: np.ndarray) -> np.ndarray:
    x = np.sort(x, axis=-1)
    n = x.shape[-1]
    up = np.arange(1, n + 1) / n
    return (up - x).max(axis=-1) + (x - (up - 1 / n)).max(axis=-1)


def resampled(months: np.ndarray, n_resamples: int, seed: int, confidence: float) -> tuple[float, float, float]:
    """(low, high) of the bootstrap interval of R, and the Monte-Carlo p of uniformity on twelve months.

    Draws come from two children of SeedSequence(seed): indices first, null months second.
    """
    if n_resamples < 20:
        raise ValueError("at least 20 resamples")
    if not 0 < confidence < 1:
        raise ValueError("confidence lies between 0 and 1")
    one, two = (np.random.default_rng(s) for s in np.random.SeedSequence(seed).spawn(2))
    z = np.exp(2j * np.pi * (months - 1) / 12)
    lengths = np.abs(z[one.integers(0, len(months), size=(n_resamples, len(months)))].mean(axis=1))
    edge = 50 * (1 - confidence)
    low, high = np.percentile(lengths, [edge, 100 - edge])
    null = _kuiper(two.integers(0, 12, size=(max(n_resamples, 999), len(months))) / 12.0)
    own = _kuiper(((months - 1) / 12.0)[None, :])[0]
    return float(low), float(high), float((1 + np.count_nonzero(null >= own)) / (len(null) + 1))


def circular_summary(extremes: DataFrame, value: str, *, n_resamples: int = 200, seed: int = 0, confidence: float = 0.95) -> DataFrame:
    """``circular`` with interval and p from seeded draws, one area's few years at a time."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [resampled(np.array(m, dtype=float), n_resamples, seed, confidence) for m in b["ms"]]
            yield pd.DataFrame({"aoi_id": b["aoi_id"], "ci_low": [g[0] for g in got], "ci_high": [g[1] for g in got], "uniformity_p": [g[2] for g in got]})

    lists = extremes.groupBy("aoi_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("yr", value))), lambda x: x[value].cast("double")).alias("ms"))
    return circular(extremes, value).join(lists.mapInPandas(draw, "aoi_id int, ci_low double, ci_high double, uniformity_p double"), "aoi_id")


def regime_label(snr: Column, ci_low: Column, p: Column, n: Column) -> Column:
    return F.when((snr >= SEASONAL_SNR) & (ci_low >= STRONG_R), "seasonal").when(snr < ASEASONAL_SNR, "aseasonal").when((p >= ALPHA) & (n >= MIN_UNIFORMITY_YEARS), "aseasonal").otherwise("marginal")


def assess(prepared: DataFrame, *, n_resamples: int = 200, seed: int = 0) -> DataFrame:
    """The regime of each area, the evidence, and what boundaries it supports."""
    x = annual_extremes(prepared)
    years = x.groupBy("aoi_id").agg(F.count("*").alias("n_years"))
    enough = x.join(years.where(F.col("n_years") >= MIN_YEARS), "aoi_id", "left_semi")
    side = lambda v: circular_summary(enough, v, n_resamples=n_resamples, seed=seed).select("aoi_id", *[F.col(c).alias(f"{v}_{c}") for c in ("concentration", "ci_low", "ci_high", "iqr_months", "uniformity_p")])
    months = prepared.groupBy("aoi_id").agg(F.count_if("candidate_usable").alias("n_usable_months"))
    return conclude(months.join(years, "aoi_id", "left").join(amplitude_snr(prepared), "aoi_id", "left").join(side("peak"), "aoi_id", "left").join(side("trough"), "aoi_id", "left"))


def conclude(evidence: DataFrame) -> DataFrame:
    """Regime and gates from evidence (aoi_id, n_usable_months, n_years, snr, and the circular summaries of peaks and troughs)."""
    out = evidence.withColumn("n_years", F.coalesce("n_years", F.lit(0)))
    few = F.col("n_years") < MIN_YEARS
    out = out.withColumn("snr", F.when(few, 0.0).otherwise(F.col("snr"))).withColumn("n_timing_years", F.when(few, 0).otherwise(F.col("n_years")))
    label = F.when(few, "insufficient_record").otherwise(regime_label(F.col("snr"), F.col("peak_ci_low"), F.col("peak_uniformity_p"), F.col("n_years")))
    return gates(out.withColumn("regime", label))


def explain(regimes: DataFrame, summary: DataFrame) -> DataFrame:
    """Regimes with the counts of events (aoi_id, n_events, longest_low_spell_months, n_years_without_event; all 0 where the record is insufficient), what to do, and caveats in the order of CAVEATS."""
    s = summary.select("aoi_id", F.col("n_events").alias("n_wet_events"), "longest_low_spell_months", F.col("n_years_without_event").alias("years_without_wet_event"))
    enough = F.col("regime") != "insufficient_record"
    out = regimes.join(s, "aoi_id", "left")
    for c in ("n_wet_events", "longest_low_spell_months", "years_without_wet_event"):
        out = out.withColumn(c, F.when(enough, F.coalesce(c, F.lit(0))).otherwise(0))
    n = F.col("n_timing_years")
    unsure = (n < MIN_UNIFORMITY_YEARS) & (F.col("snr") >= SEASONAL_SNR) & (F.col("peak_ci_low") < STRONG_R) & (F.col("peak_uniformity_p") >= ALPHA)
    dry = F.col("years_without_wet_event")
    said = lambda k: F.lit(CAVEATS[k])
    notes = [
        said("scope"), said("drivers"), F.when(enough & (n < CAUTION_YEARS), said("few_timings")), F.when(enough & unsure, said("weak_test")),
        *[F.when(F.col("regime") == k, said(k)) for k in ("marginal", "aseasonal")], F.when(dry > 0, F.format_string("years without a wet event: %d of %d", dry, F.col("n_years"))),
    ]
    action = F.element_at(F.create_map(*[F.lit(x) for kv in ACTIONS.items() for x in kv]), F.col("regime"))
    return out.withColumn("recommended_action", action).withColumn("caveats", F.array_compact(F.array(*notes)))


def gates(regimes: DataFrame) -> DataFrame:
    """Whether per-year boundaries, and whether one fixed window, are supported; and the analysis route."""
    per_year = (F.col("regime") == "seasonal") & F.coalesce(F.col("trough_ci_low") >= STRONG_R, F.lit(False))
    timed = (F.col("peak_uniformity_p") < ALPHA) & (F.col("trough_uniformity_p") < ALPHA) & (F.col("peak_concentration") >= WEAK_R) & (F.col("trough_concentration") >= WEAK_R)
    fixed = (F.col("regime") == "seasonal") | ((F.col("regime") == "marginal") & F.coalesce(timed, F.lit(False)))
    route = F.when(F.col("regime") == "insufficient_record", "insufficient_record").when(per_year, "per_year_detection").when(fixed, "fixed_climatological_window").otherwise("event_characterisation")
    return regimes.withColumn("supports_per_year", per_year).withColumn("supports_fixed_window", fixed).withColumn("route", route)


def compare_rainfall(extent: DataFrame, rain: DataFrame) -> DataFrame:
    """Extent's regime beside rainfall's, with the signed lag of the peaks in (-6, 6] and what differs.

    A lag needs two regimes that have a cycle. The first rule that fits names the difference.
    """
    e = extent.select("aoi_id", F.col("regime").alias("extent_regime"), F.col("snr").alias("extent_snr"), F.col("peak_month").alias("extent_peak"))
    r = rain.select("aoi_id", F.col("regime").alias("rain_regime"), F.col("snr").alias("rain_snr"), F.col("peak_month").alias("rain_peak"))
    j = e.join(r, "aoi_id", "left")
    one, two = F.col("extent_regime"), F.col("rain_regime")
    cyclic = lambda c: c.isin("seasonal", "marginal")
    weak = lambda c: c.isin("aseasonal", "marginal")
    label = (
        F.when(two.isNull(), "no_rainfall").when(two == "insufficient_record", "rainfall_insufficient").when(one == "insufficient_record", "extent_insufficient")
        .when((one == two) & (one != "marginal"), "agree").when(cyclic(two) & weak(one) & (one != two), "extent_damped").when(cyclic(one) & weak(two) & (one != two), "extent_more_seasonal").otherwise("partial")
    )
    lag = F.when(cyclic(one) & cyclic(two), cyclic_offset(F.col("extent_peak") - F.col("rain_peak")))
    return j.withColumn("lag_months", lag).withColumn("divergence", label)


def peak_of_climatology(prepared: DataFrame) -> DataFrame:
    m = years_with(prepared, MIN_MONTHS).groupBy("aoi_id", F.month("month").alias("moy")).agg(r6(F.avg("extent_pct")).alias("m"))
    return m.groupBy("aoi_id").agg(first_max(F.col("m"), F.col("moy")).alias("peak_month"), first_min(F.col("m"), F.col("moy")).alias("trough_month"))
