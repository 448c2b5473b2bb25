"""How well a seasonal pattern holds when its years are drawn anew: a bootstrap over whole years.

A harmonic fit on complete years needs six sums of each year. So a replicate is not a record but a list of how
often each year was drawn, and its fit an aggregate over (area, replicate); nothing is resampled row by row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import quantile
from ..functions.lineage import cut
from .season import MIN_SUPPORT, MIN_YEARS, pattern, years_with

_T = 2 * math.pi / 12
_TINY = 2.2250738585072014e-308


def year_sums(prepared: DataFrame) -> DataFrame:
    """(aoi_id, yr, i, n, base, y, yy, s1, c1, s2, c2): each complete year's sums, its place among the area's n years, and the area's mean, taken from all values."""
    full = years_with(prepared, 12)
    mean = full.groupBy("aoi_id").agg(F.avg("extent_pct").alias("base"))
    t, v = (F.month("month") - 1) * _T, F.col("extent_pct") - F.col("base")
    waves = [F.sum(v * f(h * t)).alias(f"{c}{h}") for h in (1, 2) for c, f in (("s", F.sin), ("c", F.cos))]
    sums = full.join(mean, "aoi_id").groupBy("aoi_id", "yr", "base").agg(F.sum(v).alias("y"), F.sum(v * v).alias("yy"), *waves)
    by = Window.partitionBy("aoi_id")
    return sums.withColumn("i", F.row_number().over(by.orderBy("yr")) - 1).withColumn("n", F.count("*").over(by).cast("int"))


def seeded_draws(counts: DataFrame, *, n_bootstrap: int = 200, seed: int = 0) -> DataFrame:
    """(n, replicate, i, k): how often each replicate of n years draws year i, for each distinct n of ``counts``.

    Each number of years has its own generator from the same seed, which draws one replicate after the other, so areas with as many
    years share their draws. Rows: numbers of years that occur, times replicates, times years.
    """

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for n in b["n"]:
                one = np.random.default_rng(seed)
                times = np.stack([np.bincount(one.choice(n, n, replace=True), minlength=n) for _ in range(n_bootstrap)])
                r, i = np.nonzero(times)
                yield pd.DataFrame({"n": np.int32(n), "replicate": r.astype(np.int32), "i": i.astype(np.int32), "k": times[r, i].astype(np.int32)})

    return counts.select("n").distinct().mapInPandas(draw, "n int, replicate int, i int, k int")


def _fits(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, the chosen order and the twelve fitted values from summed years; the best order by AICc, the lower on ties."""
    w = lambda c: F.sum(F.col("k") * F.col(c))
    x = sums.groupBy(*keys).agg((12 * F.sum("k")).cast("double").alias("m"), F.first("base").alias("base"), *[w(c).alias(c) for c in ("y", "yy", "s1", "c1", "s2", "c2")])
    m = F.col("m")
    power = lambda h: 2 * (F.col(f"s{h}") ** 2 + F.col(f"c{h}") ** 2) / m
    rss = [F.col("yy") - F.col("y") ** 2 / m]
    rss += [rss[0] - power(1), rss[0] - power(1) - power(2)]
    score = [m * F.log(F.greatest(F.lit(_TINY), r) / m) + 2 * k + F.lit(2.0 * k * (k + 1)) / (m - k - 1) for r, k in zip(rss, (1, 3, 5), strict=True)]
    x = x.select(*keys, "m", "base", "y", "s1", "c1", "s2", "c2", *[s.alias(f"a{o}") for o, s in enumerate(score)])
    order = F.when((F.col("a0") <= F.col("a1")) & (F.col("a0") <= F.col("a2")), 0).when(F.col("a1") <= F.col("a2"), 1).otherwise(2)
    x = x.withColumn("fit_order", order)

    def value(moy: int) -> Column:
        wave = lambda h: F.when(F.col("fit_order") >= h, 2 / m * (F.col(f"s{h}") * math.sin(h * _T * (moy - 1)) + F.col(f"c{h}") * math.cos(h * _T * (moy - 1)))).otherwise(0.0)
        return F.col("base") + F.col("y") / m + wave(1) + wave(2)

    return x.select(*keys, "fit_order", F.array(*[value(k) for k in range(1, 13)]).alias("v"))


def _peaks(v: Column, sign: int) -> Column:
    """The months of local extremes of a circular curve of twelve values, the strongest first, of equals the earlier."""
    at = lambda i: F.get(v, F.pmod(i, F.lit(12)).cast("int"))
    lead = (lambda a, b: a > b) if sign > 0 else (lambda a, b: a < b)
    even = (lambda a, b: a >= b) if sign > 0 else (lambda a, b: a <= b)
    months = F.filter(F.sequence(F.lit(0), F.lit(11)), lambda i: lead(at(i), at(i - 1)) & even(at(i), at(i + 1)))
    ranked = F.array_sort(F.transform(months, lambda i: F.struct((-sign * at(i)).alias("k"), (i + 1).alias("moy"))))
    return F.transform(ranked, lambda x: x["moy"])


def _label(tolerance_pct: float) -> Column:
    reach = F.array_max("v") - F.array_min("v")
    return F.when(reach <= tolerance_pct, "low_variability").when(F.col("fit_order") == 0, "weak_or_irregular").when(F.size(_peaks(F.col("v"), 1)) == 1, "unimodal_annual").otherwise("bimodal_or_complex")


def _first_place(v: Column, best: Column) -> Column:
    return F.array_position(v, best).cast("int")


def _spread(rows: DataFrame, month: str) -> DataFrame:
    """(aoi_id, spread in months): the inter-quartile range of months around their circular mean."""
    t = (F.col(month) - 1) * _T
    mean = rows.groupBy("aoi_id").agg(F.avg(F.cos(t)).alias("_c"), F.avg(F.sin(t)).alias("_s"))
    off = rows.join(mean, "aoi_id").withColumn("_d", t - F.atan2("_s", "_c"))
    off = off.withColumn("_o", F.atan2(F.round(F.sin("_d"), 12) + F.lit(0.0), F.cos("_d")) / _T)
    return off.groupBy("aoi_id").agg((quantile("_o", 0.75) - quantile("_o", 0.25)).alias(f"{month}_iqr_months"))


def seasonal_pattern(prepared: DataFrame, *, draws: DataFrame | None = None, n_bootstrap: int = 200, seed: int = 0, tolerance_pct: float = 1.0) -> DataFrame:
    """The seasonal pattern of each area with its support: (aoi_id, pattern, peak_month, trough_month, secondary_peak_month, secondary_trough_month,
    strength, bootstrap_support, peak_phase_iqr_months, trough_phase_iqr_months, n_complete_years).

    The support is the share of replicates with the same pattern; under ``MIN_SUPPORT`` a pattern is ``weak_or_irregular``, unless the
    record hardly varies. ``draws`` (n, replicate, i, k) are seeded ones if None. Areas with fewer than ``MIN_YEARS`` complete
    years have no pattern and no support.
    """
    years = year_sums(prepared)
    years = cut(years.where(F.col("n") >= MIN_YEARS))
    own = _fits(years.withColumn("k", F.lit(1)), ["aoi_id"]).select("aoi_id", _label(tolerance_pct).alias("_own"), _peaks(F.col("v"), 1).alias("_max"), _peaks(F.col("v"), -1).alias("_min"))
    draws = seeded_draws(years, n_bootstrap=n_bootstrap, seed=seed) if draws is None else draws
    drawn = years.join(draws.select("n", "replicate", "i", "k"), ["n", "i"])
    v = F.col("v")
    boot = _fits(drawn, ["aoi_id", "replicate"]).select("aoi_id", _label(tolerance_pct).alias("_label"), _first_place(v, F.array_max(v)).alias("peak"), _first_place(v, F.array_min(v)).alias("trough"))
    boot = cut(boot)
    held = boot.join(own.select("aoi_id", "_own"), "aoi_id").groupBy("aoi_id").agg((F.count_if(F.col("_label") == F.col("_own")) / F.count("*")).alias("bootstrap_support"))
    out = pattern(prepared, tolerance_pct=tolerance_pct).join(own, "aoi_id", "left").join(held, "aoi_id", "left")
    out = out.join(_spread(boot, "peak"), "aoi_id", "left").join(_spread(boot, "trough"), "aoi_id", "left")
    support = F.coalesce("bootstrap_support", F.lit(0.0))
    weak = ~F.col("pattern").isin("low_variability", "insufficient_record") & (support < MIN_SUPPORT)
    return out.select(
        "aoi_id", F.when(weak, "weak_or_irregular").otherwise(F.col("pattern")).alias("pattern"), "peak_month", "trough_month", F.get("_max", F.lit(1)).alias("secondary_peak_month"), F.get("_min", F.lit(1)).alias("secondary_trough_month"),
        "strength", support.alias("bootstrap_support"), F.col("peak_iqr_months").alias("peak_phase_iqr_months"), F.col("trough_iqr_months").alias("trough_phase_iqr_months"), "n_complete_years",
    )
