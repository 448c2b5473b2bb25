"""How wet a year or month was, against the area's other years."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import median, mid_rank_pct

#: Percentiles at which a value counts as low or high, and sizes of baselines; fixed values.
LOW, HIGH = 20.0, 80.0
MIN_BASELINE, ROLLING_MIN, ROLLING_WINDOW = 10, 5, 10


def monthly_condition(prepared: DataFrame, *, reference_start: str | None = None, reference_end: str | None = None) -> DataFrame:
    """Each month against the same calendar month of the other years: median, anomaly, percentile, size of the baseline.

    Only usable months serve, within the reference interval if one is given, and none in its
    own baseline; anomaly and percentile are null for months that aren't usable themselves.
    """
    if (reference_start is None) != (reference_end is None):
        raise ValueError("a reference interval needs both its ends")
    own = prepared.select("aoi_id", "month", "extent_pct", "quality_state", "candidate_usable", F.month("month").alias("moy"))
    ref = own.where("candidate_usable")
    if reference_start is not None:
        ref = ref.where(F.col("month").between(F.lit(reference_start).cast("date"), F.lit(reference_end).cast("date")))
    ref = ref.select("aoi_id", "moy", F.col("month").alias("_m"), F.col("extent_pct").alias("_v"))
    both = own.join(ref, ["aoi_id", "moy"], "left").withColumn("_v", F.when(F.col("_m") != F.col("month"), F.col("_v")))
    v, x = F.col("_v"), F.col("extent_pct")
    out = both.groupBy("aoi_id", "month", "extent_pct", "quality_state", "candidate_usable").agg(median(v).alias("reference_median_pct"), mid_rank_pct(F.count_if(v < x), F.count_if(v == x), F.count("_v")).alias("_p"), F.count("_v").alias("reference_n"))
    use = F.col("candidate_usable")
    return out.select("aoi_id", "month", "extent_pct", "reference_median_pct", F.when(use, x - F.col("reference_median_pct")).alias("anomaly_pct"), F.when(use, F.col("_p")).alias("condition_percentile"), "reference_n", "quality_state")


def baselines(annual: DataFrame, values: list[str], *, mode: str = "full", start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows (aoi_id, hy_year, baseline_mode, n_baseline, _ref): the years each year is measured by.

    ``annual``: aoi_id, hy_year, eligible and the values; ``_ref`` is an array of structs of the
    values. ``full`` takes all other eligible years, ``fixed`` those within start and end, ``rolling``
    the last ten eligible years before (none under five, all of them under ten).
    """
    what = F.struct("hy_year", *values)
    if mode == "rolling":
        before = Window.partitionBy("aoi_id").orderBy("hy_year").rowsBetween(Window.unboundedPreceding, -1)
        out = annual.withColumn("_all", F.collect_list(F.when(F.col("eligible"), what)).over(before))
        n = F.size("_all")
        ref = F.when(n < ROLLING_MIN, F.filter("_all", lambda r: F.lit(False))).when(n < ROLLING_WINDOW, F.col("_all")).otherwise(F.slice("_all", -ROLLING_WINDOW, ROLLING_WINDOW))
        named = F.when(n < ROLLING_MIN, "insufficient").when(n < ROLLING_WINDOW, "expanding").otherwise("rolling")
        out = out.withColumn("_ref", ref).withColumn("baseline_mode", named)
    else:
        inside = F.col("eligible")
        if mode == "fixed":
            inside = inside & F.col("hy_year").between(start, end)
        whole = annual.groupBy("aoi_id").agg(F.collect_list(F.when(inside, what)).alias("_all"))
        out = annual.join(whole, "aoi_id").withColumn("_ref", F.filter("_all", lambda r: r["hy_year"] != F.col("hy_year"))).withColumn("baseline_mode", F.lit(mode))
    return out.withColumn("n_baseline", F.size("_ref")).drop("_all")


def percentile_in(ref: str, field: str, value: Column) -> Column:
    """The mid-rank percentile of ``value`` among a field of an array of structs; null for null values."""
    own = F.filter(F.transform(ref, lambda r: r[field]), lambda v: v.isNotNull())
    less = F.size(F.filter(own, lambda v: v < value))
    same = F.size(F.filter(own, lambda v: v == value))
    return F.when(value.isNotNull(), mid_rank_pct(less, same, F.size(own)))


def _median_in(ref: str, field: str) -> Column:
    own = F.array_sort(F.filter(F.transform(ref, lambda r: r[field]), lambda v: v.isNotNull()))
    n = F.size(own)
    return F.when(n > 0, (F.get(own, F.floor((n - 1) / 2).cast("int")) + F.get(own, F.floor(n / 2).cast("int"))) / 2)


def label(p: Column) -> Column:
    return F.when(p <= LOW, "low").when(p >= HIGH, "high").when(p.isNotNull(), "typical").otherwise("insufficient_baseline")


def joint(recharge: Column, refuge: Column) -> Column:
    """The year's name by the labels of its peak and its low."""
    return (
        F.when((recharge == "high") & (refuge == "high"), "wet_persistent").when((recharge == "high") & (refuge == "low"), "recharged_then_contracting")
        .when((recharge == "low") & (refuge == "high"), "buffered_low_recharge").when((recharge == "low") & (refuge == "low"), "dry_low_refuge").otherwise("typical_or_mixed")
    )


def annual_condition(annual: DataFrame, *, mode: str = "full", start: int | None = None, end: int | None = None, noise: DataFrame | None = None, min_baseline: int = MIN_BASELINE, low_variability: DataFrame | None = None) -> DataFrame:
    """Each year's peak (recharge) and low (refuge) against its baseline.

    ``annual``: aoi_id, hy_year, peak_extent_pct, trough_extent_pct, eligible (may serve in
    baselines). Areas with fewer than ``min_baseline`` eligible years, or rolling years with fewer
    than five before them, are insufficient. With ``noise`` (aoi_id, noise_pp), low and high
    labels whose value lies within the noise of the baseline's median become ``typical_uncertain``
    in the qualified columns, and timing is of low confidence where the amplitude is under twice the noise.
    Areas of ``low_variability`` (aoi_id) get no conditions: their years differ by nothing that could be named.
    """
    x = baselines(annual, ["peak_extent_pct", "trough_extent_pct"], mode=mode, start=start, end=end)
    if mode == "rolling":
        few = F.col("baseline_mode") == "insufficient"
    else:
        inside = F.col("eligible") & F.col("hy_year").between(start, end) if mode == "fixed" else F.col("eligible")
        x = x.withColumn("_k", F.count_if(inside).over(Window.partitionBy("aoi_id")))
        few = F.col("_k") < min_baseline
    for k, name in (("peak", "recharge"), ("trough", "refuge")):
        p = percentile_in("_ref", f"{k}_extent_pct", F.col(f"{k}_extent_pct"))
        x = x.withColumn(f"{k}_percentile", p).withColumn(f"{name}_condition", F.when(few, "insufficient_baseline").otherwise(label(F.col(f"{k}_percentile"))))
    x = x.withColumn("annual_condition", F.when(few, "insufficient_baseline").otherwise(joint(F.col("recharge_condition"), F.col("refuge_condition"))))
    if low_variability is not None:
        x = x.join(low_variability.select("aoi_id").distinct().withColumn("_flat", F.lit(True)), "aoi_id", "left")
        for c in ("recharge_condition", "refuge_condition", "annual_condition"):
            x = x.withColumn(c, F.when(F.col("_flat").isNotNull(), "not_applicable_low_variability").otherwise(F.col(c)))
        x = x.drop("_flat")
    order = Window.partitionBy("aoi_id").orderBy("hy_year")
    for k in ("peak", "trough"):
        c = F.col(f"{k}_extent_pct")
        x = x.withColumn(f"{k}_change_from_previous_pct", c - F.lag(c).over(order))
    for name, what in (("dry", "dry_low_refuge"), ("wet", "wet_persistent")):
        x = x.withColumn("_hit", F.col("annual_condition") == what).withColumn("_run", F.count_if(~F.col("_hit")).over(order))
        x = x.withColumn(f"consecutive_{name}_cycles", F.count_if("_hit").over(Window.partitionBy("aoi_id", "_run").orderBy("hy_year"))).drop("_hit", "_run")
    if noise is not None:
        x = x.join(noise.select("aoi_id", "noise_pp"), "aoi_id", "left")
        for k, name in (("peak", "recharge"), ("trough", "refuge")):
            own = F.col(f"{name}_condition")
            near = F.coalesce(F.abs(F.col(f"{k}_extent_pct") - _median_in("_ref", f"{k}_extent_pct")) < F.col("noise_pp"), F.lit(False))
            x = x.withColumn(f"{name}_condition_qualified", F.when(own.isin("low", "high") & near, "typical_uncertain").otherwise(own))
        x = x.withColumn("annual_condition_qualified", F.when(few, "insufficient_baseline").otherwise(joint(F.col("recharge_condition_qualified"), F.col("refuge_condition_qualified"))))
        size = F.col("peak_extent_pct") - F.col("trough_extent_pct")
        x = x.withColumn("timing_confidence", F.when(size.isNull() | F.col("noise_pp").isNull(), "unknown").when(size < 2 * F.col("noise_pp"), "low").otherwise("high"))
    return x.drop("_ref", "_k", "noise_pp")
