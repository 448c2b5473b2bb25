"""Wet events and low-extent spells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_max, median, quantile, r6
from ..functions.lineage import cut
from .scale import in_order, noise_floor

DEGENERATE = 0.01


def thresholds(prepared: DataFrame, *, mode: str = "noise", enter_k: float = 3, exit_k: float = 1, low_k: float = 1, start_quantile: float = 0.75, end_quantile: float = 0.5, low_quantile: float = 0.2) -> DataFrame:
    """(aoi_id, baseline, enter_t, exit_t, low_t, noise_pp, threshold_mode).

    Noise mode: the median and k noises above or below it. Where noise is at most a hundredth of
    q90 - q10, and in quantile mode: the quantiles. A low quantile at the baseline drops to the largest value below it.
    """
    if mode not in ("noise", "quantile"):
        raise ValueError(f"no threshold mode {mode}")
    if exit_k > enter_k or end_quantile > start_quantile:
        raise ValueError("events must end at or below where they begin")
    use = prepared.where("candidate_usable").select("aoi_id", "month", "extent_pct")
    q = use.groupBy("aoi_id").agg(median("extent_pct").alias("baseline"), *[quantile("extent_pct", v).alias(n) for n, v in (("q_in", start_quantile), ("q_out", end_quantile), ("q_low", low_quantile))], (quantile("extent_pct", 0.9) - quantile("extent_pct", 0.1)).alias("spread"))
    below = use.join(q.select("aoi_id", "baseline"), "aoi_id").where("extent_pct < baseline").groupBy("aoi_id").agg(F.max("extent_pct").alias("below"))
    all_ = q.join(noise_floor(use, deseason=False).select("aoi_id", "noise_pp"), "aoi_id").join(below, "aoi_id", "left")
    flat = F.col("noise_pp") <= DEGENERATE * F.col("spread")
    by_quantile = flat if mode == "noise" else F.lit(True)
    low = F.when(F.col("q_low") >= F.col("baseline"), F.coalesce("below", "q_low")).otherwise(F.col("q_low"))
    name = F.when(flat, "quantile_fallback").otherwise("noise") if mode == "noise" else F.lit("quantile")
    at = lambda quant, sign, k: F.when(by_quantile, quant).otherwise(F.col("baseline") + sign * k * F.col("noise_pp"))
    return all_.select("aoi_id", "baseline", at(F.col("q_in"), 1, enter_k).alias("enter_t"), at(F.col("q_out"), 1, exit_k).alias("exit_t"), at(low, -1, low_k).alias("low_t"), "noise_pp", name.alias("threshold_mode"))


def states(prepared: DataFrame, limits: DataFrame) -> DataFrame:
    """Each month with ``wet`` (hysteresis: opens above enter_t, holds above exit_t, closed by unseen months) and ``low``."""
    rows = prepared.join(limits, "aoi_id").withColumn("v", F.when(F.col("candidate_usable"), F.col("extent_pct")))
    decided = F.when(F.col("v").isNull(), False).when(F.col("v") > F.col("enter_t"), True).when(F.col("v") <= F.col("exit_t"), False)
    held = F.last(decided, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("wet", F.coalesce(held, F.lit(False))).withColumn("low", F.coalesce(F.col("v") <= F.col("low_t"), F.lit(False))).withColumn("pos", F.row_number().over(in_order()))


def events(marked: DataFrame, *, min_months: int = 1, min_separation: int = 1) -> DataFrame:
    """Wet runs, those nearer than ``min_separation`` unwet months merged, then those too short dropped, numbered from 1."""
    block = marked.where("wet").withColumn("_b", F.col("pos") - F.row_number().over(in_order())).groupBy("aoi_id", "_b").agg(F.min("pos").alias("p0"), F.max("pos").alias("p1"))
    order = Window.partitionBy("aoi_id").orderBy("p0")
    apart = F.coalesce((F.col("p0") - F.lag("p1").over(order) - 1 >= min_separation).cast("int"), F.lit(1))
    merged = block.withColumn("_g", F.sum(apart).over(order)).groupBy("aoi_id", "_g").agg(F.min("p0").alias("p0"), F.max("p1").alias("p1"))
    inside = marked.join(merged.where(F.col("p1") - F.col("p0") + 1 >= min_months), "aoi_id").where("pos BETWEEN p0 AND p1")
    out = inside.groupBy("aoi_id", "p0", "p1").agg(
        F.min("month").alias("start_month"), F.max("month").alias("end_month"), F.first("baseline").alias("baseline"), first_max(F.col("v"), F.col("month")).alias("peak_month"),
        F.max("v").alias("peak"), F.avg("v").alias("mean"), F.sum(F.greatest(F.coalesce(F.col("v") - F.col("exit_t"), F.lit(0.0)), F.lit(0.0))).alias("mag"),
    )
    n = F.row_number().over(Window.partitionBy("aoi_id").orderBy("p0"))
    return out.select("aoi_id", n.alias("event_id"), "start_month", "end_month", (F.col("p1") - F.col("p0") + 1).alias("duration_months"), r6("baseline").alias("baseline_extent_pct"), "peak_month", r6("peak").alias("peak_extent_pct"), r6("mean").alias("mean_extent_pct"), r6("mag").alias("magnitude_pp_months"))


def low_spells(marked: DataFrame, *, min_months: int = 2) -> DataFrame:
    run = marked.where("low").withColumn("_b", F.col("pos") - F.row_number().over(in_order()))
    out = run.groupBy("aoi_id", "_b").agg(F.min("month").alias("start_month"), F.max("month").alias("end_month"), F.count("*").cast("int").alias("duration_months"), r6(F.first("baseline")).alias("baseline_extent_pct"), r6(F.min("v")).alias("min_extent_pct")).where(F.col("duration_months") >= min_months)
    return out.select("aoi_id", F.row_number().over(Window.partitionBy("aoi_id").orderBy("start_month")).alias("low_spell_id"), "start_month", "end_month", "duration_months", "baseline_extent_pct", "min_extent_pct")


def years_without_event(marked: DataFrame, found: DataFrame) -> DataFrame:
    years = marked.select("aoi_id", F.year("month").alias("yr")).distinct()
    with_ = found.select("aoi_id", F.explode(F.sequence("start_month", "end_month", F.expr("interval 1 month"))).alias("m")).select("aoi_id", F.year("m").alias("yr"))
    return years.join(with_, ["aoi_id", "yr"], "left_anti")


def summary(marked: DataFrame, found: DataFrame, spells: DataFrame) -> DataFrame:
    """One row per area: how many events and spells, how long, how far apart, and the years without an event."""
    base = marked.groupBy("aoi_id").agg(F.count("*").alias("n_months"), F.count("v").alias("n_observed"), r6(F.try_divide(F.lit(100.0) * F.count_if("low"), F.count("v"))).alias("pct_months_low"), r6(F.first("baseline")).alias("baseline_extent_pct"), F.first("threshold_mode").alias("threshold_mode"))
    gap = found.withColumn("_gap", F.datediff("start_month", F.lag("start_month").over(Window.partitionBy("aoi_id").orderBy("event_id"))) / F.lit(30.44))
    ev = gap.groupBy("aoi_id").agg(F.count("*").alias("n_events"), F.max("duration_months").alias("longest_event_months"), r6(median("_gap")).alias("median_gap_months"), r6(F.sum("magnitude_pp_months")).alias("total_magnitude"))
    sp = spells.groupBy("aoi_id").agg(F.count("*").alias("n_low_spells"), F.max("duration_months").alias("longest_low_spell_months"))
    dry = years_without_event(marked, found).groupBy("aoi_id").agg(F.count("*").alias("n_years_without_event"))
    out = base.join(ev, "aoi_id", "left").join(sp, "aoi_id", "left").join(dry, "aoi_id", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_events", "n_low_spells", "longest_low_spell_months", "n_years_without_event")]
    return out.select("aoi_id", "n_months", "n_observed", "pct_months_low", "baseline_extent_pct", "threshold_mode", "longest_event_months", "median_gap_months", "total_magnitude", *zero)


def extract(prepared: DataFrame, *, mode: str = "noise", min_event_months: int = 1, min_separation_months: int = 1, min_low_months: int = 2, **limits) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(events, low spells, summary, marked months) of prepared records."""
    # months, events and spells are read by several steps
    marked = cut(states(prepared, thresholds(prepared, mode=mode, **limits)))
    found = cut(events(marked, min_months=min_event_months, min_separation=min_separation_months))
    spells = cut(low_spells(marked, min_months=min_low_months))
    return found, spells, summary(marked, found, spells), marked
