"""Phases within a hydrological year, by crossings of the calendar months' medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import median
from ..functions.lineage import cut

#: What confidence starts from, and what is added or taken off; fixed values.
BASE, CONFIRMED, HALF_LOST, RAW_PEAK, UNUSABLE = 0.55, 0.20, 0.10, 0.10, -0.25


def levels(prepared: DataFrame) -> DataFrame:
    """The months with ``level``, the median of the usable records of their calendar month, and ``slope`` from the month before."""
    level = median(F.when(F.col("candidate_usable"), F.col("extent_pct"))).over(Window.partitionBy("aoi_id", F.month("month")))
    order = Window.partitionBy("aoi_id").orderBy("month")
    first = F.row_number().over(order) == 1
    v = F.col("extent_pct")
    return prepared.withColumn("level", level).withColumn("slope", F.when(first, v - v).otherwise(v - F.lag(v).over(order)))


def crossings(prepared: DataFrame, years: DataFrame, noise: DataFrame) -> DataFrame:
    """Each year's cuts: wet_start, half_start, dry_start, and whether the half loss was seen.

    Wet starts at the first month up to the peak that is at or over its level and doesn't fall by more than the noise (else at the peak); half_start is the first
    month after the peak at or under its level plus half of the peak's height over its level; dry starts at the first month after that at or under its level (else at the end).
    """
    key = ["aoi_id", "hy_year"]
    rows = levels(prepared)
    y = years.where("status IN ('complete', 'partial') AND hy_start IS NOT NULL AND hy_end IS NOT NULL AND peak_month IS NOT NULL").join(noise.select("aoi_id", "noise_pp"), "aoi_id", "left")
    y = y.select(*key, "hy_start", "hy_end", "peak_month", "peak_extent_pct", "trough_extent_pct", "noise_pp", "status", "boundary_status", "peak_selection_status")
    inside = rows.select("aoi_id", "month", "extent_pct", "candidate_usable", "level", "slope").join(y, "aoi_id").where("month BETWEEN hy_start AND hy_end")
    at_peak = F.max(F.when(F.col("month") == F.col("peak_month"), F.col("level"))).over(Window.partitionBy(*key))
    height = F.col("peak_extent_pct") - at_peak
    fall = F.col("peak_extent_pct") - F.col("trough_extent_pct")
    inside = inside.withColumn("_h", F.when(height > 0, height).when(fall > 0, fall).otherwise(F.greatest(F.col("noise_pp"), F.lit(1e-6))))
    seen = F.col("candidate_usable") & F.col("level").isNotNull()
    v, m = F.col("extent_pct"), F.col("month")
    first = lambda c: F.min(F.when(seen & c, m))
    up = first((m <= F.col("peak_month")) & (v >= F.col("level")) & (F.col("slope") >= -F.col("noise_pp")))
    half = first((m > F.col("peak_month")) & (v <= F.col("level") + 0.5 * F.col("_h")))
    inside = inside.withColumn("_half", half.over(Window.partitionBy(*key)))
    inside = inside.withColumn("half_start", F.coalesce("_half", F.add_months("peak_month", 1)))
    out = inside.groupBy(*key, "hy_start", "hy_end", "peak_month", "status", "boundary_status", "peak_selection_status", "half_start", F.col("_half").isNotNull().alias("half_seen")).agg(
        up.alias("_up"), first((m > F.col("half_start")) & (v <= F.col("level"))).alias("_down"))
    return out.withColumn("wet_start", F.coalesce("_up", "peak_month")).withColumn("dry_start", F.coalesce("_down", "hy_end")).drop("_up", "_down")


def assign(prepared: DataFrame, years: DataFrame, noise: DataFrame, *, boundary_basis: str = "robust_extrema") -> DataFrame:
    """Every month's phase: recovery, wet, recession, dry within the years that have a peak; unspecified elsewhere, with a status that says why."""
    cuts = cut(crossings(prepared, years, noise))
    rest = years.where("status <> 'complete' AND hy_start IS NOT NULL AND hy_end IS NOT NULL").select(F.col("aoi_id").alias("_b"), F.col("hy_year").alias("_open"), F.col("hy_start").alias("_s"), F.col("hy_end").alias("_e"))
    own = prepared.select("aoi_id", "month", "extent_pct", "candidate_usable")
    j = own.join(cuts.withColumnRenamed("aoi_id", "_a"), (F.col("aoi_id") == F.col("_a")) & F.col("month").between(F.col("hy_start"), F.col("hy_end")), "left")
    j = j.join(rest, (F.col("aoi_id") == F.col("_b")) & F.col("month").between(F.col("_s"), F.col("_e")), "left")
    m, cycle = F.col("month"), F.col("hy_year").isNotNull()
    phase = F.when(~cycle, "unspecified").when(m == F.col("hy_end"), "dry").when(m < F.col("wet_start"), "recovery").when(m < F.col("half_start"), "wet").when(m < F.col("dry_start"), "recession").otherwise("dry")
    status = F.when(cycle, F.when(~F.col("candidate_usable"), "unusable").when(F.col("status") == "complete", "ok").otherwise("provisional")).when(F.col("_open").isNotNull(), "unresolved_cycle").otherwise("outside_cycle")
    plus = lambda c, x: F.when(F.coalesce(c, F.lit(False)), x).otherwise(0.0)
    score: Column = F.lit(BASE) + plus(F.col("boundary_status") == "confirmed", CONFIRMED) + plus(F.col("half_seen"), HALF_LOST) + plus(F.col("peak_selection_status") == "raw", RAW_PEAK) + plus(~F.col("candidate_usable"), UNUSABLE)
    return j.select("aoi_id", "month", F.coalesce("hy_year", "_open").alias("hy_year"), phase.alias("phase"), status.alias("phase_status"), F.when(cycle, F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).alias("phase_confidence"), F.lit("rule_based").alias("phase_method"), F.lit(boundary_basis).alias("boundary_basis"), "extent_pct", "candidate_usable")
