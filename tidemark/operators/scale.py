"""Noise and amplitude of a record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import NOISE_FACTOR, median, quantile


def by_area():
    return Window.partitionBy("aoi_id")


def in_order():
    return by_area().orderBy("month")


def _mad_noise(rows: DataFrame, x: str) -> DataFrame:
    """1.4826 MAD of differences between neighbouring rows, over the root of 2."""
    d = rows.withColumn("_d", F.col(x) - F.lag(x).over(in_order()))
    d = d.withColumn("_c", median("_d").over(by_area()))
    return d.groupBy("aoi_id").agg((F.lit(NOISE_FACTOR) * median(F.abs(F.col("_d") - F.col("_c"))) / F.sqrt(F.lit(2.0))).alias("noise_pp"))


def robust_scale(prepared: DataFrame) -> DataFrame:
    """(aoi_id, amplitude_pp, noise_pp): q90 - q10 of usable months; noise of the deseasonalised months, between usable neighbours."""
    use = prepared.where("candidate_usable")
    amp = use.groupBy("aoi_id").agg((quantile("extent_pct", 0.9) - quantile("extent_pct", 0.1)).alias("amplitude_pp"))
    flat = use.withColumn("_x", F.col("extent_pct") - median("extent_pct").over(Window.partitionBy("aoi_id", F.month("month"))))
    return amp.join(_mad_noise(flat, "_x"), "aoi_id", "left").withColumn("noise_pp", F.coalesce("noise_pp", F.lit(0.0)))


def _persistence(rows: DataFrame, x: str) -> DataFrame:
    """Lag-1 autocorrelation kept within 0 and 0.9."""
    lagged = rows.withColumn("_p", F.lag(x).over(in_order())).where("_p is not null")
    same = F.coalesce(F.try_divide(F.covar_pop(x, "_p"), F.stddev_pop(x) * F.stddev_pop("_p")), F.lit(0.0))
    return lagged.groupBy("aoi_id").agg(F.least(F.lit(0.9), F.greatest(F.lit(0.0), same)).alias("phi"))


def noise_floor(rows: DataFrame, *, deseason: bool = True, value: str = "extent_pct") -> DataFrame:
    """(aoi_id, n, noise_pp): the noise, widened by 1 / sqrt(1 - phi) for persistent records; 0 for under three values.

    ``deseason`` takes each calendar month's median away first; events are judged without.
    """
    x = rows.where(F.col(value).isNotNull())
    x = x.withColumn("_x", F.col(value) - median(value).over(Window.partitionBy("aoi_id", F.month("month"))) if deseason else F.col(value))
    n = x.groupBy("aoi_id").agg(F.count("*").alias("n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    out = n.join(_mad_noise(x, "_x"), "aoi_id", "left").join(_persistence(x, "_x"), "aoi_id", "left")
    noise = F.when((F.col("n") < 3) | (F.col("_lo") == F.col("_hi")), 0.0).otherwise(F.coalesce(F.col("noise_pp") / F.sqrt(1 - F.coalesce("phi", F.lit(0.0))), F.lit(0.0)))
    return out.select("aoi_id", "n", noise.alias("noise_pp"))


def epsilon(amplitude: Column, noise: Column, n_valid: Column | None = None) -> Column:
    """The tolerance within which months count as equally extreme."""
    step = F.coalesce(F.try_divide(F.lit(100.0), n_valid), F.lit(0.0)) if n_valid is not None else F.lit(0.0)
    return F.when(amplitude <= 0, 0.0).otherwise(F.least(0.10 * amplitude, F.greatest(step, noise)))


def mean_water_fraction(df: DataFrame) -> DataFrame:
    return df.groupBy("aoi_id").agg((F.avg("extent_pct") / 100).alias("mean_fraction"))
