"""Found boundaries against known ones, and series against series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import correlation, first_max, first_min, month_number, quantile

#: Months that an event without a match counts as.
PENALTY = 12.0


def month_delta(left: Column | str, right: Column | str) -> Column:
    """Whole calendar months from right to left."""
    return month_number(left) - month_number(right)


def align(truth: DataFrame, actual: DataFrame) -> DataFrame:
    """truth(aoi_id, event_id, truth_month, interval_start, interval_end) with the nearest actual_month in (start, end], the earliest of equals."""
    a = actual.where("actual_month IS NOT NULL").select(F.col("aoi_id").alias("_a"), "actual_month")
    j = truth.join(a, (F.col("aoi_id") == F.col("_a")) & (F.col("actual_month") > F.col("interval_start")) & (F.col("actual_month") <= F.col("interval_end")), "left")
    far = F.abs(F.datediff("actual_month", "truth_month"))
    return j.groupBy("aoi_id", "event_id", "truth_month").agg(first_min(far, F.col("actual_month")).alias("actual_month"))


def timing(aligned: DataFrame) -> DataFrame:
    """Per area how many events were met, and by how many months they were missed; unmet ones count as twelve."""
    d = month_delta("actual_month", "truth_month").cast("double")
    x = aligned.where("truth_month IS NOT NULL").withColumn("_d", d).withColumn("_a", F.abs("_d")).withColumn("_p", F.coalesce("_a", F.lit(PENALTY)))
    share = lambda c: c / F.count("*")
    return x.groupBy("aoi_id").agg(
        F.count("*").alias("n_eligible"), F.count("_d").alias("n_resolved"), share(F.count("_d")).alias("coverage"), share(F.count_if(F.col("_a") <= 1)).alias("within_1_month"), F.avg("_d").alias("signed_bias_months"), F.avg("_a").alias("resolved_mae_months"),
        F.avg("_p").alias("total_mae_months"), quantile("_p", 0.5).alias("median_abs_error_months"), quantile("_p", 0.9).alias("p90_abs_error_months"), F.max("_p").alias("max_abs_error_months"),
    )


def compare_series(native: DataFrame, coarse: DataFrame) -> DataFrame:
    """Per area how two monthly series agree where both have a value: correlation, differences, and whether the extremes fall on the same month."""
    n, c = (x.where("extent_pct IS NOT NULL").select("aoi_id", "month", F.col("extent_pct").alias(k)) for x, k in ((native, "n"), (coarse, "c")))
    j = n.join(c, ["aoi_id", "month"])
    out = j.groupBy("aoi_id").agg(
        F.count("*").alias("n_months_compared"), correlation("n", "c").alias("correlation"), F.max(F.abs(F.col("n") - F.col("c"))).alias("max_abs_diff_extent_pct"), F.avg(F.abs(F.col("n") - F.col("c"))).alias("mean_abs_diff_extent_pct"),
        *[f(F.col(k), F.col("month")).alias(f"{name}_{what}_month") for k, name in (("n", "native"), ("c", "coarse")) for f, what in ((first_max, "wet"), (first_min, "dry"))],
    )
    return out.withColumn("same_wet_month", F.col("native_wet_month") == F.col("coarse_wet_month")).withColumn("same_dry_month", F.col("native_dry_month") == F.col("coarse_dry_month"))
