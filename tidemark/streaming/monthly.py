"""Pixel counts of a stream of observations, by day and then by month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import pixels as px


def daily_counts(observations: DataFrame, *, late: str = "40 days") -> DataFrame:
    """(aoi_id, month, day, n_water, n_valid, n_seen) of streamed (aoi_id, obs_ts timestamp, raw); a day is given out once no observation of it can still come.

    Observations later than ``late`` behind the newest are left aside, which bounds the state to the days that are open.
    """
    code = px.decode(F.col("raw"))
    days = observations.withWatermark("obs_ts", late).groupBy("aoi_id", F.window("obs_ts", "1 day").alias("w"))
    out = days.agg(F.count_if(code == px.WATER).alias("n_water"), F.count_if(code.isin(px.WATER, px.DRY)).alias("n_valid"), F.count("*").alias("n_seen"))
    return out.select("aoi_id", F.trunc("w.start", "MM").alias("month"), F.to_date("w.start").alias("day"), "n_water", "n_valid", "n_seen")


def add_up(days: DataFrame) -> DataFrame:
    """The stored daily rows of ``daily_counts`` as months."""
    return days.groupBy("aoi_id", "month").agg(*[F.sum(c).alias(c) for c in ("n_water", "n_valid", "n_seen")])
