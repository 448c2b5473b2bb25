"""The driver's tables read as the domain's: areas, monthly counts, pixels, rainfall."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_floor


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _items(spark: SparkSession, sf_dir: str, by: str) -> DataFrame:
    """Line items with the area of their supplier: its nation, or its region."""
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate")
    area = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    if by == "region":
        n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
        area = area.join(n, area["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.col("n_regionkey").alias("s_nationkey"))
    return li.join(area, li["l_suppkey"] == area["s_suppkey"]).withColumn("aoi_id", F.col("s_nationkey").cast("int")).withColumn("month", month_floor("l_shipdate"))


def monthly_counts(spark: SparkSession, sf_dir: str, *, by: str = "region", seasonal: bool = True, floods: bool = False) -> DataFrame:
    """(aoi_id, month, n_aoi, n_valid, n_water): one row per area and month with items.

    Items are pixels; a flag other than N makes one valid. With ``seasonal``, a valid pixel is
    water on more order numbers the nearer the month is to February; else on flag R. With ``floods``, it is
    water on most order numbers in two months out of nineteen, and on few in the others.
    """
    k = F.pmod(F.month("month") - 2, F.lit(12))
    wet = (F.col("l_orderkey") % 12 >= 2 * F.least(k, 12 - k)) if seasonal else (F.col("l_returnflag") == "R")
    if floods:
        wet = F.col("l_orderkey") % 10 < F.when((F.year("month") * 12 + F.month("month")) % 19 < 2, 9).otherwise(1)
    valid = F.col("l_returnflag") != "N"
    return _items(spark, sf_dir, by).groupBy("aoi_id", "month").agg(F.count("*").alias("n_aoi"), F.count_if(valid).alias("n_valid"), F.count_if(valid & wet).alias("n_water"))


#: Rows of a grid, and areas on it; its columns grow with the parts.
GRID_ROWS, AREAS = 16, 5


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aoi_id, month, obs_ts, scene_id, part, y, x, raw): raw water-observation codes on grids that grow with the parts."""
    li = table(spark, sf_dir, "lineitem")
    raw = F.when(F.col("l_returnflag") == "R", 128).when(F.col("l_returnflag") == "A", 0).when(F.col("l_linenumber") % 2 == 1, 1).otherwise(64)
    return li.select((F.col("l_suppkey") % AREAS).cast("int").alias("aoi_id"), month_floor("l_shipdate").alias("month"), F.col("l_shipdate").alias("obs_ts"), F.col("l_orderkey").alias("scene_id"), F.col("l_linenumber").alias("part"), (F.col("l_partkey") % GRID_ROWS).cast("int").alias("y"), F.expr(f"cast(l_partkey div {GRID_ROWS} as int)").alias("x"), raw.alias("raw"))


def aoi_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aoi_id, y, x): the cells inside each area: those of a part, but for every eighth diagonal."""
    p = table(spark, sf_dir, "part").select((F.col("p_partkey") % GRID_ROWS).cast("int").alias("y"), F.expr(f"cast(p_partkey div {GRID_ROWS} as int)").alias("x"))
    return p.withColumn("aoi_id", F.explode(F.sequence(F.lit(0), F.lit(AREAS - 1)))).where("(y + x + aoi_id) % 8 <> 0").select("aoi_id", "y", "x").distinct()


def rainfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(aoi_id, month, rainfall_mm): order totals of each region's customers."""
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, c["c_nationkey"] == n["n_nationkey"])
    return j.groupBy(F.col("n_regionkey").cast("int").alias("aoi_id"), month_floor("o_orderdate").alias("month")).agg(F.round(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double") / 1000, 3).alias("rainfall_mm"))
