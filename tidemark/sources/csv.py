"""Monthly records as CSV files: read, checked, and written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import month_floor


def _read(spark: SparkSession, path: str, date_col: str, value_col: str, area_col: str | None) -> DataFrame:
    """All columns; the date and the value must parse, or the job fails when it reads them."""
    raw = spark.read.option("header", True).csv(path)
    missing = sorted({date_col, value_col, *([area_col] if area_col else [])} - set(raw.columns))
    if missing:
        raise ValueError(f"the CSV lacks the columns {', '.join(missing)}")
    rest = [c for c in raw.columns if c not in (date_col, value_col, area_col)]
    number = F.trim(F.col(f"`{value_col}`"))
    value = F.when(number.isNull() | (number == ""), None).otherwise(F.coalesce(F.expr(f"try_cast(trim(`{value_col}`) AS double)"), F.raise_error(F.concat(F.lit("no number: "), number)).cast("double")))
    day = F.coalesce(F.expr(f"try_cast(`{date_col}` AS date)"), F.raise_error(F.concat(F.lit("no date: "), F.coalesce(F.col(f"`{date_col}`"), F.lit("null")))).cast("date"))
    area = [F.col(f"`{area_col}`").alias("aoi_id")] if area_col else []
    return raw.select(*area, month_floor(day).alias("month"), value.alias("value"), *[F.col(f"`{c}`") for c in rest])


def extent(spark: SparkSession, path: str, *, date_col: str = "date", value_col: str = "extent_pct", area_col: str | None = None) -> DataFrame:
    """Monthly extents: dates floored to months, values as numbers (empty ones null), other columns as they are. Gaps and duplicates stay; order is the reader's business."""
    return _read(spark, path, date_col, value_col, area_col).withColumnRenamed("value", value_col)


def rainfall(spark: SparkSession, path: str, *, date_col: str = "date", value_col: str = "rainfall_mm", area_col: str | None = None) -> DataFrame:
    """Monthly rainfall, as ``extent``; a month given twice is an error, as rainfall has no rule that picks one."""
    rows = _read(spark, path, date_col, value_col, area_col)
    keys = ["month", *(["aoi_id"] if area_col else [])]
    once = F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("rainfall has the month twice: "), F.col("month").cast("string"))).cast("double")).otherwise(F.first("value"))
    return rows.groupBy(*keys).agg(once.alias("rainfall_mm"))


def write_reports(path: str, **tables: DataFrame) -> None:
    """Each table (monthly, hydro_years, wet_event, low_spells) as CSV with a header in a folder of its name, one folder below it an area.

    Spark's committer makes a table's files visible together or not at all.
    """
    unknown = set(tables) - {"monthly", "hydro_years", "wet_event", "low_spells"}
    if unknown:
        raise ValueError(f"no report {', '.join(sorted(unknown))}")
    for name, df in tables.items():
        df.repartition("aoi_id").write.mode("overwrite").option("header", True).partitionBy("aoi_id").csv(f"{path}/{name}")
