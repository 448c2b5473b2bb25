"""Monthly counts that are built once: per request, area and year, checked whenever they are read.

A request is named by a digest of all that shapes its numbers. What a request still lacks is an anti-join of wanted and sound
(area, year) pairs, so a second run reads no pixels, and a damaged part costs its own areas and year only. Rows lie in
parts by request, year and bucket of areas, not one file for each area and year; parts are replaced whole.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import ratio_pct
from ..functions.lineage import cut

COUNTS = ["n_water", "n_valid", "n_invalid", "n_aoi"]
PAIR = ["aoi_id", "yr"]
_ROW = f"aoi_id int, month date, {', '.join(f'{c} long' for c in COUNTS)}, digest string, bucket int, request string, yr int"


def request_digest(**fields) -> str:
    """A request's name: SHA-256 of its fields in order of their names. Fields that are None are as if not given."""
    given = {k: v for k, v in fields.items() if v is not None}
    return hashlib.sha256(json.dumps(given, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def area_digests(cells: DataFrame) -> DataFrame:
    """(aoi_id, area_digest): a digest of each area's set of cells, whatever their order; sums of hashes, so partial sums come first."""
    wide = lambda *c: F.sum(F.xxhash64(*c).cast("decimal(38,0)")).cast("string")
    seen = cells.select("aoi_id", "y", "x").distinct().groupBy("aoi_id").agg(F.count("*").cast("string").alias("n"), wide("y", "x").alias("a"), wide("x", "y", F.lit(1)).alias("b"))
    return seen.select("aoi_id", F.sha2(F.concat_ws(",", "n", "a", "b"), 256).alias("area_digest"))


def _digest() -> Column:
    """Of an area's months of one year; at most twelve rows."""
    line = F.concat_ws(",", F.col("month").cast("string"), *[F.col(c).cast("string") for c in COUNTS])
    return F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ";"), 256)


class ExtentCache:
    """Monthly counts at ``root``, a folder that driver and executors share. One writer at a time for a request."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, f"{root.rstrip('/')}/parts", buckets

    def _rows(self, request: str) -> DataFrame:
        """The request's rows as they lie there; files that can't be read hold none."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return self.spark.createDataFrame([], _ROW)
        return self.spark.read.schema(_ROW).option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true").parquet(self.path).where(F.col("request") == request)

    def completed(self, request: str) -> DataFrame:
        """(aoi_id, yr, n_months): the sound pairs: no month twice, counts that add up, and the digest that was written with them."""
        sound = (F.min("n_water") >= 0) & F.bool_and(F.col("n_water") <= F.col("n_valid")) & F.bool_and(F.col("n_valid") + F.col("n_invalid") == F.col("n_aoi"))
        ok = sound & (F.countDistinct("month") == F.count("*")) & (F.min("digest") == F.max("digest")) & (F.min("digest") == _digest())
        held = self._rows(request).groupBy(*PAIR).agg(F.count("*").alias("n_months"), ok.alias("_ok"))
        return held.where("_ok").select(*PAIR, "n_months")

    def missing(self, request: str, wanted: DataFrame) -> DataFrame:
        """The pairs of ``wanted`` (aoi_id, yr, n_months) that aren't there soundly and with as many months."""
        return wanted.join(self.completed(request), [*PAIR, "n_months"], "left_anti")

    def _write(self, request: str, built: DataFrame) -> None:
        """Put pairs into their parts; what else those parts hold soundly stays."""
        bucket = F.pmod(F.xxhash64("aoi_id"), F.lit(self.buckets)).cast("int")
        digests = built.groupBy(*PAIR).agg(_digest().alias("digest"))
        new = built.join(digests, PAIR).select("aoi_id", "month", *COUNTS, "digest", bucket.alias("bucket"), F.lit(request).alias("request"), "yr")
        parts = new.select("bucket", "yr").distinct()
        stay = self._rows(request).join(self.completed(request), PAIR, "left_semi").join(new.select(*PAIR).distinct(), PAIR, "left_anti").join(parts, ["bucket", "yr"], "left_semi")
        whole = cut(stay.unionByName(new))  # what is replaced is read no more
        whole.repartition("yr", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("request", "yr", "bucket").parquet(self.path)

    def load(self, request: str, wanted: DataFrame, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(aoi_id, month, counts, extent_pct, invalid_pct) of all wanted pairs, or an error: never some of them.

        ``build`` gets the missing pairs (aoi_id, yr) and gives their monthly counts; where none is missing it isn't called.
        """
        wanted = cut(wanted.select("aoi_id", F.col("yr").cast("int").alias("yr"), F.col("n_months").cast("long").alias("n_months")).distinct())
        lacks = cut(self.missing(request, wanted))
        if not lacks.isEmpty():
            built = build(lacks.select(*PAIR)).withColumn("yr", F.year("month")).join(lacks.select(*PAIR), PAIR, "left_semi")
            self._write(request, cut(built.select("aoi_id", "month", "yr", *[F.col(c).cast("long").alias(c) for c in COUNTS])))
            still = self.missing(request, wanted).orderBy(*PAIR).limit(5).collect()
            if still:
                raise ValueError("not complete after building: " + "; ".join(f"area {r['aoi_id']}, year {r['yr']}" for r in still))
        rows = self._rows(request).join(wanted.select(*PAIR), PAIR, "left_semi")
        return rows.select("aoi_id", "month", *COUNTS, ratio_pct("n_water", "n_valid").alias("extent_pct"), ratio_pct("n_invalid", "n_aoi").alias("invalid_pct"))


def wanted_years(areas: DataFrame, start: str, end: str) -> DataFrame:
    """(aoi_id, yr, n_months): each area's years between two dates, and how many of their months lie between them."""
    months = F.sequence(F.trunc(F.lit(start).cast("date"), "MM"), F.trunc(F.lit(end).cast("date"), "MM"), F.expr("interval 1 month"))
    return areas.select("aoi_id").distinct().select("aoi_id", F.explode(months).alias("month")).groupBy("aoi_id", F.year("month").alias("yr")).agg(F.count("*").alias("n_months"))
