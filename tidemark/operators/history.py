"""The historical water mask as a versioned aggregate: counts by cell to which only new years are added."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import cut
from .distance import wet_area
from .pixels import CELL, DRY, WATER, ever_wet, historical_mask

_COUNTS = "aoi_id int, y int, x int, count_wet long, count_clear long"


def yearly_counts(mask: DataFrame) -> DataFrame:
    """(aoi_id, yr, y, x, count_wet, count_clear): what a year adds to a cell's history."""
    code = F.col("code")
    out = mask.groupBy("aoi_id", F.year("month").alias("yr"), "y", "x").agg(F.count_if(code == WATER).alias("count_wet"), F.count_if(code.isin(WATER, DRY)).alias("count_clear"))
    return out.where("count_clear > 0")


def summed(counts: DataFrame) -> DataFrame:
    """Counts of several years, or versions and years, as one row a cell."""
    return counts.groupBy(*CELL).agg(F.sum("count_wet").alias("count_wet"), F.sum("count_clear").alias("count_clear"))


def coverage_gap(start: Column, end: Column, first: Column, last: Column) -> Column:
    """struct(before, after, note) of a window against a mask's coverage: whole months that it begins early or ends late, null if it doesn't.

    Only the late end may lose water: a cell first wet after the coverage isn't in the mask. Begun months count, and a gap is a month at least.
    """
    months = lambda a, b: F.greatest(F.lit(1), (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a) + F.when(F.day(b) > F.day(a), 1).otherwise(0))
    before, after = F.when(start < first, months(start, first)), F.when(end > last, months(last, end))
    parts = F.concat_ws(" and ", F.when(before.isNotNull(), F.concat(F.lit("begins "), before.cast("string"), F.lit(" month(s) before the coverage"))), F.when(after.isNotNull(), F.concat(F.lit("ends "), after.cast("string"), F.lit(" month(s) after it, so cells first wet since then are missing"))))
    return F.struct(before.alias("before"), after.alias("after"), F.when(before.isNotNull() | after.isNotNull(), F.concat(F.lit("the window "), parts)).alias("note"))


class MaskHistory:
    """Versions of all areas' counts at ``root``, a shared folder; a version covers whole years, and none is ever changed.

    A new version is the latest one before it and the counts of the years since, so nothing of the years already covered is read again.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self) -> list[tuple[int, int]]:
        """(first, last) year of each version, by the last."""
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        named = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        # a version counts once its writer has finished
        done = [m for n in named if (m := re.fullmatch(r"years=(\d{4})-(\d{4})", n)) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))]
        return sorted(((int(m[1]), int(m[2])) for m in done), key=lambda v: v[1])

    def read(self, version: tuple[int, int]) -> DataFrame:
        return self.spark.read.schema(_COUNTS).parquet(f"{self.root}/years={version[0]}-{version[1]}")

    def resolve(self, counts: DataFrame, first: int, last: int, *, offline: bool = False) -> tuple[DataFrame, tuple[int, int]]:
        """(counts by cell, the years they cover) for a window that ends in ``last``.

        ``counts``: ``yearly_counts`` of whatever years are at hand. The latest version serves if it reaches ``last``, or offline; else the years
        after it are added, as far as ``counts`` has them, and kept as a new version. Without any version all years from ``first`` are counted.
        """
        known = self.versions()
        if known and (offline or known[-1][1] >= last):
            return self.read(known[-1]), known[-1]
        if offline:
            raise ValueError("no version is there, and none may be built offline")
        since = known[-1][1] if known else first - 1
        fresh = counts.where((F.col("yr") > since) & (F.col("yr") <= last))
        reach = fresh.agg(F.min("yr").alias("a"), F.max("yr").alias("b")).first()
        if reach["b"] is None:
            if not known:
                raise ValueError("no years to count")
            return self.read(known[-1]), known[-1]
        new = fresh.select(*CELL, "count_wet", "count_clear")
        version = (known[-1][0] if known else reach["a"], reach["b"])
        summed(self.read(known[-1]).unionByName(new) if known else new).write.mode("overwrite").parquet(f"{self.root}/years={version[0]}-{version[1]}")
        return self.read(version), version


def choose_wet_cells(given: DataFrame | None = None, counts: DataFrame | None = None, statistics: DataFrame | None = None, *, years: tuple[int, int] | None = None, cell_m: float = 30.0) -> tuple[DataFrame | None, str]:
    """(cells to read, where they come from), the first of: those given; yearly counts, if they cover all the window's years for every area; statistics; nothing.

    Nothing, None, means to read everything: a missing mask never hides water. A source without a single wet cell is passed over.
    """
    if given is not None:
        return given.select(*CELL), "given"
    if counts is not None and years is not None:
        have = cut(counts.where(F.col("yr").between(*years)))
        short = have.groupBy("aoi_id").agg(F.countDistinct("yr").alias("n")).where(F.col("n") < years[1] - years[0] + 1)
        if not have.isEmpty() and short.isEmpty():
            wet = ever_wet(summed(have))
            if not wet.isEmpty():
                return wet_area(wet, cell_m=cell_m), "counts"
    if statistics is not None:
        wet = ever_wet(statistics)
        if not wet.isEmpty():
            return wet_area(wet, cell_m=cell_m), "statistics"
    return None, "none"


def mask_of(counts: DataFrame, cells: DataFrame) -> DataFrame:
    """The historical mask: the area's cells that were ever wet. An area of which no cell was is an error, as its share of water would have no denominator."""
    out = historical_mask(counts, cells)
    dry = cells.select("aoi_id").distinct().join(out, "aoi_id", "left_anti").orderBy("aoi_id").limit(5).collect()
    if dry:
        raise ValueError("no cell was ever wet in area " + ", ".join(str(r["aoi_id"]) for r in dry))
    return out
