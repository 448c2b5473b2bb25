"""Many areas in one job: bad ones become rows with their error, all others are analysed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import prepare as pr
from .routing import Analysis, analyse

#: A record with fewer months than a year has no season to look for.
LEAST_MONTHS = 12


@dataclass(frozen=True)
class Batch:
    """``outcomes``: (aoi_id, succeeded, error_type, error, n_months, first_month, last_month), one row per requested area; ``records``: the sound areas' prepared months; ``analysis`` of them."""

    outcomes: DataFrame
    records: DataFrame
    analysis: Analysis | None

    def raise_for_failures(self) -> None:
        pr.raise_for(self.outcomes)


def area_names(areas: DataFrame, name: str | None = None, *, position: str = "position") -> DataFrame:
    """(position, name, safe_name) of areas numbered from 1 by ``position``: their trimmed own names, or aoi-0001 and so on.

    ``safe_name`` is the name in lower case, anything but ASCII letters and digits a hyphen. Null, blank and repeated names are
    refused, and names that share a safe name.
    """
    own = F.trim(F.col(name).cast("string")) if name else F.format_string("aoi-%04d", F.col(position).cast("int"))
    out = areas.select(F.col(position).alias("position"), own.alias("name"))
    stem = F.regexp_replace(F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    out = out.withColumn("safe_name", F.when(stem == "", "catchment").otherwise(stem))
    again = lambda c: F.count("*").over(Window.partitionBy(c)) > 1
    fault = F.when(F.col("name").isNull(), "null").when(F.col("name") == "", "blank").when(again("name"), "repeated").when(again("safe_name"), "the same safe name")
    bad = out.withColumn("_f", fault).where("_f IS NOT NULL").orderBy("position").limit(5).collect()
    if bad:
        raise ValueError("names of areas: " + "; ".join(f"{r['position']}: {r['name']!r} ({r['_f']})" for r in bad))
    return out


def faults(records: DataFrame, areas: DataFrame, start: str | None = None, end: str | None = None, *, least_months: int = LEAST_MONTHS) -> DataFrame:
    """(aoi_id, error_type, error, n_months, first_month, last_month) of each requested area; the error is null for sound ones.

    Looked for in this order: no record, no month between the dates, what ``check_extent`` finds, fewer than ``least_months`` months with a value.
    """
    inside = pr.normalise_dates(records, start, end)
    seen = F.col("n_valid") > 0 if "n_valid" in records.columns else F.col("extent_pct").isNotNull()
    span = inside.groupBy("aoi_id").agg(F.countDistinct("month").alias("n_months"), F.countDistinct(F.when(seen, F.col("month"))).alias("_seen"), F.min("month").alias("first_month"), F.max("month").alias("last_month"))
    found = areas.select("aoi_id").distinct().join(records.select("aoi_id", F.lit(True).alias("_any")).distinct(), "aoi_id", "left").join(span, "aoi_id", "left").join(pr.check_extent(inside), "aoi_id", "left")
    short = F.coalesce("_seen", F.lit(0)) < least_months
    kind = F.when(F.col("_any").isNull(), "NoRecord").when(F.col("n_months").isNull(), "NoMonths").when(F.col("error").isNotNull(), "BadRecord").when(short, "ShortRecord")
    text = F.when(kind == "NoRecord", "no record").when(kind == "NoMonths", "no months inside the requested dates").when(kind == "ShortRecord", F.concat(F.lit("months with a value: "), F.col("_seen").cast("string"), F.lit(f", needed: {least_months}"))).otherwise(F.col("error"))
    return found.select("aoi_id", kind.alias("error_type"), F.when(kind.isNotNull(), text).alias("error"), F.coalesce("n_months", F.lit(0)).alias("n_months"), "first_month", "last_month")


def run_many(records: DataFrame, areas: DataFrame | None = None, *, start: str | None = None, end: str | None = None, least_months: int = LEAST_MONTHS, analysed: bool = True, max_invalid_pct: float = 20.0, n_resamples: int = 200, seed: int = 0) -> Batch:
    """Validate all areas at once, and analyse those that are sound, each by its route.

    ``areas`` (aoi_id) are the requested ones, those of ``records`` if None. One aggregate finds every area's fault, so a
    bad area costs the others nothing, and no area's records are brought to the driver.
    """
    areas = records.select("aoi_id").distinct() if areas is None else areas
    judged = cut(faults(records, areas, start, end, least_months=least_months))
    kept = pr.normalise_dates(records, start, end).join(judged.where("error IS NULL").select("aoi_id"), "aoi_id", "left_semi")
    prepared = cut(pr.prepare(kept, max_invalid_pct=max_invalid_pct))
    outcomes = judged.select("aoi_id", F.col("error").isNull().alias("succeeded"), "error_type", "error", "n_months", "first_month", "last_month")
    return Batch(outcomes, prepared, analyse(prepared, n_resamples=n_resamples, seed=seed, max_invalid_pct=max_invalid_pct) if analysed else None)
