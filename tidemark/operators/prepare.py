"""The monthly axis, its quality states, and aggregation over areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import median, month_floor, ratio_pct

COUNTS = ["n_water", "n_valid", "n_invalid", "n_aoi"]


def month_axis(df: DataFrame, keys: list[str] = ["aoi_id"]) -> DataFrame:  # noqa: B006
    """Every month between an area's first and last."""
    span = df.groupBy(*keys).agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    return span.select(*keys, F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))


def check_extent(df: DataFrame, keys: list[str] = ["aoi_id"]) -> DataFrame:  # noqa: B006
    """One row per area with what is wrong with its records, null if nothing: duplicate months, broken counts, percentages out of range."""
    names = set(df.columns)
    df = df.withColumn("month", month_floor("month"))
    dup = df.groupBy(*keys, "month").agg(F.count("*").alias("n")).groupBy(*keys).agg(F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("month").cast("string")))).alias("_dup"))
    tests: list[tuple[Column, str]] = []
    if names & {"n_water", "n_valid", "n_aoi"}:
        low = F.lit(False)
        for c in [c for c in COUNTS if c in names]:
            low = low | (F.col(c) < 0)
        tests += [(low, "negative counts"), (F.col("n_water") > F.col("n_valid"), "more water than valid pixels")]
        if "n_invalid" in names:
            tests.append((F.col("n_valid") + F.col("n_invalid") != F.col("n_aoi"), "valid and invalid pixels don't add up"))
    for c in ("extent_pct", "invalid_pct"):
        if c in names:
            tests.append(((F.col(c) < 0) | (F.col(c) > 100), f"{c} out of range"))
    found = df.groupBy(*keys).agg(*[F.max(F.when(t, F.lit(m))).alias(f"_t{i}") for i, (t, m) in enumerate(tests)]) if tests else df.select(*keys).distinct()
    both = found.join(dup, keys)
    first = F.coalesce(F.when(F.size("_dup") > 0, F.concat(F.lit("duplicate months: "), F.array_join("_dup", ", "))), *[F.col(f"_t{i}") for i in range(len(tests))])
    return both.select(*keys, first.alias("error"))


def prepare(df: DataFrame, *, keys: list[str] = ["aoi_id"], max_invalid_pct: float = 20.0, allow_unknown_quality: bool = False, quality_policy: str = "flag") -> DataFrame:  # noqa: B006
    """The gap-free monthly record with quality states.

    Takes (keys, month, and either counts or percentages); counts win. Missing months become
    rows of nulls. ``quality_state`` is missing, unknown, low or usable; ``candidate_usable``
    follows the policy ``flag`` (seen, and not wholly invalid) or ``exclude`` (usable only).
    """
    names = set(df.columns)
    rows = df.withColumn("month", month_floor("month"))
    if {"n_aoi", "n_valid"} <= names and "n_invalid" not in names:
        rows = rows.withColumn("n_invalid", F.col("n_aoi") - F.col("n_valid"))
        names.add("n_invalid")
    present = [c for c in COUNTS if c in names]
    if present and len(present) < 4:
        raise ValueError(f"count columns are incomplete: {', '.join(present)}")
    if present:
        rows = rows.withColumn("extent_pct", ratio_pct("n_water", "n_valid")).withColumn("invalid_pct", ratio_pct("n_invalid", "n_aoi"))
    elif "invalid_pct" not in names:
        rows = rows.withColumn("invalid_pct", F.lit(None).cast("double"))
    out = month_axis(rows, keys).join(rows, [*keys, "month"], "left")
    extent, invalid = F.col("extent_pct"), F.col("invalid_pct")
    state = F.when(extent.isNull(), "missing").when(invalid.isNull(), "unknown").when(invalid > max_invalid_pct, "low").otherwise("usable")
    if quality_policy == "flag":
        usable = extent.isNotNull() & (invalid.isNull() | (invalid < 100))
    elif quality_policy == "exclude":
        usable = F.col("quality_state").isin("usable", "unknown") if allow_unknown_quality else F.col("quality_state") == "usable"
    else:
        raise ValueError(f"no quality policy {quality_policy}")
    return out.withColumn("observed_fraction", 1 - invalid / 100).withColumn("quality_state", state).withColumn("candidate_usable", usable)


def sound(df: DataFrame, faults: DataFrame, keys: list[str] = ["aoi_id"]) -> DataFrame:  # noqa: B006
    """The records of areas without a fault; ``faults`` has (keys, error), null for sound areas."""
    return df.join(faults.where("error IS NOT NULL").select(*keys), keys, "left_anti")


def raise_for(faults: DataFrame, keys: list[str] = ["aoi_id"]) -> None:  # noqa: B006
    """An error that names the first ten faulty areas and how many there are."""
    bad = faults.where("error IS NOT NULL")
    first = bad.orderBy(*keys).limit(10).collect()
    if first:
        raise ValueError(f"{bad.count()} areas: " + "; ".join(f"{', '.join(str(r[k]) for k in keys)}: {r['error']}" for r in first))


def prepare_checked(df: DataFrame, *, keys: list[str] = ["aoi_id"], **options) -> DataFrame:  # noqa: B006
    """``prepare``, after ``check_extent`` has found no fault in any area; else an error."""
    raise_for(check_extent(df, keys), keys)
    return prepare(df, keys=keys, **options)


def unrepeated(df: DataFrame, keys: list[str], duplicates: str = "raise", order: str | None = None) -> DataFrame:
    """``df`` with one row for each value of ``keys``: repeated ones raise an error, or the first by ``order`` stays."""
    if duplicates == "first":
        if order is None:
            raise ValueError("to keep the first of repeated rows takes an order")
        w = Window.partitionBy(*keys).orderBy(order)
        return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if duplicates != "raise":
        raise ValueError(f"no policy {duplicates} for repeated rows")
    twice = df.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").orderBy(*keys).limit(5).collect()
    if twice:
        raise ValueError("repeated rows: " + "; ".join(", ".join(str(r[k]) for k in keys) for r in twice))
    return df


def frame_source(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """``normalise_frame`` of records whose months aren't repeated and of which some lie between the dates; else an error."""
    out = unrepeated(normalise_frame(df, start, end), ["aoi_id", "month"])
    if out.isEmpty():
        raise ValueError("no months inside the requested dates")
    return out


def normalise_frame(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """In-memory records as a source: months floored, missing invalid_pct 0, clipped to inclusive dates."""
    out = df.withColumn("invalid_pct", F.coalesce("invalid_pct", F.lit(0.0)) if "invalid_pct" in df.columns else F.lit(0.0))
    return normalise_dates(out, start, end)


def normalise_dates(df: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Months floored, and those between two dates, both months included."""
    out = df.withColumn("month", month_floor("month"))
    first, last = (F.trunc(F.lit(x).cast("date"), "MM") for x in (start, end))
    out = out.where(F.col("month") >= first) if start else out
    return out.where(F.col("month") <= last) if end else out


def coerce_monthly(df: DataFrame, *, keys: list[str] = ["aoi_id"], order: str = "ordinal", value: str = "extent_pct", duplicates: str = "first") -> DataFrame:  # noqa: B006
    """The older coercion: months floored, the first row of a month by ``order`` kept (or repeated months refused), null values dropped."""
    return unrepeated(df.withColumn("month", month_floor("month")), [*keys, "month"], duplicates, order).where(F.col(value).isNotNull())


def basin_from_counts(df: DataFrame) -> DataFrame:
    """Sums over areas per month (null where no area has counts), with how many areas report."""
    expected = df.select(F.countDistinct("aoi_id").alias("n_aoi_expected"))
    out = df.groupBy("month").agg(*[F.sum(c).alias(c) for c in ("n_water", "n_valid", "n_invalid", "n_aoi")], F.countDistinct("aoi_id").alias("n_aoi_reporting")).crossJoin(F.broadcast(expected))
    return out.select("month", ratio_pct("n_water", "n_valid").alias("extent_pct"), ratio_pct("n_invalid", "n_aoi").alias("invalid_pct"), "n_water", "n_valid", "n_invalid", "n_aoi", "n_aoi_reporting", "n_aoi_expected", ratio_pct("n_aoi_reporting", "n_aoi_expected").alias("aoi_coverage_pct"))


def basin_weighted(df: DataFrame, weight: str | None) -> DataFrame:
    """Area-weighted mean of percentages. A null extent still adds its weight below the line, as in the definition matched."""
    if weight is None or weight not in df.columns:
        raise ValueError("percentages need an area weight column")
    expected = df.select(F.countDistinct("aoi_id").alias("n_aoi_expected"))
    out = df.groupBy("month").agg(F.try_divide(F.sum(F.col("extent_pct") * F.col(weight)), F.sum(weight)).alias("extent_pct"), F.countDistinct("aoi_id").alias("n_aoi_reporting")).crossJoin(F.broadcast(expected))
    return out.select("month", "extent_pct", "n_aoi_reporting", "n_aoi_expected", ratio_pct("n_aoi_reporting", "n_aoi_expected").alias("aoi_coverage_pct"))


def quality_flags(df: DataFrame, max_invalid_pct: float = 10.0) -> DataFrame:
    e, i = F.col("extent_pct"), F.col("invalid_pct")
    return df.withColumn("quality_flag", F.when(e.isNull(), "missing_extent").when(i.isNull(), "unknown_invalid_pct").when(i > max_invalid_pct, "high_invalid_pct").otherwise("usable"))


def quality_tally(prepared: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("quality_state") == s).alias(f"n_{s}")
    return prepared.groupBy("aoi_id").agg(*[n(s) for s in ("missing", "unknown", "low", "usable")], F.count_if("candidate_usable").alias("n_candidates"), F.count("*").alias("n_months"))


def rainfall_as_extent(rain: DataFrame) -> DataFrame:
    """Rainfall as a share of the area's own maximum, so that it can go through the extent's operators."""
    top = F.max("rainfall_mm").over(Window.partitionBy("aoi_id"))
    return rain.select("aoi_id", "month", F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.try_divide(100 * F.col("rainfall_mm"), top))).alias("extent_pct"), F.lit(0.0).alias("invalid_pct"))


def normalise_rainfall(rain: DataFrame, value: str = "rainfall_mm") -> DataFrame:
    """(aoi_id, month, rainfall_mm) with months floored; repeated months are refused."""
    return unrepeated(rain.select("aoi_id", month_floor("month").alias("month"), F.col(value).cast("double").alias("rainfall_mm")), ["aoi_id", "month"])


def align_rainfall(axis: DataFrame, rain: DataFrame) -> DataFrame:
    """Rainfall on the extent's months, with its anomaly from the calendar month's median."""
    out = axis.select("aoi_id", "month").join(rain, ["aoi_id", "month"], "left")
    usual = median("rainfall_mm").over(Window.partitionBy("aoi_id", F.month("month")))
    return out.withColumn("rainfall_anomaly_mm", F.col("rainfall_mm") - usual)


def climatology(df: DataFrame, value: str = "extent_pct") -> DataFrame:
    """Mean and spread per calendar month; the band's lower end stops at 0."""
    out = df.groupBy("aoi_id", F.month("month").alias("moy")).agg(F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    return out.withColumn("low", F.greatest(F.lit(0.0), F.col("mean") - F.col("sd"))).withColumn("high", F.col("mean") + F.col("sd"))
