"""Low months of all years chosen together: near their expected month and about a year apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import month_number

_CANDIDATES = "array<struct<month:date,extent_pct:double>>"


def trough_candidates(prepared: DataFrame, opportunities: DataFrame, expected: Column) -> DataFrame:
    """(aoi_id, hy_year, expected, candidates): the seen months of each year's low run, in order; none where a year has no low.

    ``opportunities``: aoi_id, hy_year, run_start, run_end and what ``expected`` needs.
    """
    years = opportunities.select("aoi_id", "hy_year", expected.alias("expected"), "run_start", "run_end")
    seen = prepared.where("extent_pct IS NOT NULL AND invalid_pct < 100").select("aoi_id", "month", "extent_pct")
    found = seen.join(years, "aoi_id").where(F.col("month").between(F.col("run_start"), F.col("run_end")))
    found = found.groupBy("aoi_id", "hy_year").agg(F.array_sort(F.collect_list(F.struct("month", "extent_pct"))).alias("candidates"))
    out = years.select("aoi_id", "hy_year", "expected").join(found, ["aoi_id", "hy_year"], "left")
    return out.withColumn("candidates", F.coalesce("candidates", F.array().cast(_CANDIDATES)))


def boundary_sequence(years: DataFrame, *, relative_tolerance: float | None = None) -> DataFrame:
    """(aoi_id, hy_year, month): the low of each year, so that each area's sum of costs is least; null for years without candidates.

    ``years``: aoi_id, hy_year, expected date, candidates as an array of (month, extent_pct) in order of month. A low
    costs its distance from the expected month, and with the year before its gap's distance from twelve months.
    Years without candidates part the record into blocks that know nothing of each other. With ``relative_tolerance`` a
    candidate more than that share above its year's least is not eligible. Among equal costs a low follows the
    earliest low before it, and a block ends on the latest.

    One fold over each block's array of years: the accumulator holds, for each candidate of the year reached, the least cost and
    the lows that lead to it. A block has a few candidates for each year of one area's record, and areas are independent rows.
    """
    empty = F.size("candidates") == 0
    order = Window.partitionBy("aoi_id").orderBy("hy_year")
    marked = years.withColumn("_block", F.sum(F.when(empty, 1).otherwise(0)).over(order)).where(~empty)
    if relative_tolerance is not None:
        least = F.array_min(F.transform("candidates", lambda c: c["extent_pct"]))
        marked = marked.withColumn("_most", least * (1.0 + relative_tolerance))
        marked = marked.withColumn("candidates", F.expr("filter(candidates, c -> c.extent_pct <= _most)"))
    step = F.struct("hy_year", month_number("expected").alias("due"), F.transform("candidates", lambda c: F.struct(c["month"].alias("month"), month_number(c["month"]).alias("at"))).alias("lows"))
    blocks = marked.groupBy("aoi_id", "_block").agg(F.array_sort(F.collect_list(step)).alias("_years"))

    def grow(acc: Column, year: Column) -> Column:
        def reach(low: Column) -> Column:
            phase = F.abs(low["at"] - year["due"])
            before = F.transform(acc, lambda p, i: F.struct((p["cost"] + F.abs(low["at"] - p["at"] - 12)).alias("cost"), i.alias("i"), p["path"].alias("path")))
            best = F.array_min(before)  # of equal costs the first, which is the earliest
            first = F.size(acc) == 0
            path = F.when(first, F.array().cast("array<date>")).otherwise(best["path"])
            return F.struct((F.when(first, 0).otherwise(best["cost"]) + phase).cast("int").alias("cost"), low["at"].alias("at"), F.concat(path, F.array(low["month"])).alias("path"))

        return F.transform(year["lows"], reach)

    folded = F.aggregate("_years", F.array().cast("array<struct<cost:int,at:int,path:array<date>>>"), grow)
    last = F.array_min(F.transform(folded, lambda p, i: F.struct(p["cost"].alias("cost"), (-i).alias("i"), p["path"].alias("path"))))
    chosen = blocks.select("aoi_id", F.transform("_years", lambda y: y["hy_year"]).alias("_y"), last["path"].alias("_m"))
    chosen = chosen.select("aoi_id", F.explode(F.arrays_zip("_y", "_m")).alias("_x")).select("aoi_id", F.col("_x._y").alias("hy_year"), F.col("_x._m").alias("month"))
    return years.select("aoi_id", "hy_year").join(chosen, ["aoi_id", "hy_year"], "left")
