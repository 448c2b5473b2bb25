"""Tables for users: months with all that is known of them, years, events, spells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import condition


def _inside(months: DataFrame, spans: DataFrame, start: str, end: str, value: str, name: str) -> DataFrame:
    """``name``: the value of the area's span that holds the month, the least of several."""
    s = spans.select(F.col("aoi_id").alias("_a"), F.col(start).alias("_s"), F.col(end).alias("_e"), F.col(value).alias("_v"))
    return months.join(s, (F.col("aoi_id") == F.col("_a")) & F.col("month").between(F.col("_s"), F.col("_e"))).groupBy("aoi_id", "month").agg(F.min("_v").alias(name))


def monthly(prepared: DataFrame, years: DataFrame, events: DataFrame, spells: DataFrame, rainfall: DataFrame | None = None) -> DataFrame:
    """One row per month: record, condition, year with its peak and low, event and spell it lies in, rainfall with its anomaly."""
    m = prepared.select("aoi_id", "month")
    mark = lambda c, p: F.struct(F.col(c).alias("month"), F.lit(p).alias("p"))
    marks = years.select("aoi_id", F.explode(F.array(mark("peak_month", True), mark("end_dry_month", False))).alias("x")).where("x.month IS NOT NULL")
    marks = marks.groupBy("aoi_id", F.col("x.month").alias("month")).agg(F.bool_or("x.p").alias("is_peak"), F.bool_or(~F.col("x.p")).alias("is_trough"))
    out = condition.monthly_condition(prepared).join(prepared.select("aoi_id", "month", "invalid_pct", "candidate_usable"), ["aoi_id", "month"])
    for x in (_inside(m, years, "hy_start", "hy_end", "hy_year", "hy_year"), _inside(m, events, "start_month", "end_month", "event_id", "wet_event_id"), _inside(m, spells, "start_month", "end_month", "low_spell_id", "low_spell_id"), marks):
        out = out.join(x, ["aoi_id", "month"], "left")
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    out = out.select("aoi_id", "month", "extent_pct", "invalid_pct", "quality_state", "candidate_usable", "reference_median_pct", "anomaly_pct", "condition_percentile", "hy_year", no("is_peak"), no("is_trough"), "wet_event_id", "low_spell_id")
    return out if rainfall is None else out.join(rainfall.select("aoi_id", "month", "rainfall_mm", "rainfall_anomaly_mm"), ["aoi_id", "month"], "left")


def hydro_years(years: DataFrame) -> DataFrame:
    """Years under the names that users read."""
    return years.select(
        "aoi_id", "hy_year", F.col("hy_start").alias("start_date"), F.col("hy_end").alias("end_date"), F.col("n_months_cycle").alias("n_months"), F.col("peak_month").alias("peak_date"), "peak_extent_pct",
        F.col("mid_dry_month").alias("mid_dry_date"), F.col("end_dry_month").alias("trough_date"), F.col("end_extent_pct").alias("trough_extent_pct"), "amplitude_pct", "confidence", "boundary_source",
    )


def wet_events(events: DataFrame) -> DataFrame:
    return events.select("aoi_id", F.col("event_id").alias("wet_event_id"), F.col("start_month").alias("start_date"), F.col("end_month").alias("end_date"), "duration_months", F.col("peak_month").alias("peak_date"), "peak_extent_pct", "mean_extent_pct", "magnitude_pp_months", "baseline_extent_pct")


def low_spells(spells: DataFrame) -> DataFrame:
    return spells.select("aoi_id", "low_spell_id", F.col("start_month").alias("start_date"), F.col("end_month").alias("end_date"), "duration_months", "baseline_extent_pct", "min_extent_pct")


def wide_hydro_years(years: DataFrame, regimes: DataFrame) -> DataFrame:
    """Years with their area's regime and route, of areas whose route has years; ``boundary_basis`` where the years don't say it is that of the route."""
    basis = F.when(F.col("route") == "per_year_detection", "detected_per_year").otherwise("imposed_fixed_window")
    out = years.join(regimes.where("route NOT IN ('event_characterisation', 'insufficient_record')").select("aoi_id", "regime", "route"), "aoi_id")
    return out.withColumn("boundary_basis", F.coalesce("boundary_basis", basis) if "boundary_basis" in years.columns else basis)


def _held(months: DataFrame, spans: DataFrame, start: str, end: str, name: str) -> DataFrame:
    """The months with 'Yes' where one of the area's spans holds them, else 'No'. Spans are laid out month by month, so that the join is one of equal keys."""
    inside = spans.select("aoi_id", F.explode(F.sequence(start, end, F.expr("interval 1 month"))).alias("month")).distinct().withColumn("_in", F.lit(True))
    return months.join(inside, ["aoi_id", "month"], "left").withColumn(name, F.when(F.col("_in").isNotNull(), "Yes").otherwise("No")).drop("_in")


def annotated_months(months: DataFrame, events: DataFrame, spells: DataFrame, *, max_invalid_pct: float = 20.0) -> DataFrame:
    """Months as a table to browse: year, quality as good, flagged or missing, and whether an event or a low spell holds them."""
    out = _held(_held(months.where("month IS NOT NULL"), events, "start_month", "end_month", "wet_event"), spells, "start_month", "end_month", "low_extent_spell")
    kind = F.when(F.col("invalid_pct").isNull() | F.col("quality_state").isin("missing", "unknown"), "missing").when((F.col("quality_state") == "usable") & (F.col("invalid_pct") <= max_invalid_pct), "good").otherwise("flagged")
    return out.select("aoi_id", "month", F.year("month").alias("year"), F.date_format("month", "MMM yyyy").alias("display_date"), "extent_pct", "invalid_pct", kind.alias("quality_filter"), "wet_event", "low_extent_spell")


def season_labels(months: DataFrame, annual: DataFrame) -> DataFrame:
    """Every month with the complete year that holds it (the latest of several) and 'Wet' up to its peak, 'Dry' after it or without one; 'unassigned' outside of complete years."""
    spans = annual.where("status = 'complete' AND hy_start IS NOT NULL AND hy_end IS NOT NULL").select("aoi_id", F.explode(F.sequence("hy_start", "hy_end", F.expr("interval 1 month"))).alias("month"), F.struct("hy_year", "peak_month").alias("_y"))
    last = spans.groupBy("aoi_id", "month").agg(F.max("_y").alias("_y"))
    season = F.when(F.col("_y").isNull(), "unassigned").when(F.col("month") <= F.col("_y.peak_month"), "Wet").otherwise("Dry")
    return months.select("aoi_id", "month").join(last, ["aoi_id", "month"], "left").select("aoi_id", "month", F.col("_y.hy_year").alias("hy_year"), season.alias("season"))


def year_cards(months: DataFrame, annual: DataFrame, phases: DataFrame) -> DataFrame:
    """The months of each year, cards numbered from the newest year on; years without both boundaries are a row without a month.

    A month's marker is the first of wet peak, mid dry and dry end that falls on it; months without a phase are 'Unassigned'.
    """
    newest = F.row_number().over(Window.partitionBy("aoi_id").orderBy(F.col("hy_year").desc()))
    y = annual.select("aoi_id", "hy_year", newest.alias("card"), "hy_start", "hy_end", "peak_month", "temporal_mid_dry_month", "trough_month", "cycle_months", "drawdown_pct", F.coalesce("confidence", F.lit("unassigned")).alias("confidence"), "status_reason")
    whole = F.col("hy_start").isNotNull() & F.col("hy_end").isNotNull()
    y = y.withColumn("month", F.explode_outer(F.when(whole, F.sequence("hy_start", "hy_end", F.expr("interval 1 month")))))
    p = phases.select("aoi_id", "month", "phase").distinct()
    m = months.select("aoi_id", "month", "extent_pct", "invalid_pct", F.lit(True).alias("_seen"))
    out = y.join(m, ["aoi_id", "month"], "left").where("month IS NULL OR _seen").join(p, ["aoi_id", "month"], "left")
    marker = F.when(F.col("month") == F.col("peak_month"), "Wet Peak").when(F.col("month") == F.col("temporal_mid_dry_month"), "Mid Dry").when(F.col("month") == F.col("trough_month"), "Dry End")
    label = F.when(F.col("month").isNotNull(), F.when(F.col("phase").isNull() | (F.col("phase") == "unspecified"), "Unassigned").otherwise(F.initcap("phase")))
    return out.select("aoi_id", "card", "hy_year", "month", label.alias("phase"), "extent_pct", "invalid_pct", marker.alias("marker"), "cycle_months", "drawdown_pct", "confidence", "status_reason")
