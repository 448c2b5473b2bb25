"""Each area analysed by the route that its record supports, all areas in one job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import cut
from ..operators import dynamic_year, events, fixed_year, phase, scale, season

#: The columns that the years of both routes share.
YEARS = ["aoi_id", "hy_year", "hy_start", "hy_end", "peak_month", "peak_extent_pct", "mid_dry_month", "end_dry_month", "end_extent_pct", "amplitude_pct", "n_months_cycle", "confidence", "boundary_source"]


@dataclass(frozen=True)
class Analysis:
    """What an analysis gives: one row per area, year, event, low spell and month."""

    regimes: DataFrame
    hydro_years: DataFrame
    events: DataFrame
    low_spells: DataFrame
    event_summary: DataFrame
    phases: DataFrame


def by_route(prepared: DataFrame, regimes: DataFrame, *, max_invalid_pct: float = 20.0) -> tuple[DataFrame, DataFrame]:
    """(years, phases): own boundaries each year, one window around the usual peak, or none, as ``regimes`` (aoi_id, route, peak_month, trough_month) says."""
    some = lambda route: regimes.where(F.col("route") == route)
    own = cut(prepared.join(some("per_year_detection").select("aoi_id"), "aoi_id", "left_semi"))
    fixed = cut(prepared.join(some("fixed_climatological_window").select("aoi_id"), "aoi_id", "left_semi"))
    annual = dynamic_year.detect(own, some("per_year_detection").select("aoi_id", "trough_month"))
    window = fixed_year.around_peak(some("fixed_climatological_window").select("aoi_id", "peak_month")).drop("peak_month")
    imposed = cut(fixed_year.annotate_quality(fixed_year.detect(fixed, window), fixed, max_invalid_pct=max_invalid_pct))
    years = fixed_year.from_dynamic(annual).select(*YEARS, F.lit("detected_per_year").alias("boundary_basis")).unionByName(imposed.select(*YEARS, "boundary_basis"))
    same = imposed.select("aoi_id", "hy_year", "hy_start", "hy_end", "peak_month", "peak_extent_pct", F.col("end_extent_pct").alias("trough_extent_pct"), "status", "boundary_status", F.lit(None).cast("string").alias("peak_selection_status"))
    noise = cut(scale.robust_scale(prepared).select("aoi_id", "noise_pp"))
    phases = phase.assign(own, annual, noise).unionByName(phase.assign(fixed, same, noise, boundary_basis="imposed_fixed_window"))
    return years, phases


def reasons(regimes: DataFrame) -> DataFrame:
    """Regimes (with route, snr, trough_ci_low, n_years, peak_month, trough_month, caveats) with ``route_reason`` and ``warnings``.

    A route whose boundaries can't be placed, because the month that they rest on is unknown, falls back to events, with a warning.
    """
    lost = F.when((F.col("route") == "per_year_detection") & F.col("trough_month").isNull(), "no usual low").when((F.col("route") == "fixed_climatological_window") & F.col("peak_month").isNull(), "no usual peak")
    why = (
        F.when(F.col("route") == "insufficient_record", F.format_string("usable years: %d; regime unknown, no hydrological year", "n_years"))
        .when(lost.isNotNull(), F.concat(F.lit("boundaries can't be placed ("), lost, F.lit("); described by events")))
        .when(F.col("route") == "per_year_detection", F.format_string("seasonal (SNR %.2f, lows' concentration at least %.2f): own boundaries each year", "snr", "trough_ci_low"))
        .when(F.col("route") == "fixed_climatological_window", F.format_string("%s (SNR %.2f): timing supports one window, imposed on each year", "regime", "snr"))
        .otherwise(F.format_string("%s (SNR %.2f): timing supports no window, no hydrological year", "regime", "snr"))
    )
    out = regimes.withColumn("route_reason", why).withColumn("warnings", F.array_compact(F.array_append("caveats", F.concat(F.lit("fell back to events: "), lost))))
    return out.withColumn("route", F.when(lost.isNotNull(), "event_characterisation").otherwise(F.col("route")))


def analyse(prepared: DataFrame, *, n_resamples: int = 200, seed: int = 0, max_invalid_pct: float = 20.0) -> Analysis:
    """Regime, route with its reason and warnings, years, phases, events and spells of every area. Peak and trough month are given only where the regime has a cycle."""
    found, spells, summary, _ = events.extract(prepared)
    summary = cut(summary)
    regimes = season.assess(prepared, n_resamples=n_resamples, seed=seed).join(season.peak_of_climatology(prepared), "aoi_id", "left")
    cyclic = F.col("regime").isin("seasonal", "marginal")
    regimes = regimes.withColumn("peak_month", F.when(cyclic, F.col("peak_month"))).withColumn("trough_month", F.when(cyclic, F.col("trough_month")))
    regimes = cut(reasons(season.explain(regimes, summary)))
    years, phases = by_route(prepared, regimes, max_invalid_pct=max_invalid_pct)
    return Analysis(regimes, years, found, spells, summary, phases)


def summary_rows(a: Analysis) -> DataFrame:
    """One row per area: regime, route, rounded evidence, and how many years, events and spells. The usual months are given where the route has years."""
    n = a.hydro_years.groupBy("aoi_id").agg(F.count("*").alias("n_hydro_years"), F.min("boundary_basis").alias("boundary_basis"))
    s = a.event_summary.select("aoi_id", F.col("n_events").alias("_events"), F.col("longest_low_spell_months").alias("_longest"), F.col("median_gap_months").alias("median_recurrence_months"))
    d = a.events.groupBy("aoi_id").agg(F.percentile("duration_months", F.lit(0.5)).alias("median_event_duration_months"))
    usual = lambda k: F.when(F.col("route").isin("per_year_detection", "fixed_climatological_window"), F.col(f"{k}_month")).alias(f"climatological_{k}_month")
    names = {"concentration": "concentration", "ci_low": "concentration_ci_low", "ci_high": "concentration_ci_high", "uniformity_p": "uniformity_p"}
    evidence = [c for k in ("peak", "trough") for c in [*[F.round(f"{k}_{c}", 3).alias(f"{k}_timing_{x}") for c, x in names.items()], F.round(f"{k}_iqr_months", 2).alias(f"{k}_phase_iqr_months")]]
    out = a.regimes.join(n, "aoi_id", "left").join(s, "aoi_id", "left").join(d, "aoi_id", "left")
    return out.select(
        "aoi_id", "regime", "route", F.round("snr", 3).alias("amplitude_snr"), *evidence, "n_timing_years", F.col("n_years").alias("n_usable_years"), "n_usable_months", F.coalesce("n_hydro_years", F.lit(0)).alias("n_hydro_years"), F.coalesce("boundary_basis", F.lit("none")).alias("boundary_basis"),
        usual("peak"), usual("trough"), F.coalesce("_events", F.lit(0)).alias("n_wet_events"), "median_event_duration_months", F.coalesce("_longest", F.lit(0)).alias("longest_low_spell_months"), "median_recurrence_months", "years_without_wet_event",
    )
