"""How far a coarser record keeps what the native one says: months, events, spells, boundaries, routes, and which resolution to take."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import correlation, median, month_number

#: What a resolution has to reach, as medians over areas (differences of events and spells: the worst area).
LEAST_CORRELATION = 0.995
MOST_NMAE = 0.05
LEAST_WITHIN_ONE_MONTH = 0.90
MOST_EVENT_DELTA = 1
MOST_SPELL_DELTA = 2


@dataclass(frozen=True)
class Record:
    """One resolution's months (aoi_id, month, extent_pct), labels (aoi_id, snr, regime, route), event summary and years (aoi_id, hy_year, peak_month, low_month)."""

    months: DataFrame
    labels: DataFrame
    summary: DataFrame
    years: DataFrame


def series(native: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per area, over months in which both have a value: correlation (null where either is constant), differences, and the mean one over the native maximum."""
    n, c = (x.where("extent_pct IS NOT NULL").select("aoi_id", "month", F.col("extent_pct").alias(k)) for x, k in ((native, "n"), (candidate, "c")))
    gap = F.abs(F.col("n") - F.col("c"))
    out = n.join(c, ["aoi_id", "month"]).groupBy("aoi_id").agg(
        F.count("*").alias("n_months"), correlation("n", "c").alias("_r"), ((F.min("n") == F.max("n")) | (F.min("c") == F.max("c"))).alias("_flat"),
        F.avg(gap).alias("mean_absolute_difference"), F.max(gap).alias("max_absolute_difference"), F.max("n").alias("_top"),
    )
    return out.select(
        "aoi_id", "n_months", F.when(~F.col("_flat"), F.col("_r")).alias("correlation"), F.when(F.col("_flat"), "constant_input").otherwise("ok").alias("correlation_status"),
        "mean_absolute_difference", "max_absolute_difference", (F.col("mean_absolute_difference") / F.greatest("_top", F.lit(1e-6))).alias("normalized_mae"),
    )


def _near(a: Column, b: Column) -> Column:
    """Whether two dates' calendar months are at most one apart on the circle; a missing one is never near."""
    d = F.abs(F.month(a) - F.month(b))
    return F.coalesce(F.least(d, 12 - d) <= 1, F.lit(False))


def boundaries(native: DataFrame, candidate: DataFrame) -> DataFrame:
    """Per area with years of the same number in both: the shares of them whose peaks, and whose lows, are at most a calendar month apart."""
    c = candidate.select("aoi_id", "hy_year", F.col("peak_month").alias("_p"), F.col("low_month").alias("_l"))
    share = lambda x, y: F.avg(_near(F.col(x), F.col(y)).cast("double"))
    return native.join(c, ["aoi_id", "hy_year"]).groupBy("aoi_id").agg(share("peak_month", "_p").alias("peak_within_one_month_fraction"), share("low_month", "_l").alias("trough_within_one_month_fraction"))


def match_spans(native: DataFrame, candidate: DataFrame, key: str, *, at: str = "peak_month", months: int = 1) -> DataFrame:
    """Pairs (aoi_id, key, candidate_key, delta_months) of spans that are each other's nearest within ``months`` whole months, one to one.

    Nearest by months apart, the earlier of equals, then the smaller key. Each span of one side meets only the
    spans of the 2 * months + 1 months around it, by equality of area and month. Spans without a date pair with nothing.
    """
    own = native.select("aoi_id", F.col(key).alias("_n"), month_number(at).alias("_nm")).where("_nm IS NOT NULL").withColumn("_m", F.explode(F.sequence(F.col("_nm") - months, F.col("_nm") + months)))
    other = candidate.select("aoi_id", F.col(key).alias("_c"), month_number(at).alias("_m"))
    gap = F.abs(F.col("_m") - F.col("_nm"))
    both = own.join(other, ["aoi_id", "_m"])
    rank = lambda mine, month, yours: F.row_number().over(Window.partitionBy("aoi_id", mine).orderBy(gap, month, yours))
    both = both.withColumn("_i", rank("_n", "_m", "_c")).withColumn("_j", rank("_c", "_nm", "_n"))
    return both.where("_i = 1 AND _j = 1").select("aoi_id", F.col("_n").alias(key), F.col("_c").alias(f"candidate_{key}"), (F.col("_m") - F.col("_nm")).alias("delta_months"))


def _one(native: Record, candidate: Record) -> DataFrame:
    def sided(which: str, cols: list[str]) -> DataFrame:
        n, c = getattr(native, which), getattr(candidate, which)
        return n.select("aoi_id", *[F.col(x).alias(f"n_{x}") for x in cols]).join(c.select("aoi_id", *[F.col(x).alias(f"c_{x}") for x in cols]), "aoi_id", "full")

    labels = sided("labels", ["snr", "regime", "route"])
    events = sided("summary", ["n_events", "longest_low_spell_months"])
    out = series(native.months, candidate.months).join(labels, "aoi_id", "left").join(events, "aoi_id", "left").join(boundaries(native.years, candidate.years), "aoi_id", "left")
    zero = lambda x: F.coalesce(F.col(x), F.lit(0))
    delta = lambda x: (zero(f"c_{x}") - zero(f"n_{x}")).cast("long")
    full = lambda x: F.coalesce(F.col(x), F.lit(1.0)).alias(x)
    return out.select(
        "aoi_id", "n_months", "correlation", "correlation_status", "mean_absolute_difference", "max_absolute_difference", "normalized_mae", (F.col("c_snr") - F.col("n_snr")).alias("amplitude_bias"),
        F.col("c_regime").eqNullSafe(F.col("n_regime")).alias("regime_match"), F.col("c_route").eqNullSafe(F.col("n_route")).alias("route_match"),
        delta("n_events").alias("event_count_delta"), delta("longest_low_spell_months").alias("longest_low_spell_delta"), full("peak_within_one_month_fraction"), full("trough_within_one_month_fraction"),
    )


def compare(native: Record, candidates: Mapping[int, Record]) -> DataFrame:
    """One row per area and candidate resolution (metres): how its record, analysed alike, differs from the native one.

    Areas without a month that both have get no row. Without a year of the same number in both, both shares are 1. A missing event or spell counts as 0.
    """
    if not candidates:
        raise ValueError("no candidate resolution")
    parts = [_one(native, c).withColumn("candidate_resolution_m", F.lit(int(r))) for r, c in sorted(candidates.items())]
    return reduce(DataFrame.unionByName, parts)


def recommend(fidelity: DataFrame) -> DataFrame:
    """One row per resolution: medians over areas, the worst differences, whether all gates are passed, and those that aren't."""
    rows = fidelity.groupBy("candidate_resolution_m").agg(
        F.count("*").alias("_n"), F.count_if("route_match").alias("_same"), median("correlation").alias("_r"), median("normalized_mae").alias("_e"),
        median("peak_within_one_month_fraction").alias("_p"), median("trough_within_one_month_fraction").alias("_t"),
        F.max(F.abs("event_count_delta")).alias("_ev"), F.max(F.abs("longest_low_spell_delta")).alias("_sp"),
    )
    gates = [
        (F.col("_same") < F.col("_n"), F.format_string("route agreement %d/%d", "_same", "_n")),
        (F.coalesce(F.col("_r") < LEAST_CORRELATION, F.lit(True)), F.format_string("median correlation %s < %s", F.when(F.col("_r").isNull(), "nan").otherwise(F.format_string("%.4f", "_r")), F.lit(str(LEAST_CORRELATION)))),
        (F.col("_e") > MOST_NMAE, F.format_string(f"median nMAE %.4f > {MOST_NMAE}", "_e")),
        (F.col("_p") < LEAST_WITHIN_ONE_MONTH, F.format_string(f"peak within 1 month fraction %.3f < {LEAST_WITHIN_ONE_MONTH:.2f}", "_p")),
        (F.col("_t") < LEAST_WITHIN_ONE_MONTH, F.format_string(f"trough within 1 month fraction %.3f < {LEAST_WITHIN_ONE_MONTH:.2f}", "_t")),
        (F.col("_ev") > MOST_EVENT_DELTA, F.format_string(f"max event delta %d > {MOST_EVENT_DELTA}", "_ev")),
        (F.col("_sp") > MOST_SPELL_DELTA, F.format_string(f"max low spell delta %d > {MOST_SPELL_DELTA}", "_sp")),
    ]
    rows = rows.withColumn("_fails", F.array_compact(F.array(*[F.when(bad, text) for bad, text in gates])))
    good = F.size("_fails") == 0
    return rows.select(
        "candidate_resolution_m", F.format_string("%d/%d", "_same", "_n").alias("route_agreement_count"), F.round("_r", 4).alias("median_correlation"), F.round("_e", 4).alias("median_normalized_mae"),
        F.round("_p", 3).alias("median_peak_within_one_month"), F.round("_t", 3).alias("median_trough_within_one_month"), F.col("_ev").alias("max_abs_event_count_delta"), F.col("_sp").alias("max_abs_longest_low_spell_delta"),
        good.alias("recommended"), F.when(good, "passes all gates").otherwise(F.concat(F.lit("fails: "), F.array_join("_fails", "; "))).alias("decision_reason"),
    )


def acquisition(runs: DataFrame) -> DataFrame:
    """Per resolution and pruning mode: medians of seconds and memory over runs, and the speedup over the median without pruning ('off'; 1 second where there is none)."""
    by = runs.groupBy("resolution_m", "pruning").agg(F.count("*").alias("n_runs"), median("seconds").alias("_s"), median("peak_rss_mb").alias("_m"))
    base = F.coalesce(F.max(F.when(F.col("pruning") == "off", F.col("_s"))).over(Window.partitionBy("resolution_m")), F.lit(1.0))
    return by.select("resolution_m", "pruning", "n_runs", F.round("_s", 3).alias("median_seconds"), F.round("_m", 1).alias("median_peak_rss_mb"), F.round(base / F.greatest("_s", F.lit(1e-6)), 3).alias("median_speedup"))
