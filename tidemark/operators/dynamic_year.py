"""Hydrological years from each year's own low, by robust extrema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import first_min, median, month_number, r6
from ..functions.lineage import cut
from .boundary import boundary_sequence, trough_candidates
from .prepare import prepare_checked
from .scale import epsilon, robust_scale

#: Boundary thresholds, fixed values.
MIN_CANDIDATES, MIN_COVERAGE, MIN_SUPPORT, ANOMALY = 2, 0.70, 0.80, 3.0
MIN_CYCLE_MONTHS = 8


def window_extreme(rows: DataFrame, keys: list[str], kind: str) -> DataFrame:
    """The extreme month of each window and how far to trust it.

    ``rows``: keys, the prepared columns, and per window expected, expected_count, noise_pp and
    amplitude_pp. Months are candidates if seen at all; quality only lowers the status.
    """
    if "n_valid" not in rows.columns:  # percentages only: no resolution is known
        rows = rows.withColumn("n_valid", F.lit(None).cast("long"))
    sign = 1.0 if kind == "min" else -1.0
    seen = F.col("extent_pct").isNotNull() & F.coalesce(F.col("invalid_pct") < 100, F.lit(False))
    rows = rows.withColumn("_v", F.when(seen, sign * F.col("extent_pct")))
    by = Window.partitionBy(*keys)
    near = by.orderBy("month").rowsBetween(-1, 1)
    present = rows.where("_v IS NOT NULL")
    present = present.withColumn("_med", F.when(F.count("_v").over(near) >= 2, median("_v").over(near)))
    raw = present.groupBy(*keys).agg(F.min(F.struct("_v", "month", "extent_pct", "n_valid", "quality_state", "candidate_usable", "invalid_pct", "_med")).alias("raw"), F.count("*").alias("_n"))
    whole = rows.groupBy(*keys).agg(F.count_if(F.col("candidate_usable") & F.col("extent_pct").isNotNull()).alias("n_usable"), F.min("month").alias("_lo"), F.max("month").alias("_hi"), *[F.first(c).alias(c) for c in ("expected", "expected_count", "noise_pp", "amplitude_pp")])
    sel = whole.join(raw, keys, "left").withColumn("raw", F.when(F.col("_n") >= MIN_CANDIDATES, F.col("raw")))
    tol = epsilon(F.col("amplitude_pp"), F.col("noise_pp"), F.col("raw.n_valid"))
    limits = sel.where("raw IS NOT NULL").select(*keys, (F.col("raw._v") + tol).alias("_cut"), F.col("raw.month").alias("_at"))
    flat = rows.join(limits, keys).withColumn("_eq", F.coalesce(F.col("_v") <= F.col("_cut"), F.lit(False)))
    run = F.row_number().over(by.orderBy("month")) - F.row_number().over(Window.partitionBy(*keys, "_eq").orderBy("month"))
    flat = flat.withColumn("_run", run).where("_eq")
    runs = flat.groupBy(*keys, "_run").agg(F.min("month").alias("run_start"), F.max("month").alias("run_end"), F.max(F.col("month") == F.col("_at")).alias("_own")).where("_own").select(*keys, "run_start", "run_end")
    half = F.expr("cast((expected_count - 1) div 2 as int)")
    ambiguous = (F.col("noise_pp") > 0) & F.coalesce(F.col("raw._med") - F.col("raw._v") > ANOMALY * F.col("noise_pp"), F.lit(False))
    low_q = (F.col("raw.quality_state") != "usable") | ~F.col("raw.candidate_usable")
    status = F.when(F.col("raw").isNull(), "unresolved").when(low_q, "low_quality").when(ambiguous, "ambiguous").otherwise("raw")
    place = F.when(F.col("raw").isNull(), "internal_gap").when(F.col("_lo") > F.add_months("expected", -half), "left_truncated").when(F.col("_hi") < F.add_months("expected", half), "right_truncated").when(F.col("n_usable") / F.col("expected_count") < MIN_COVERAGE, "internal_gap").otherwise("full")
    sel = sel.join(runs, keys, "left").withColumn("selection_status", status).withColumn("window_status", place)
    support = F.least(F.lit(1.0), F.col("n_usable") / F.col("expected_count")) * F.when(ambiguous, 0.60).otherwise(1.0) * F.when(F.col("window_status") != "full", 0.75).otherwise(1.0)
    return sel.select(*keys, F.col("raw.month").alias("at"), F.col("raw.extent_pct").alias("extent"), F.col("raw.invalid_pct").alias("invalid"), "run_start", "run_end", "window_status", "selection_status", F.when(F.col("raw").isNull(), 0.0).otherwise(support).alias("support"), "n_usable", (month_number(F.col("raw.month")) - month_number("expected")).alias("phase_offset"))


def troughs(prepared: DataFrame, expected_month: int | DataFrame, *, radius: int = 3, scale: DataFrame | None = None) -> DataFrame:
    """One opportunity per calendar year: the low of the months around the expected one, a month or (aoi_id, trough_month) for each area.

    The observed least stands; where several months of its run share its very value, the one that fits the neighbouring
    years best is taken, and labelled ``coherence_adjusted`` if it isn't the first of them.
    """
    scale = robust_scale(prepared) if scale is None else scale
    key = ["aoi_id", "hy_year"]
    years = prepared.groupBy("aoi_id").agg(F.min(F.year("month")).alias("a"), F.max(F.year("month")).alias("b")).select("aoi_id", F.explode(F.sequence("a", "b")).alias("hy_year"))
    years = years.withColumn("_m", F.lit(expected_month)) if isinstance(expected_month, int) else years.join(expected_month.select("aoi_id", F.col("trough_month").alias("_m")), "aoi_id")
    years = years.select(*key, F.make_date("hy_year", "_m", F.lit(1)).alias("expected"))
    near = prepared.join(years, "aoi_id").where(F.col("month").between(F.add_months("expected", -radius), F.add_months("expected", radius)))
    picked = window_extreme(near.withColumn("expected_count", F.lit(2 * radius + 1)).join(scale, "aoi_id"), key, "min")
    raw = cut(years.join(picked, key, "left"))
    fitted = boundary_sequence(trough_candidates(prepared, raw, F.col("expected")), relative_tolerance=0.0)
    seen = prepared.select("aoi_id", F.col("month").alias("trough_month"), F.col("extent_pct").alias("trough_extent_pct"), F.col("invalid_pct").alias("trough_invalid_pct"))
    out = raw.join(fitted.select(*key, F.col("month").alias("trough_month")), key).join(seen, ["aoi_id", "trough_month"], "left")
    moved = (F.col("trough_month") != F.col("at")) & (F.col("selection_status") != "low_quality")
    out = out.withColumn("selection_status", F.when(moved, "coherence_adjusted").otherwise(F.coalesce("selection_status", F.lit("unresolved"))))
    sure = (F.col("window_status") == "full") & (F.col("selection_status") == "raw") & (F.col("support") >= MIN_SUPPORT)
    status = F.when(F.col("trough_month").isNull(), "unresolved").when(sure, "confirmed").otherwise("provisional")
    return out.select(
        *key, "trough_month", "trough_extent_pct", "trough_invalid_pct", F.col("at").alias("raw_trough_month"), F.col("extent").alias("raw_trough_extent_pct"), "run_start", "run_end",
        F.coalesce("window_status", F.lit("internal_gap")).alias("window_status"), "selection_status", F.coalesce("support", F.lit(0.0)).alias("support"),
        (month_number("trough_month") - month_number("expected")).alias("phase_offset"), status.alias("boundary_status"),
    )


def cycles(prepared: DataFrame, opportunities: DataFrame) -> DataFrame:
    """Each resolved year's span: from the month after the last year's low (or the record's start) to its own low."""
    order = Window.partitionBy("aoi_id").orderBy("hy_year")
    first = prepared.groupBy("aoi_id").agg(F.min("month").alias("_first"))
    x = opportunities.withColumn("_prev", F.lag("trough_month").over(order)).withColumn("_pos", F.row_number().over(order)).join(first, "aoi_id")
    began = F.col("_pos") == 1
    start = F.when(F.col("trough_month").isNotNull(), F.when(began, F.col("_first")).otherwise(F.add_months("_prev", 1)))
    return x.withColumn("hy_start", start).withColumn("from_record_start", began & F.col("trough_month").isNotNull()).drop("_prev", "_pos", "_first")


def _grade(fraction: Column, quality: Column, unknown: Column, provisional: Column) -> Column:
    score = fraction * F.coalesce(quality, F.lit(0.5)) * F.when(provisional, 0.75).otherwise(1.0)
    score = F.when(unknown, F.least(score, F.lit(0.59))).otherwise(score)
    return F.when(score >= 0.80, "high").when(score >= 0.60, "medium").otherwise("low")


def assemble(prepared: DataFrame, opportunities: DataFrame, *, secondary: bool = False, scale: DataFrame | None = None) -> DataFrame:
    """The annual table, one row per calendar year, unresolved years included."""
    scale = robust_scale(prepared) if scale is None else scale
    key = ["aoi_id", "hy_year"]
    years = cycles(prepared, opportunities)
    span = years.where("hy_start IS NOT NULL").select(*key, "hy_start", "trough_month", "from_record_start", "boundary_status")
    months = prepared.join(span, "aoi_id").where("month BETWEEN hy_start AND trough_month")
    facts = months.groupBy(*key).agg(F.count("*").alias("cycle_months"), F.count_if("candidate_usable").alias("n_usable_months"), F.avg(F.when(F.col("candidate_usable"), F.col("observed_fraction"))).alias("_q"), F.max(F.col("quality_state") == "unknown").alias("_unknown"))
    inner = months.where((F.col("month") >= F.col("hy_start")) & (F.col("month") < F.col("trough_month"))).join(scale, "aoi_id")
    by = Window.partitionBy(*key)
    inner = inner.withColumn("expected_count", F.count("*").over(by).cast("int")).withColumn("_i", F.row_number().over(by.orderBy("month")) - 1)
    inner = inner.withColumn("expected", F.max(F.when(F.col("_i") == F.expr("expected_count div 2"), F.col("month"))).over(by))
    peak = window_extreme(inner, key, "max").where("at IS NOT NULL").select(*key, F.col("at").alias("peak_month"), F.col("extent").alias("peak_extent_pct"), F.col("invalid").alias("peak_invalid_pct"), F.col("selection_status").alias("peak_selection_status"), F.col("support").alias("peak_selection_support"))
    post = months.join(peak, key).where("month >= peak_month").join(scale, "aoi_id")
    low = prepared.select(F.col("aoi_id"), F.col("month").alias("trough_month"), F.col("extent_pct").alias("_low"))
    post = post.join(low, ["aoi_id", "trough_month"])
    target = (F.col("peak_extent_pct") + F.col("_low")) / 2
    order = by.orderBy("month")
    rise = F.col("candidate_usable") & F.coalesce(F.lag("candidate_usable").over(order), F.lit(False)) & (F.col("extent_pct") - F.lag("extent_pct").over(order) > F.col("noise_pp"))
    post = post.withColumn("_rise", F.coalesce(rise, F.lit(False))).withColumn("_pulse", F.col("_rise") & ~F.coalesce(F.lag("_rise").over(order), F.lit(False)))
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    far = F.when(F.col("candidate_usable"), F.abs(2 * day("month") - day("peak_month") - day("trough_month")))
    tail = post.groupBy(*key).agg(
        F.min(F.when(F.col("candidate_usable") & (F.col("extent_pct") <= target), F.struct("month", "extent_pct"))).alias("half"), first_min(far, F.struct("month", "extent_pct")).alias("mid"), F.count_if("_pulse").alias("n_rewetting_pulses"), F.first(target).alias("half_loss_target_pct"),
    )
    out = years.join(facts, key, "left").join(peak, key, "left").join(tail, key, "left")
    covered = (F.col("n_usable_months") >= MIN_CYCLE_MONTHS) & F.col("peak_month").isNotNull()
    bad_peak = F.col("peak_selection_status") == "low_quality"
    provisional = bad_peak | F.col("from_record_start") | (F.col("boundary_status") != "confirmed")
    case = F.when(F.col("trough_month").isNull(), "unresolved").when(F.col("hy_start").isNull(), "no_previous").when(~covered, "thin").otherwise("ok")
    out = out.withColumn("_case", case)
    ok = F.col("_case") == "ok"
    has = ok | (F.col("_case") == "thin")
    reason = (
        F.when(F.col("_case") == "unresolved", "insufficient_trough_candidates").when(F.col("_case") == "no_previous", "no_previous_boundary").when(F.col("_case") == "thin", "insufficient_cycle_coverage")
        .when(F.col("from_record_start"), "record_start_boundary").when(bad_peak, "peak_low_quality").when(~provisional, "ok").otherwise("boundary_provisional")
    )
    status = F.when(F.col("_case") == "unresolved", "unresolved").when(ok & ~provisional, "complete").otherwise("partial")
    only = lambda c, cond=ok: F.when(cond, c)
    p, t = F.col("peak_extent_pct"), F.col("trough_extent_pct")
    return out.select(
        *key, status.alias("status"), reason.alias("status_reason"), only(F.when(provisional, "provisional").otherwise("confirmed")).alias("cycle_status"), only(F.col("hy_start"), has).alias("hy_start"), only(F.col("trough_month"), has).alias("hy_end"), only(F.col("cycle_months"), has).alias("cycle_months"), only(F.col("n_usable_months"), has).alias("n_usable_months"),
        only(F.col("peak_month")).alias("peak_month"), only(p).alias("peak_extent_pct"), only(F.col("peak_invalid_pct")).alias("peak_invalid_pct"), only(F.col("peak_selection_status")).alias("peak_selection_status"), only(F.col("peak_selection_support")).alias("peak_selection_support"),
        "trough_month", t.alias("trough_extent_pct"), "trough_invalid_pct", "boundary_status",
        only(F.col("mid.month")).alias("temporal_mid_dry_month"), only(F.col("mid.extent_pct")).alias("temporal_mid_dry_extent_pct"), only(F.col("half.month")).alias("half_loss_month"), only(F.col("half.extent_pct")).alias("half_loss_extent_pct"), only(F.col("half_loss_target_pct")).alias("half_loss_target_pct"),
        only(p - t).alias("drawdown_pct"), only(F.when(p > 0, t / p)).alias("persistence_ratio"), only(month_number("trough_month") - month_number("peak_month")).alias("recession_months"), only(month_number(F.col("half.month")) - month_number("peak_month")).alias("half_loss_months"), only(F.col("n_rewetting_pulses")).alias("n_rewetting_pulses"),
        F.when(ok, _grade(F.col("n_usable_months") / F.col("cycle_months"), F.col("_q"), F.col("_unknown"), provisional)).otherwise("low").alias("confidence"),
    )


@dataclass(frozen=True)
class YearOptions:
    """What own boundaries per year are looked for with: one set of options for all areas of a job."""

    expected_trough_month: int
    trough_search_radius_months: int = 3
    max_invalid_pct: float = 20.0
    allow_unknown_quality: bool = False
    quality_policy: str = "flag"

    def __post_init__(self) -> None:
        if self.expected_trough_month not in range(1, 13):
            raise ValueError("the expected month lies between 1 and 12")
        if self.trough_search_radius_months not in range(6):
            raise ValueError("the search radius lies between 0 and 5 months")
        if not 0 <= self.max_invalid_pct <= 100:
            raise ValueError("the share of invalid pixels lies between 0 and 100")
        if self.quality_policy not in ("exclude", "flag"):
            raise ValueError("poor quality is excluded or flagged")


#: Patterns without a trough phase to expect.
UNSTABLE = ("weak_or_irregular", "low_variability", "insufficient_record")


def suggest(patterns: DataFrame) -> DataFrame:
    """(aoi_id, expected_trough_month, expected_peak_month, error) from seasonal patterns (aoi_id, pattern, trough_month, peak_month): the months to look around, or why there are none."""
    none = F.col("pattern").isin(*UNSTABLE) | F.col("trough_month").isNull()
    keep = lambda c: F.when(~none, F.col(c)).alias(f"expected_{c}")
    return patterns.select("aoi_id", keep("trough_month"), keep("peak_month"), F.when(none, F.concat(F.lit("no stable trough phase: "), F.col("pattern"))).alias("error"))


def detect_with(records: DataFrame, options: YearOptions) -> DataFrame:
    """The annual table of all areas' records under the same options; faulty records are refused."""
    use = prepare_checked(records, max_invalid_pct=options.max_invalid_pct, allow_unknown_quality=options.allow_unknown_quality, quality_policy=options.quality_policy)
    return detect(cut(use), options.expected_trough_month, radius=options.trough_search_radius_months)


def detect(prepared: DataFrame, expected_trough_month: int | DataFrame, *, radius: int = 3) -> DataFrame:
    # one row per area, and per area and year, that many steps read
    scale = cut(robust_scale(prepared))
    found = cut(troughs(prepared, expected_trough_month, radius=radius, scale=scale))
    return cut(assemble(prepared, found, scale=scale))


def secondary_extrema(prepared: DataFrame, annual: DataFrame, patterns: DataFrame | None = None) -> DataFrame:
    """Second peaks and lows of each cycle's usable months, two places or more from the first ones (the earliest of equals).

    With ``patterns`` (aoi_id, pattern) only years of ``bimodal_or_complex`` areas have rows.
    """
    key = ["aoi_id", "hy_year"]
    if patterns is not None:
        annual = annual.join(patterns.where("pattern = 'bimodal_or_complex'").select("aoi_id"), "aoi_id", "left_semi")
    span = annual.where("peak_month IS NOT NULL").select(*key, "hy_start", "hy_end", "peak_month", "trough_month")
    rows = prepared.where("candidate_usable").join(span, "aoi_id").where("month BETWEEN hy_start AND hy_end")
    by = Window.partitionBy(*key)
    order = by.orderBy("month")
    v = F.col("extent_pct")
    rows = rows.withColumn("_i", F.row_number().over(order)).withColumn("_l", F.lag(v).over(order)).withColumn("_r", F.lead(v).over(order)).withColumn("_n", F.count("*").over(by))
    at = lambda c: F.least(F.count_if(F.col("month") < F.col(c)).over(by) + 1, F.col("_n"))
    rows = rows.withColumn("_pp", at("peak_month")).withColumn("_tp", at("trough_month"))
    up = (v > F.col("_l")) & (v >= F.col("_r")) & (F.abs(F.col("_i") - F.col("_pp")) >= 2)
    down = (v < F.col("_l")) & (v <= F.col("_r")) & (F.abs(F.col("_i") - F.col("_tp")) >= 2)
    best = lambda cond, s: F.min(F.when(cond, F.struct((s * v).alias("k"), "month", "extent_pct")))
    out = rows.groupBy(*key).agg(best(up, -1.0).alias("p"), best(down, 1.0).alias("t"))
    return out.select(*key, F.col("p.month").alias("secondary_peak_month"), r6("p.extent_pct").alias("secondary_peak_extent_pct"), F.col("t.month").alias("secondary_trough_month"), r6("t.extent_pct").alias("secondary_trough_extent_pct"))
