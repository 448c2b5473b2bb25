"""The engine's queries over the driver's tables, by inventory id."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.columns import r6
from .functions.lineage import cut, shared_dir
from .operators import boundary as bd
from .operators import condition as co
from .operators import distance as di
from .operators import dynamic_year as dy
from .operators import evaluate as va
from .operators import events as ev
from .operators import fidelity as fi
from .operators import fixed_year as fx
from .operators import history as hi
from .operators import phase as ph
from .operators import pixels as px
from .operators import prepare as pr
from .operators import rasterise as ra
from .operators import scale as sc
from .operators import season as se
from .operators import support as su
from .operators import tiles as ti
from .plans import batch as ba
from .plans import exports as ex
from .plans import routing as ro
from .sources import extent_cache as ca
from .sources import tables as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name] = f
        return f

    return put


def prepared(s: SparkSession, d: str, by: str = "region", seasonal: bool = True, floods: bool = False, **options) -> DataFrame:
    """The monthly records, written once: small, and read by many steps of a query."""
    return cut(pr.prepare(src.monthly_counts(s, d, by=by, seasonal=seasonal, floods=floods), **options))


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, for comparison."""
    return df.select(*[r6(c).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query("s2_normalise_frame")
def _(s, d):
    x = src.monthly_counts(s, d)
    x = x.select("aoi_id", "month", F.try_divide(F.lit(100.0) * F.col("n_water"), F.col("n_valid")).alias("extent_pct"))
    return rounded(pr.normalise_frame(x, "1996-01-01", "1999-12-01"))


@query("a1_prepare_monthly_extent")
def _(s, d):
    x = prepared(s, d, "nation", max_invalid_pct=40)
    return rounded(x.select("aoi_id", "month", "n_aoi", "n_valid", "n_invalid", "n_water", "extent_pct", "invalid_pct", "observed_fraction", "quality_state", "candidate_usable"))


@query("a1_prepare_exclude")
def _(s, d):
    return prepared(s, d, "nation", max_invalid_pct=40, quality_policy="exclude").select("aoi_id", "month", "quality_state", "candidate_usable")


@query("a2_complete_axis")
def _(s, d):
    return prepared(s, d, "nation").select("aoi_id", "month", F.col("n_aoi").isNull().alias("inserted"))


@query("a3_coerce_monthly")
def _(s, d):
    x = src.table(s, d, "events").select(F.col("user_id").cast("int").alias("aoi_id"), F.col("ts").alias("month"), F.col("event_id").alias("ordinal"), F.col("value").alias("extent_pct"))
    return rounded(pr.coerce_monthly(x).select("aoi_id", "month", "extent_pct"))


@query("a4_basin_counts")
def _(s, d):
    return rounded(pr.basin_from_counts(prepared(s, d, "nation", False)))


@query("a4_basin_weighted")
def _(s, d):
    w = src.table(s, d, "supplier").groupBy(F.col("s_nationkey").cast("int").alias("aoi_id")).agg(F.count("*").alias("w"))
    return rounded(pr.basin_weighted(prepared(s, d, "nation", False).join(w, "aoi_id"), "w"))


@query("a5_quality_flags")
def _(s, d):
    return pr.quality_flags(prepared(s, d, "nation"), 30).select("aoi_id", "month", "quality_flag")


@query("a6_quality_tally")
def _(s, d):
    return pr.quality_tally(prepared(s, d, "nation", max_invalid_pct=40))


@query("a7_rainfall_as_extent")
def _(s, d):
    return rounded(pr.rainfall_as_extent(src.rainfall(s, d)))


@query("a8_align_rainfall")
def _(s, d):
    return rounded(pr.align_rainfall(prepared(s, d), src.rainfall(s, d)))


@query("a10_climatology")
def _(s, d):
    return rounded(pr.climatology(prepared(s, d)))


@query("b1_robust_scale")
def _(s, d):
    return rounded(sc.robust_scale(prepared(s, d)))


@query("b2_noise_floor")
def _(s, d):
    return rounded(sc.noise_floor(prepared(s, d).where("candidate_usable")))


@query("b3_event_noise")
def _(s, d):
    return rounded(sc.noise_floor(prepared(s, d, "nation").where("candidate_usable"), deseason=False))


@query("b4_epsilon")
def _(s, d):
    p = prepared(s, d)
    return rounded(p.join(sc.robust_scale(p), "aoi_id").select("aoi_id", "month", sc.epsilon(F.col("amplitude_pp"), F.col("noise_pp"), F.col("n_valid")).alias("epsilon_pp")))


@query("b5_mean_water_fraction")
def _(s, d):
    return rounded(sc.mean_water_fraction(prepared(s, d)))


def _events(s, d, m):
    return prepared(s, d, "nation" if m == "quantile" else "region", False, floods=m == "noise")


for _m in ("noise", "quantile"):
    QUERIES[f"e1_thresholds_{_m}"] = lambda s, d, m=_m: rounded(ev.thresholds(_events(s, d, m), mode=m))
    QUERIES[f"e2_hysteresis_{_m}"] = lambda s, d, m=_m: ev.extract(_events(s, d, m), mode=m)[3].select("aoi_id", "month", "wet", "low")
    QUERIES[f"e5_wet_events_{_m}"] = lambda s, d, m=_m: ev.extract(_events(s, d, m), mode=m)[0]
    QUERIES[f"e6_low_spells_{_m}"] = lambda s, d, m=_m: ev.extract(_events(s, d, m), mode=m)[1]


@query("e4_merged_events")
def _(s, d):
    return ev.extract(prepared(s, d, "nation", False), mode="quantile", min_event_months=2, min_separation_months=2)[0]


@query("e7_event_summary")
def _(s, d):
    return ev.extract(prepared(s, d, "nation", False), mode="quantile", min_event_months=2, min_separation_months=2)[2]


@query("r1_qualifying_years")
def _(s, d):
    return se.years_with(prepared(s, d, "nation"), 9).groupBy("aoi_id", "yr").agg(F.count("*").alias("n_months"))


@query("r2_harmonic_fit")
def _(s, d):
    return rounded(se.harmonics(se.years_with(prepared(s, d), 12)).select("aoi_id", "n", "fit_order", "strength"))


@query("r3_local_extrema")
def _(s, d):
    return rounded(se.curve(se.harmonics(se.years_with(prepared(s, d), 12))).select("aoi_id", "moy", "value", "is_max", "is_min"))


@query("r4_seasonal_pattern")
def _(s, d):
    return rounded(se.pattern(prepared(s, d)))


def _draws(s, d):
    """Draws of 5 to 12 years for each supplier, by key arithmetic."""
    one = src.table(s, d, "supplier").select(F.col("s_suppkey").alias("replicate"), "s_nationkey", F.explode(F.sequence(F.lit(5), F.lit(12))).alias("n"))
    one = one.withColumn("j", F.explode(F.expr("sequence(0, n - 1)")))
    return one.select("n", "replicate", F.expr("cast((replicate * 31 + j * (s_nationkey + 7) + j * j) % n as int)").alias("i")).groupBy("n", "replicate", "i").agg(F.count("*").alias("k"))


QUERIES["r4_bootstrap_support"] = lambda s, d: rounded(su.seasonal_pattern(prepared(s, d), draws=_draws(s, d)))
QUERIES["r4_bootstrap_support_irregular"] = lambda s, d: rounded(su.seasonal_pattern(prepared(s, d, "nation", False), draws=_draws(s, d)))


@query("r10_annual_extremes")
def _(s, d):
    return se.annual_extremes(prepared(s, d, "nation", False))


@query("r9_amplitude_snr")
def _(s, d):
    return rounded(se.amplitude_snr(prepared(s, d, "nation")))


@query("r7_circular_peaks")
def _(s, d):
    return rounded(se.circular(se.annual_extremes(prepared(s, d, "nation", False)), "peak"))


@query("r6_circular_troughs")
def _(s, d):
    return rounded(se.circular(se.annual_extremes(prepared(s, d, "nation")), "trough"))


@query("r8_circular_summary")
def _(s, d):
    return rounded(se.circular_summary(se.annual_extremes(prepared(s, d, "nation", False)), "peak"))


@query("r12_regime")
def _(s, d):
    return rounded(se.assess(prepared(s, d)))


@query("r14_rainfall_comparison")
def _(s, d):
    p, r = prepared(s, d), pr.prepare(pr.rainfall_as_extent(src.rainfall(s, d)))
    side = lambda x: se.assess(x).join(se.peak_of_climatology(x), "aoi_id", "left")
    return rounded(se.compare_rainfall(side(p), side(r)))


@query("f7_windows_around_peak")
def _(s, d):
    return fx.around_peak(se.peak_of_climatology(prepared(s, d, "nation")))


@query("f3_fixed_years")
def _(s, d):
    return fx.detect(prepared(s, d))


@query("f3_fixed_years_irregular")
def _(s, d):
    return fx.detect(prepared(s, d, "nation", False))


@query("f6_label_months")
def _(s, d):
    p = prepared(s, d)
    return fx.label_months(p, fx.detect(p))


@query("f8_fixed_year_quality")
def _(s, d):
    p = prepared(s, d)
    x = fx.annotate_quality(fx.detect(p), p, max_invalid_pct=33)
    return rounded(x.select("aoi_id", "hy_year", "peak_invalid_pct", "mid_dry_invalid_pct", "end_dry_invalid_pct", "boundary_status", "status", "status_reason", "confidence"))


def _annual(s, d, tag):
    p = prepared(s, d, "nation", False, max_invalid_pct=40) if tag else prepared(s, d, max_invalid_pct=40)
    return p, dy.detect(p, 9)


def _part(columns: str, resolved: bool = True):
    def run(s, d, tag):
        a = _annual(s, d, tag)[1]
        return rounded((a.where("peak_month IS NOT NULL") if resolved else a).select(*columns.split()))

    return run


for _tag in ("", "_irregular"):
    QUERIES[f"y5_trough_opportunities{_tag}"] = lambda s, d, t=_tag: rounded(dy.troughs(prepared(s, d, "nation" if t else "region", not t, max_invalid_pct=40), 9))
    for _n, _c, _r in (
        ("y3_cycle_peaks", "aoi_id hy_year peak_month peak_selection_status peak_extent_pct peak_selection_support", True),
        ("y6_annual_table", "aoi_id hy_year status status_reason hy_start hy_end cycle_months n_usable_months peak_month peak_selection_status trough_month boundary_status confidence peak_extent_pct trough_extent_pct", False),
        ("y7_half_loss", "aoi_id hy_year half_loss_month half_loss_target_pct", True),
        ("y8_mid_dry", "aoi_id hy_year temporal_mid_dry_month", True),
        ("y9_rewetting_pulses", "aoi_id hy_year n_rewetting_pulses recession_months drawdown_pct persistence_ratio", True),
    ):
        QUERIES[f"{_n}{_tag}"] = lambda s, d, t=_tag, f=_part(_c, _r): f(s, d, t)


@query("y1_suggested_months")
def _(s, d):
    return dy.suggest(se.pattern(prepared(s, d, "nation", False)))


@query("y10_bimodal_extrema")
def _(s, d):
    p, a = _annual(s, d, "_irregular")
    return dy.secondary_extrema(p, a, se.pattern(p))


@query("y4_boundary_sequence")
def _(s, d):
    p = prepared(s, d, "nation", False, max_invalid_pct=40)
    years = cut(bd.trough_candidates(p, dy.troughs(p, 9, radius=5), F.make_date("hy_year", F.lit(9), F.lit(1))))
    named = lambda tolerance, name: bd.boundary_sequence(years, relative_tolerance=tolerance).withColumnRenamed("month", name)
    return named(None, "coherent").join(named(0.05, "within_5_pct"), ["aoi_id", "hy_year"]).join(named(0.0, "least_only"), ["aoi_id", "hy_year"])


@query("y10_secondary_extrema")
def _(s, d):
    p, a = _annual(s, d, "_irregular")
    return dy.secondary_extrema(p, a)


@query("c7_monthly_condition")
def _(s, d):
    return rounded(co.monthly_condition(prepared(s, d, "nation", False, max_invalid_pct=40)))


def _fixed_annual(s, d):
    return fx.detect(prepared(s, d, "nation", False)).select("aoi_id", "hy_year", "peak_extent_pct", F.col("end_extent_pct").alias("trough_extent_pct"), (F.col("confidence") != "low").alias("eligible"))


@query("c6_annual_condition")
def _(s, d):
    return rounded(co.annual_condition(_fixed_annual(s, d), min_baseline=4))


@query("c2_rolling_condition")
def _(s, d):
    return rounded(co.annual_condition(_fixed_annual(s, d).withColumn("eligible", F.lit(True)), mode="rolling"))


@query("f1_checked_windows")
def _(s, d):
    k = F.col("n_nationkey")
    w = src.table(s, d, "nation").select(k.cast("int").alias("aoi_id"), (k % 14).cast("int").alias("wet_start"), (k % 9 + 1).cast("int").alias("wet_len"), (k * 5 % 12 + 1).cast("int").alias("dry_start"), (k % 7 + 1).cast("int").alias("dry_len"))
    return fx.checked(w)


@query("f2_climatology_windows")
def _(s, d):
    return fx.from_climatology(prepared(s, d, "nation", False))


@query("f3_fixed_years_by_area")
def _(s, d):
    p = prepared(s, d, "nation", False)
    return fx.detect(p, fx.around_peak(se.peak_of_climatology(p)).drop("peak_month"))


@query("f9_from_dynamic")
def _(s, d):
    return rounded(fx.from_dynamic(_annual(s, d, "_irregular")[1]))


def _phased(s, d, tag):
    p, a = _annual(s, d, tag)
    return p, a, sc.robust_scale(p).select("aoi_id", "noise_pp")


@query("h1_levels")
def _(s, d):
    return rounded(ph.levels(prepared(s, d, "nation", False, max_invalid_pct=40)).select("aoi_id", "month", "level", "slope"))


@query("h2_crossings")
def _(s, d):
    return ph.crossings(*_phased(s, d, "_irregular")).select("aoi_id", "hy_year", "wet_start", "half_start", "half_seen", "dry_start")


for _tag in ("", "_irregular"):
    QUERIES[f"h4_phases{_tag}"] = lambda s, d, t=_tag: rounded(ph.assign(*_phased(s, d, t)))


_REGIMES = ("seasonal", "marginal", "aseasonal", "insufficient_record")


def _one_of(names: tuple[str, ...], k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in names]), (k % len(names) + 1).cast("int"))


@query("r14_divergence_rules")
def _(s, d):
    k = F.col("n_nationkey")
    n = src.table(s, d, "nation")
    e = n.select(k.cast("int").alias("aoi_id"), _one_of(_REGIMES, k).alias("regime"), (k / 10.0).alias("snr"), (k * 7 % 12 + 1).cast("int").alias("peak_month"))
    r = n.where("n_nationkey % 6 <> 5").select(k.cast("int").alias("aoi_id"), _one_of(_REGIMES, F.expr("n_nationkey div 4")).alias("regime"), (k / 5.0).alias("snr"), (k * 5 % 12 + 1).cast("int").alias("peak_month"))
    return se.compare_rainfall(e, r)


@query("r11_regime_rules")
def _(s, d):
    k = F.col("o_orderkey")
    return src.table(s, d, "orders").select(k.alias("id"), se.regime_label(k % 300 / 100, k % 11 / 10, k % 13 / 50, k % 17).alias("regime"))


@query("r13_route_rules")
def _(s, d):
    k = F.col("o_orderkey")
    o = src.table(s, d, "orders").select(k.cast("long").alias("id"), _one_of(_REGIMES, k).alias("regime"), F.when(k % 19 > 0, k % 11 / 10).alias("trough_ci_low"), (k % 7 / 40).alias("peak_uniformity_p"), (k % 9 / 50).alias("trough_uniformity_p"), (k % 10 / 10).alias("peak_concentration"), F.when(k % 23 > 0, k % 13 / 20).alias("trough_concentration"))
    return se.gates(o).select("id", "supports_per_year", "supports_fixed_window", "route")


@query("r12_explained")
def _(s, d):
    """Evidence with the concentration itself as its lower bound and a shifted Kuiper statistic as p, which SQL can follow, unlike resampling; routes with reasons and warnings from it.

    Seasonal regions and irregular nations (ids from 100 on), some with a short record, so that all regimes occur. Every fifth area has lost its usual months.
    """
    x = src.monthly_counts(s, d).unionByName(src.monthly_counts(s, d, by="nation", seasonal=False).withColumn("aoi_id", F.col("aoi_id") + 100))
    p = cut(pr.prepare(x.where("aoi_id % 7 <> 3 OR month < DATE '1996-01-01'"), max_invalid_pct=40))
    x = cut(se.annual_extremes(p))
    side = lambda v: se.circular(x, v).select("aoi_id", F.col("concentration").alias(f"{v}_concentration"), r6("concentration").alias(f"{v}_ci_low"), r6(F.col("kuiper") - 0.4).alias(f"{v}_uniformity_p"))
    months = p.groupBy("aoi_id").agg(F.count_if("candidate_usable").alias("n_usable_months"))
    e = months.join(x.groupBy("aoi_id").agg(F.count("*").alias("n_years")), "aoi_id", "left").join(se.amplitude_snr(p), "aoi_id", "left").join(side("peak"), "aoi_id", "left").join(side("trough"), "aoi_id", "left")
    e = e.withColumn("snr", F.col("snr") * (F.col("aoi_id") % 4) / 2).join(se.peak_of_climatology(p), "aoi_id", "left")
    e = e.withColumn("peak_month", F.when(F.col("aoi_id") % 5 > 0, F.col("peak_month"))).withColumn("trough_month", F.when(F.col("aoi_id") % 5 > 0, F.col("trough_month")))
    out = ro.reasons(se.explain(se.conclude(e), ev.extract(p, mode="quantile")[2]))
    return out.select("aoi_id", "regime", "route", "route_reason", "n_timing_years", "n_usable_months", "n_wet_events", "longest_low_spell_months", "years_without_wet_event", "recommended_action", F.array_join("caveats", "; ").alias("caveats"), F.array_join("warnings", "; ").alias("warnings"))


def _known(s, d):
    """Fixed years as known events, with the dynamic lows to be judged by them."""
    p, a = _annual(s, d, "_irregular")
    truth = fx.detect(p).select("aoi_id", F.col("hy_year").alias("event_id"), F.col("end_dry_month").alias("truth_month"), F.add_months("hy_start", -1).alias("interval_start"), F.col("hy_end").alias("interval_end"))
    return va.align(truth, a.select("aoi_id", F.col("trough_month").alias("actual_month")))


@query("o5_aligned_events")
def _(s, d):
    return _known(s, d).withColumn("delta_months", va.month_delta("actual_month", "truth_month"))


@query("o6_timing")
def _(s, d):
    return rounded(va.timing(_known(s, d)))


@query("o19_compare_series")
def _(s, d):
    return rounded(va.compare_series(prepared(s, d, "region", True), prepared(s, d, "region", False)))


def _export(s, d):
    p = prepared(s, d, "nation", False, max_invalid_pct=40)
    found, spells, _, _ = ev.extract(p, mode="quantile")
    return p, found, spells


@query("o7_monthly_export")
def _(s, d):
    p, found, spells = _export(s, d)
    return rounded(ex.monthly(p, fx.from_dynamic(dy.detect(p, 9)), found, spells, rainfall=pr.align_rainfall(p, src.rainfall(s, d))))


@query("o8_hydro_years_export")
def _(s, d):
    return rounded(ex.hydro_years(fx.from_dynamic(_annual(s, d, "_irregular")[1])))


@query("o8_wet_events_export")
def _(s, d):
    return ex.wet_events(_export(s, d)[1])


@query("o8_low_spells_export")
def _(s, d):
    return ex.low_spells(_export(s, d)[2])


@query("o21_hydro_years_wide")
def _(s, d):
    """Routes by signal-to-noise alone; areas with too weak a signal have no years."""
    p, a = _annual(s, d, "_irregular")
    snr = F.col("snr")
    routes = se.amplitude_snr(p).select("aoi_id", F.when(snr >= 1, "marginal").otherwise("aseasonal").alias("regime"), F.when(snr >= 1, "fixed_climatological_window").otherwise("event_characterisation").alias("route"))
    return rounded(ex.wide_hydro_years(fx.from_dynamic(a), routes))


@query("o22_annotated_months")
def _(s, d):
    p, found, spells = _export(s, d)
    return rounded(ex.annotated_months(p, found, spells, max_invalid_pct=35))


@query("o22_year_cards")
def _(s, d):
    p, a, noise = _phased(s, d, "_irregular")
    return rounded(ex.year_cards(p, a, ph.assign(p, a, noise)))


@query("o24_season_labels")
def _(s, d):
    return ex.season_labels(*_annual(s, d, "_irregular"))


@query("c5_qualified_conditions")
def _(s, d):
    noise = sc.robust_scale(prepared(s, d, "nation", False)).select("aoi_id", "noise_pp")
    return co.annual_condition(_fixed_annual(s, d), min_baseline=4, noise=noise).select("aoi_id", "hy_year", "recharge_condition_qualified", "refuge_condition_qualified", "annual_condition_qualified", "timing_confidence")


@query("o1_years_by_route")
def _(s, d):
    """Routes dealt to areas in turn, so that all of them occur."""
    p = prepared(s, d, "nation", False, max_invalid_pct=40)
    routes = cut(se.peak_of_climatology(p).withColumn("route", _one_of(("per_year_detection", "fixed_climatological_window", "event_characterisation"), F.col("aoi_id"))))
    years = ro.by_route(p, routes, max_invalid_pct=40)[0]
    return rounded(years.select("aoi_id", "hy_year", "hy_start", "hy_end", "peak_month", "end_dry_month", "amplitude_pct", "n_months_cycle", "boundary_source", "boundary_basis"))


@query("o3_summary_rows")
def _(s, d):
    return ro.summary_rows(ro.analyse(prepared(s, d)))


def _resolutions(s, d):
    """Records of the pixel masks as they are (30 m) and coarsened (60, 120 m), as an analysis with labels by signal-to-noise alone, quantile events and fixed years: all that SQL can follow."""
    mask = cut(_mask(s, d))
    snr = F.col("snr")
    out = {}
    for metres, factor in ((30, 1), (60, 2), (120, 4)):
        p = cut(pr.prepare(px.monthly_reduction(px.coarsen(mask, factor)).select("aoi_id", "month", "n_aoi", "n_valid", "n_water")))
        regime = F.when(snr >= se.SEASONAL_SNR, "seasonal").when(snr < se.ASEASONAL_SNR, "aseasonal").otherwise("marginal")
        route = F.when(snr >= se.SEASONAL_SNR, "per_year_detection").when(snr < se.ASEASONAL_SNR, "event_characterisation").otherwise("fixed_climatological_window")
        found, _, summary, _ = ev.extract(p, mode="quantile")
        years = cut(fx.detect(p).withColumn("low_month", F.col("end_dry_month")))
        out[metres] = (fi.Record(p, cut(se.amplitude_snr(p)).select("aoi_id", "snr", regime.alias("regime"), route.alias("route")), cut(summary), years), found)
    return out


def _fidelity(s, d):
    r = _resolutions(s, d)
    return cut(fi.compare(r[30][0], {k: v[0] for k, v in r.items() if k > 30}))


@query("o17_resolution_fidelity")
def _(s, d):
    return rounded(_fidelity(s, d))


@query("o17_resolution_decisions")
def _(s, d):
    return fi.recommend(_fidelity(s, d))


@query("o17_matched_events")
def _(s, d):
    r = _resolutions(s, d)
    return fi.match_spans(r[30][1], r[60][1], "event_id")


@query("o13_batch_outcomes")
def _(s, d):
    """Records of which some are broken on purpose, by area: a month repeated, counts that don't add up, negative counts, too few months; one requested area has none."""
    x = src.monthly_counts(s, d, by="nation", seasonal=False).withColumn("n_invalid", F.col("n_aoi") - F.col("n_valid"))
    k = F.col("aoi_id") % 9
    x = x.withColumn("n_invalid", F.when((k == 2) & (F.month("month") == 5), F.col("n_invalid") + 1).otherwise(F.col("n_invalid"))).withColumn("n_water", F.when((k == 3) & (F.month("month") == 7), -1).otherwise(F.col("n_water")))
    x = x.where((k != 4) | (F.year("month") == 1997)).where((k != 5) | (F.year("month") < 1996))
    x = x.unionByName(x.where((k == 1) & (F.month("month") == 3)).withColumn("month", F.date_add("month", 9)))
    areas = src.table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("aoi_id")).unionByName(x.select((F.max("aoi_id") + 1).alias("aoi_id")))
    b = ba.run_many(x, areas, start="1996-02-10", end="1999-11-03", analysed=False)
    found, spells, _, _ = ev.extract(b.records)
    n = lambda t, c: t.groupBy("aoi_id").agg(F.count("*").alias(c))
    return b.outcomes.join(n(found, "n_wet_events"), "aoi_id", "left").join(n(spells, "n_low_spells"), "aoi_id", "left")


@query("c3_low_variability")
def _(s, d):
    flat = src.table(s, d, "nation").where("n_nationkey % 5 = 0").select(F.col("n_nationkey").cast("int").alias("aoi_id"))
    return co.annual_condition(_fixed_annual(s, d), min_baseline=4, low_variability=flat).select("aoi_id", "hy_year", "recharge_condition", "refuge_condition", "annual_condition")


def _days(s, d):
    return px.day_mosaic(src.observations(s, d)).select("aoi_id", "month", "day", "y", "x", px.decode(F.col("raw")).alias("code"))


def _monthly(s, d):
    return px.monthly_composite(_days(s, d))


def _any(s, d):
    return px.monthly_composite(_days(s, d), majority=False)


def _mask(s, d):
    return px.clip(_monthly(s, d), src.aoi_cells(s, d)).select("aoi_id", "month", "y", "x", "code")


def _wet(s, d):
    return px.ever_wet(px.statistics(_mask(s, d)))


def _history(s, d):
    return px.historical_mask(px.statistics(_mask(s, d)), src.aoi_cells(s, d))


def _shapes(s, d):
    return src.aoi_cells(s, d).groupBy("aoi_id").agg((F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


def _decades(s, d):
    m = _mask(s, d)
    return [px.ever_wet(px.statistics(m.where(c))) for c in ("year(month) < 1995", "year(month) > 1996")]


def _fill(s, d):
    cells = src.aoi_cells(s, d).where("y + x < 40")
    return px.fill_inside(_monthly(s, d).withColumn("code", F.when(F.col("code") == 0, -2).otherwise(F.col("code"))), cells).select("aoi_id", "month", "y", "x", "code")


START, END = "1995-03-10", "1998-10-20"


def _counted(s, d):
    """A builder of monthly counts from pixels: only observations of the missing areas and years are read on; months without any are wholly invalid."""

    def build(pairs):
        obs = src.observations(s, d).withColumn("yr", F.year("month")).where(F.col("month").between(F.trunc(F.lit(START).cast("date"), "MM"), F.lit(END).cast("date"))).join(F.broadcast(pairs), ["aoi_id", "yr"], "left_semi").drop("yr")
        days = px.day_mosaic(obs).select("aoi_id", "month", "day", "y", "x", px.decode(F.col("raw")).alias("code"))
        cells = src.aoi_cells(s, d)
        counted = px.monthly_reduction(px.clip(px.monthly_composite(days), cells)).select("aoi_id", "month", "n_water", "n_valid", "n_dry")
        empty = px.unseen_months(cells, START, END).select("aoi_id", "month", "n_aoi").join(F.broadcast(pairs), "aoi_id").where("year(month) = yr")
        zero = lambda c: F.coalesce(c, F.lit(0))
        return empty.join(counted, ["aoi_id", "month"], "left").select("aoi_id", "month", zero("n_water").alias("n_water"), zero("n_valid").alias("n_valid"), (F.col("n_aoi") - zero("n_valid")).alias("n_invalid"), "n_aoi")

    return build


def _cache(s, d):
    """A new cache in the shared folder, filled for the first two years of two areas in five."""
    c = ca.ExtentCache(s, f"{shared_dir(s)}/extent-{uuid.uuid4().hex}", buckets=4)
    digests = [r["area_digest"] for r in ca.area_digests(src.aoi_cells(s, d)).orderBy("aoi_id").collect()]
    name = ca.request_digest(areas=digests, start=START, end=END, encoding="wofs", majority=True, resolution=None)
    wanted = cut(ca.wanted_years(src.aoi_cells(s, d), START, END))
    c.load(name, wanted.where("yr < 1997 AND aoi_id < 2"), _counted(s, d))
    return c, name, wanted


@query("s12_cached_extent")
def _(s, d):
    c, name, wanted = _cache(s, d)
    return rounded(c.load(name, wanted, _counted(s, d)))


@query("s28_completed_years")
def _(s, d):
    c, name, _ = _cache(s, d)
    return c.completed(name)


@query("p13_mask_versions")
def _(s, d):
    """Counts of a mask that was first built to 1996, then brought to 1999; the years to 1996 are gone by then."""
    h = hi.MaskHistory(s, f"{shared_dir(s)}/history-{uuid.uuid4().hex}")
    counts = cut(hi.yearly_counts(_mask(s, d)))
    h.resolve(counts, 1990, 1996)
    return h.resolve(counts.where("yr > 1996"), 1990, 1999)[0]


@query("p14_coverage_gaps")
def _(s, d):
    """Orders' and their customers' first and last dates as windows, against a coverage of 1996 and 1997."""
    o = src.table(s, d, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("b"))
    g = hi.coverage_gap(F.col("a"), F.col("b"), F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"))
    return o.select("o_custkey", g.alias("g")).select("o_custkey", "g.*")


@query("p31_wet_area_from_years")
def _(s, d):
    return hi.choose_wet_cells(counts=hi.yearly_counts(_mask(s, d)), years=(1995, 1998), cell_m=50.0)[0]


SIZES = {"candidates": (64, 32, 8), "tile_overhead": 40.0}


@query("p19_plan_tiles")
def _(s, d):
    return rounded(ti.plan_tiles(_sparse(s, d), _shapes(s, d), **SIZES))


@query("p19_planned_windows")
def _(s, d):
    c = cut(_sparse(s, d))
    return ti.planned_windows(ti.plan_tiles(c, _shapes(s, d), **SIZES), c, _shapes(s, d))


def _sparse(s, d):
    """Cells of which the areas hold more or less: every one, or only those of some columns."""
    return src.aoi_cells(s, d).where("aoi_id = 0 OR x % (40 * aoi_id) < 9")


@query("s10_tile_scan")
def _(s, d):
    """Water by tile, of tiles with cells of the area, without those on the list of tiles done."""
    path = f"{shared_dir(s)}/tiles-{uuid.uuid4().hex}"
    ti.write_tiles(_mask(s, d), path, 8)
    done = s.createDataFrame([(0, 0, 0), (1, 1, 2)], "aoi_id int, tile_y int, tile_x int")
    return ti.read_tiles(s, path, _sparse(s, d), 8, skip=done).groupBy("aoi_id", "tile_y", "tile_x").agg(F.count("*").alias("n_pixels"), F.count_if(F.col("code") == 1).alias("n_water"))


def _rings(s, d):
    """Polygons of five areas: bands of 64 parts each, whose sizes make their upper and lower bounds, and boxes of the suppliers that cut holes or stand beside them."""
    k = F.expr("p_partkey div 5")
    parts = src.table(s, d, "part").select((F.col("p_partkey") % 5).cast("int").alias("aoi_id"), F.expr("cast(p_partkey div 5 div 64 as int)").alias("ring"), (k * F.lit(1.5) + F.lit(0.37)).alias("x"), (F.col("p_size") % 7 + 9.25).alias("hi"), (7.75 - F.col("p_size") % 5).alias("lo"))
    side = lambda c, turn: F.transform(F.array_sort(F.collect_list(F.struct((turn * F.col("x")).alias("o"), "x", F.col(c).alias("y")))), lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y")))
    bands = parts.groupBy("aoi_id", "ring").agg(F.concat(side("hi", 1), side("lo", -1)).alias("points")).select("aoi_id", "points")
    x = F.expr("s_suppkey div 5") * F.lit(12.0) + F.lit(3.2)
    corner = lambda dx, y: F.struct((x + dx).alias("x"), F.lit(y).alias("y"))
    boxes = src.table(s, d, "supplier").select((F.col("s_suppkey") % 5).cast("int").alias("aoi_id"), F.array(corner(0.0, 8.1), corner(4.1, 8.1), corner(4.1, 8.9), corner(0.0, 8.9)).alias("points"))
    return bands.unionByName(boxes)


def _vector_grids(s, d):
    """A grid for each area, its rows downwards, as wide as its bands."""
    n = src.table(s, d, "part").groupBy((F.col("p_partkey") % 5).cast("int").alias("aoi_id")).agg((F.max(F.expr("p_partkey div 5")) * 3 / 2).cast("int").alias("width"))
    return n.select("aoi_id", *[F.lit(v).alias(c) for c, v in (("x0", 0.0), ("y0", 20.0), ("dx", 1.0), ("dy", -1.0), ("height", 18))], "width")


def _areas(s, d):
    k = F.col("n_nationkey")
    return src.table(s, d, "nation").select(k.cast("int").alias("aoi_id"), F.pow(F.lit(3.0), k % 13 + 14).alias("area_m2"), F.when(k % 3 > 0, k / 100).alias("amplitude_pp"))


QUERIES |= {
    "p1_decode": lambda s, d: _days(s, d),
    "p2_day_mosaic": lambda s, d: px.day_mosaic(src.observations(s, d)),
    "p3_monthly_composite": lambda s, d: _monthly(s, d),
    "p3_any_wet_composite": lambda s, d: _any(s, d),
    "p4_clip": lambda s, d: _mask(s, d),
    "p5_fill_inside": lambda s, d: _fill(s, d),
    "p6_monthly_reduction": lambda s, d: rounded(px.monthly_reduction(_mask(s, d))),
    "p6_wet_area_reduction": lambda s, d: rounded(px.monthly_reduction(_mask(s, d), wet=_history(s, d))),
    "p7_sum_tiles": lambda s, d: rounded(px.sum_tiles(px.monthly_reduction(_mask(s, d).withColumn("tile", F.expr("y div 4")), ["aoi_id", "month", "tile"]))),
    "p8_unseen_months": lambda s, d: px.unseen_months(src.aoi_cells(s, d), "2000-03-15", "2001-02-28"),
    "p33_complete_cube": lambda s, d: px.complete_cube(_monthly(s, d), src.aoi_cells(s, d)),
    "s16_statistics": lambda s, d: rounded(px.statistics(_mask(s, d))),
    "p10_ever_wet": lambda s, d: px.ever_wet(px.statistics(_mask(s, d)), 0.5),
    "p11_wet_area": lambda s, d: di.wet_area(_history(s, d), close_m=60, buffer_m=90),
    "p34_footprint_area": lambda s, d: di.wet_area(_wet(s, d)),
    "p25_rasterise": lambda s, d: ra.cells_touched(_rings(s, d), _vector_grids(s, d)),
    "p12_historical_mask": lambda s, d: _history(s, d),
    "p15_planning_footprint": lambda s, d: px.planning_footprint(_history(s, d)),
    "p16_union_inside": lambda s, d: px.union_inside(_decades(s, d), src.aoi_cells(s, d)),
    "p17_coarsen": lambda s, d: px.coarsen(_mask(s, d), 4),
    "p18_mismatches": lambda s, d: px.mismatches(_mask(s, d), _any(s, d)),
    "p20_active_windows": lambda s, d: px.active_windows(_wet(s, d), 4),
    "p21_grid_windows": lambda s, d: px.grid_windows(_shapes(s, d), 6),
    "p22_plan_resolution": lambda s, d: rounded(px.plan_resolution(_areas(s, d), budget_gb=0.05)),
    "p32_scenes_by_year": lambda s, d: px.scenes_by_year(src.observations(s, d)),
    "p35_same_cells": lambda s, d: px.same_cells(_history(s, d), _wet(s, d)),
    "p36_tiles_in": lambda s, d: px.tiles_in(px.active_windows(src.aoi_cells(s, d), 4), _history(s, d), 4),
    "p37_spans_tiles": lambda s, d: px.spans_tiles(src.aoi_cells(s, d), 64),
    "p38_containment": lambda s, d: px.uncontained(_monthly(s, d), src.aoi_cells(s, d)),
    "p39_differing": lambda s, d: px.differing(_mask(s, d), px.monthly_composite(_days(s, d).where("code >= 0"), majority=False)),
    "p40_fidelity": lambda s, d: rounded(px.fidelity(_mask(s, d), [2, 4])),
}
