"""DuckDB SQL for each query, written apart from the DataFrame code."""

from __future__ import annotations


def obs(by: str = "region", seasonal: bool | None = True) -> str:
    area = "n_regionkey" if by == "region" else "s_nationkey"
    k = "((month(l_shipdate) - 2 + 12) % 12)"
    wet = f"l_orderkey % 12 >= 2 * least({k}, 12 - {k})" if seasonal else "l_returnflag = 'R'"
    if seasonal is None:
        wet = "l_orderkey % 10 < CASE WHEN (year(l_shipdate) * 12 + month(l_shipdate)) % 19 < 2 THEN 9 ELSE 1 END"
    return f"""obs AS (SELECT {area}::INT AS aoi_id, date_trunc('month', l_shipdate)::DATE AS month, count(*) AS n_aoi, count(*) FILTER (l_returnflag <> 'N') AS n_valid,
  count(*) FILTER (l_returnflag <> 'N' AND {wet}) AS n_water FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""


def prep(by: str = "region", seasonal: bool | None = True, max_invalid: float = 20, policy: str = "flag") -> str:
    use = "extent_pct IS NOT NULL AND (invalid_pct IS NULL OR invalid_pct < 100)" if policy == "flag" else "quality_state = 'usable'"
    return f"""{obs(by, seasonal)},
axis AS (SELECT aoi_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM obs GROUP BY aoi_id),
prep0 AS (SELECT aoi_id, month, n_aoi, n_valid, n_aoi - n_valid AS n_invalid, n_water, 100.0::DOUBLE * n_water / nullif(n_valid, 0) AS extent_pct, 100.0::DOUBLE * (n_aoi - n_valid) / nullif(n_aoi, 0) AS invalid_pct FROM axis LEFT JOIN obs USING (aoi_id, month)),
prep1 AS (SELECT *, 1 - invalid_pct / 100 AS observed_fraction, CASE WHEN extent_pct IS NULL THEN 'missing' WHEN invalid_pct IS NULL THEN 'unknown' WHEN invalid_pct > {max_invalid} THEN 'low' ELSE 'usable' END AS quality_state FROM prep0),
prep AS (SELECT *, ({use}) AS usable FROM prep1)"""


RAIN = "rain AS (SELECT n_regionkey::INT AS aoi_id, date_trunc('month', o_orderdate)::DATE AS month, round(sum(o_totalprice::DECIMAL(18,2))::DOUBLE / 1000, 3) AS rainfall_mm FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)"


def noise(src: str, x: str, out: str) -> str:
    """CTEs: MAD noise of x over rows of src(aoi_id, month, x), named out(aoi_id, noise_pp)."""
    return f"""{out}_d AS (SELECT aoi_id, {x} - lag({x}) OVER (PARTITION BY aoi_id ORDER BY month) AS d FROM {src}),
{out}_c AS (SELECT aoi_id, quantile_cont(d, 0.5) AS c FROM {out}_d GROUP BY ALL),
{out} AS (SELECT aoi_id, 1.4826::DOUBLE * quantile_cont(abs(d - c), 0.5) / sqrt(2.0::DOUBLE) AS noise_pp FROM {out}_d JOIN {out}_c USING (aoi_id) GROUP BY ALL)"""


SCALE = """flat AS (SELECT aoi_id, month, extent_pct - quantile_cont(extent_pct, 0.5) OVER (PARTITION BY aoi_id, month(month)) AS x FROM prep WHERE usable),
""" + noise("flat", "x", "nz") + """,
scale AS (SELECT aoi_id, amplitude_pp, coalesce(noise_pp, 0) AS noise_pp FROM (SELECT aoi_id, quantile_cont(extent_pct, 0.9) - quantile_cont(extent_pct, 0.1) AS amplitude_pp FROM prep WHERE usable GROUP BY ALL) LEFT JOIN nz USING (aoi_id))"""


def floor_(deseason: bool) -> str:
    x = "extent_pct - quantile_cont(extent_pct, 0.5) OVER (PARTITION BY aoi_id, month(month))" if deseason else "extent_pct"
    return f"""fx AS (SELECT aoi_id, month, {x} AS x FROM prep WHERE usable),
{noise("fx", "x", "fz")},
fp AS (SELECT aoi_id, least(0.9, greatest(0, coalesce(CASE WHEN isnan(corr(x, p)) THEN 0 ELSE corr(x, p) END, 0))) AS phi FROM (SELECT *, lag(x) OVER (PARTITION BY aoi_id ORDER BY month) AS p FROM fx) WHERE p IS NOT NULL GROUP BY ALL),
fn AS (SELECT aoi_id, count(*) AS n, CASE WHEN count(*) < 3 OR min(x) = max(x) THEN 0 ELSE coalesce(any_value(noise_pp) / sqrt(1 - coalesce(any_value(phi), 0)), 0) END AS noise_pp FROM fx LEFT JOIN fz USING (aoi_id) LEFT JOIN fp USING (aoi_id) GROUP BY ALL)"""


def event_ctes(mode: str = "noise", min_months: int = 1, separation: int = 1, low_months: int = 2) -> str:
    flat = "noise_pp <= 0.01 * spread"
    byq = flat if mode == "noise" else "true"
    name = f"CASE WHEN {flat} THEN 'quantile_fallback' ELSE 'noise' END" if mode == "noise" else "'quantile'"
    return f"""{floor_(False)},
eq AS (SELECT aoi_id, quantile_cont(extent_pct, 0.5) AS baseline, quantile_cont(extent_pct, 0.75) AS q_in, quantile_cont(extent_pct, 0.2) AS q_low, quantile_cont(extent_pct, 0.9) - quantile_cont(extent_pct, 0.1) AS spread FROM prep WHERE usable GROUP BY ALL),
eb AS (SELECT aoi_id, max(extent_pct) AS below FROM prep JOIN eq USING (aoi_id) WHERE usable AND extent_pct < baseline GROUP BY ALL),
lim AS (SELECT aoi_id, baseline, CASE WHEN {byq} THEN q_in ELSE baseline + 3 * noise_pp END AS enter_t, CASE WHEN {byq} THEN baseline ELSE baseline + noise_pp END AS exit_t,
  CASE WHEN {byq} THEN CASE WHEN q_low >= baseline THEN coalesce(below, q_low) ELSE q_low END ELSE baseline - noise_pp END AS low_t, noise_pp, {name} AS threshold_mode FROM eq JOIN fn USING (aoi_id) LEFT JOIN eb USING (aoi_id)),
es0 AS (SELECT p.*, baseline, enter_t, exit_t, low_t, threshold_mode, CASE WHEN usable THEN extent_pct END AS v, row_number() OVER (PARTITION BY aoi_id ORDER BY month) AS pos FROM prep p JOIN lim USING (aoi_id)),
es AS (SELECT *, coalesce(last_value(CASE WHEN v IS NULL THEN false WHEN v > enter_t THEN true WHEN v <= exit_t THEN false END IGNORE NULLS) OVER (PARTITION BY aoi_id ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS wet, coalesce(v <= low_t, false) AS low FROM es0),
blk AS (SELECT aoi_id, min(pos) AS p0, max(pos) AS p1 FROM (SELECT *, pos - row_number() OVER (PARTITION BY aoi_id ORDER BY pos) AS b FROM es WHERE wet) GROUP BY aoi_id, b),
mrg AS (SELECT aoi_id, min(p0) AS p0, max(p1) AS p1 FROM (SELECT *, sum(s) OVER (PARTITION BY aoi_id ORDER BY p0) AS g FROM (SELECT *, coalesce((p0 - lag(p1) OVER (PARTITION BY aoi_id ORDER BY p0) - 1 >= {separation})::INT, 1) AS s FROM blk)) GROUP BY aoi_id, g),
ev0 AS (SELECT aoi_id, p0, p1, min(month) AS start_month, max(month) AS end_month, any_value(baseline) AS baseline, arg_min(month, (-v, month)) FILTER (v IS NOT NULL) AS peak_month, max(v) AS peak, avg(v) AS mean, sum(greatest(coalesce(v - exit_t, 0), 0)) AS mag
  FROM es JOIN mrg USING (aoi_id) WHERE pos BETWEEN p0 AND p1 AND p1 - p0 + 1 >= {min_months} GROUP BY ALL),
ev AS (SELECT aoi_id, (row_number() OVER (PARTITION BY aoi_id ORDER BY p0))::INT AS event_id, start_month, end_month, (p1 - p0 + 1)::INT AS duration_months, round(baseline, 6) AS baseline_extent_pct, peak_month, round(peak, 6) AS peak_extent_pct, round(mean, 6) AS mean_extent_pct, round(mag, 6) AS magnitude_pp_months FROM ev0),
ls AS (SELECT aoi_id, (row_number() OVER (PARTITION BY aoi_id ORDER BY start_month))::INT AS low_spell_id, start_month, end_month, duration_months, baseline_extent_pct, min_extent_pct FROM (SELECT aoi_id, min(month) AS start_month, max(month) AS end_month, count(*)::INT AS duration_months, round(any_value(baseline), 6) AS baseline_extent_pct, round(min(v), 6) AS min_extent_pct
  FROM (SELECT *, pos - row_number() OVER (PARTITION BY aoi_id ORDER BY pos) AS b FROM es WHERE low) GROUP BY aoi_id, b HAVING count(*) >= {low_months}))"""


ORACLES: dict[str, str] = {}


def add(name: str, sql: str) -> None:
    ORACLES[name] = sql.replace("WITH ", "WITH RECURSIVE ", 1) if sql.startswith("WITH ") else sql


P = "round(extent_pct, 6) AS extent_pct, round(invalid_pct, 6) AS invalid_pct"
add("s2_normalise_frame", f"WITH {obs()} SELECT aoi_id, month, round(100.0::DOUBLE * n_water / nullif(n_valid, 0), 6) AS extent_pct, 0.0::DOUBLE AS invalid_pct FROM obs WHERE month BETWEEN DATE '1996-01-01' AND DATE '1999-12-01'")
add("a1_prepare_monthly_extent", f"WITH {prep('nation', max_invalid=40)} SELECT aoi_id, month, n_aoi, n_valid, n_invalid, n_water, {P}, round(observed_fraction, 6) AS observed_fraction, quality_state, usable AS candidate_usable FROM prep")
add("a1_prepare_exclude", f"WITH {prep('nation', max_invalid=40, policy='exclude')} SELECT aoi_id, month, quality_state, usable AS candidate_usable FROM prep")
add("a2_complete_axis", f"WITH {prep('nation')} SELECT aoi_id, month, (n_aoi IS NULL) AS inserted FROM prep")
add("a3_coerce_monthly", "WITH e AS (SELECT user_id::INT AS aoi_id, date_trunc('month', ts)::DATE AS month, event_id, value FROM events) SELECT aoi_id, month, round(value, 6) AS extent_pct FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id, month ORDER BY event_id) AS n FROM e) WHERE n = 1 AND value IS NOT NULL")
add("a4_basin_counts", f"WITH {prep('nation', seasonal=False)}, t AS (SELECT count(DISTINCT aoi_id) AS n FROM prep) SELECT month, round(100.0::DOUBLE * sum(n_water) / nullif(sum(n_valid), 0), 6) AS extent_pct, round(100.0::DOUBLE * sum(n_invalid) / nullif(sum(n_aoi), 0), 6) AS invalid_pct, sum(n_water)::BIGINT AS n_water, sum(n_valid)::BIGINT AS n_valid, sum(n_invalid)::BIGINT AS n_invalid, sum(n_aoi)::BIGINT AS n_aoi, count(DISTINCT aoi_id) AS n_aoi_reporting, any_value(t.n) AS n_aoi_expected, round(100.0::DOUBLE * count(DISTINCT aoi_id) / any_value(t.n), 6) AS aoi_coverage_pct FROM prep, t GROUP BY month")
add("a4_basin_weighted", f"WITH {prep('nation', seasonal=False)}, w AS (SELECT s_nationkey::INT AS aoi_id, count(*) AS w FROM supplier GROUP BY ALL), t AS (SELECT count(DISTINCT aoi_id) AS n FROM prep) SELECT month, round(sum(extent_pct * w) / nullif(sum(w), 0), 6) AS extent_pct, count(DISTINCT aoi_id) AS n_aoi_reporting, any_value(t.n) AS n_aoi_expected, round(100.0::DOUBLE * count(DISTINCT aoi_id) / any_value(t.n), 6) AS aoi_coverage_pct FROM prep JOIN w USING (aoi_id), t GROUP BY month")
add("a5_quality_flags", f"WITH {prep('nation')} SELECT aoi_id, month, CASE WHEN extent_pct IS NULL THEN 'missing_extent' WHEN invalid_pct IS NULL THEN 'unknown_invalid_pct' WHEN invalid_pct > 30 THEN 'high_invalid_pct' ELSE 'usable' END AS quality_flag FROM prep")
add("a6_quality_tally", f"WITH {prep('nation', max_invalid=40)} SELECT aoi_id, {', '.join(f'''count(*) FILTER (quality_state = '{x}') AS n_{x}''' for x in ('missing', 'unknown', 'low', 'usable'))}, count(*) FILTER (usable) AS n_candidates, count(*) AS n_months FROM prep GROUP BY aoi_id")
add("a7_rainfall_as_extent", f"WITH {RAIN} SELECT aoi_id, month, round(least(100, greatest(0, 100 * rainfall_mm / nullif(max(rainfall_mm) OVER (PARTITION BY aoi_id), 0))), 6) AS extent_pct, 0.0::DOUBLE AS invalid_pct FROM rain")
add("a8_align_rainfall", f"WITH {prep()}, {RAIN}, j AS (SELECT p.aoi_id, p.month, rainfall_mm FROM prep p LEFT JOIN rain r USING (aoi_id, month)) SELECT aoi_id, month, rainfall_mm, round(rainfall_mm - quantile_cont(rainfall_mm, 0.5) OVER (PARTITION BY aoi_id, month(month)), 6) AS rainfall_anomaly_mm FROM j")
add("a10_climatology", f"WITH {prep()}, c AS (SELECT aoi_id, month(month)::INT AS moy, avg(extent_pct) AS mean, coalesce(stddev_samp(extent_pct), 0) AS sd FROM prep GROUP BY ALL) SELECT aoi_id, moy, round(mean, 6) AS mean, round(sd, 6) AS sd, round(greatest(0, mean - sd), 6) AS low, round(mean + sd, 6) AS high FROM c")
add("b1_robust_scale", f"WITH {prep()}, {SCALE} SELECT aoi_id, round(amplitude_pp, 6) AS amplitude_pp, round(noise_pp, 6) AS noise_pp FROM scale")
add("b2_noise_floor", f"WITH {prep()}, {floor_(True)} SELECT aoi_id, n, round(noise_pp, 6) AS noise_pp FROM fn")
add("b3_event_noise", f"WITH {prep('nation')}, {floor_(False)} SELECT aoi_id, n, round(noise_pp, 6) AS noise_pp FROM fn")
add("b4_epsilon", f"WITH {prep()}, {SCALE} SELECT p.aoi_id, p.month, round(CASE WHEN amplitude_pp <= 0 THEN 0 ELSE least(0.1 * amplitude_pp, greatest(coalesce(100.0::DOUBLE / nullif(n_valid, 0), 0), noise_pp)) END, 6) AS epsilon_pp FROM prep p JOIN scale USING (aoi_id)")
add("b5_mean_water_fraction", f"WITH {prep()} SELECT aoi_id, round(avg(extent_pct) / 100, 6) AS mean_fraction FROM prep GROUP BY ALL")
for m in ("noise", "quantile"):
    E = f"WITH {prep('nation' if m == 'quantile' else 'region', seasonal=None if m == 'noise' else False)}, {event_ctes(m)}"
    add(f"e1_thresholds_{m}", f"{E} SELECT aoi_id, round(baseline, 6) AS baseline, round(enter_t, 6) AS enter_t, round(exit_t, 6) AS exit_t, round(low_t, 6) AS low_t, round(noise_pp, 6) AS noise_pp, threshold_mode FROM lim")
    add(f"e2_hysteresis_{m}", f"{E} SELECT aoi_id, month, wet, low FROM es")
    add(f"e5_wet_events_{m}", f"{E} SELECT * FROM ev")
    add(f"e6_low_spells_{m}", f"{E} SELECT * FROM ls")
E2 = f"WITH {prep('nation', seasonal=False)}, {event_ctes('quantile', 2, 2, 2)}"
add("e4_merged_events", f"{E2} SELECT * FROM ev")
add("e7_event_summary", f"""{E2}, g AS (SELECT *, date_diff('day', lag(start_month) OVER (PARTITION BY aoi_id ORDER BY event_id), start_month) / 30.44::DOUBLE AS gap FROM ev),
a AS (SELECT aoi_id, count(*) AS n_events, max(duration_months) AS longest_event_months, round(quantile_cont(gap, 0.5), 6) AS median_gap_months, round(sum(magnitude_pp_months), 6) AS total_magnitude FROM g GROUP BY ALL),
s AS (SELECT aoi_id, count(*) AS n_low_spells, max(duration_months) AS longest_low_spell_months FROM ls GROUP BY ALL),
ym AS (SELECT DISTINCT aoi_id, year(m) AS yr FROM (SELECT aoi_id, unnest(generate_series(start_month, end_month, INTERVAL 1 MONTH)) AS m FROM ev)),
y AS (SELECT aoi_id, count(*) AS n_years_without_event FROM (SELECT DISTINCT aoi_id, year(month) AS yr FROM es) e WHERE NOT EXISTS (SELECT 1 FROM ym WHERE ym.aoi_id = e.aoi_id AND ym.yr = e.yr) GROUP BY ALL),
b AS (SELECT aoi_id, count(*) AS n_months, count(v) AS n_observed, round(100.0::DOUBLE * count(*) FILTER (low) / nullif(count(v), 0), 6) AS pct_months_low, round(any_value(baseline), 6) AS baseline_extent_pct, any_value(threshold_mode) AS threshold_mode FROM es GROUP BY ALL)
SELECT b.*, longest_event_months, median_gap_months, total_magnitude, coalesce(n_events, 0) AS n_events, coalesce(n_low_spells, 0) AS n_low_spells, coalesce(longest_low_spell_months, 0)::INT AS longest_low_spell_months, coalesce(n_years_without_event, 0) AS n_years_without_event FROM b LEFT JOIN a USING (aoi_id) LEFT JOIN s USING (aoi_id) LEFT JOIN y USING (aoi_id)""")


def years_cte(name: str, k: int) -> str:
    return f"""{name} AS (SELECT *, year(month)::INT AS yr FROM prep WHERE usable AND (aoi_id, year(month)) IN (SELECT (aoi_id, year(month)) FROM prep WHERE usable GROUP BY aoi_id, year(month) HAVING count(DISTINCT month(month)) >= {k}))"""


HARM_OF = f"""hb AS (SELECT aoi_id, avg(extent_pct) AS b0, {', '.join(f"2 * avg(extent_pct * {f}({h} * (month(month) - 1) * 2 * pi() / 12)) AS {n}{h}" for h in (1, 2) for n, f in (('s', 'sin'), ('c', 'cos')))} FROM full12 GROUP BY ALL),
hr AS (SELECT aoi_id, b0, s1, c1, s2, c2, count(*) AS n, sum((y - b0) ** 2) AS r0, sum((y - b0 - e1) ** 2) AS r1, sum((y - b0 - e1 - e2) ** 2) AS r2 FROM (SELECT *, extent_pct AS y, s1 * sin(t) + c1 * cos(t) AS e1, s2 * sin(2 * t) + c2 * cos(2 * t) AS e2 FROM (SELECT *, (month(month) - 1) * 2 * pi() / 12 AS t FROM full12 JOIN hb USING (aoi_id))) GROUP BY ALL),
ho AS (SELECT *, CASE WHEN a0 <= a1 AND a0 <= a2 THEN 0 WHEN a1 <= a2 THEN 1 ELSE 2 END AS o FROM (SELECT *, n * ln(r0 / n) + 2 + 4.0 / (n - 2) AS a0, n * ln(r1 / n) + 6 + 24.0 / (n - 4) AS a1, n * ln(r2 / n) + 10 + 60.0 / (n - 6) AS a2 FROM hr)),
hc AS (SELECT aoi_id, moy, o, 1 - (CASE o WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END) / r0 AS strength, b0 + CASE WHEN o >= 1 THEN s1 * sin(t) + c1 * cos(t) ELSE 0 END + CASE WHEN o >= 2 THEN s2 * sin(2 * t) + c2 * cos(2 * t) ELSE 0 END AS value FROM (SELECT *, (moy - 1) * 2 * pi() / 12 AS t FROM ho, (SELECT unnest(range(1, 13))::INT AS moy))),
hx AS (SELECT a.aoi_id, a.moy, a.o, a.strength, a.value, a.value > l.value AND a.value >= r.value AS is_max, a.value < l.value AND a.value <= r.value AS is_min FROM hc a JOIN hc l ON l.aoi_id = a.aoi_id AND l.moy = (a.moy + 10) % 12 + 1 JOIN hc r ON r.aoi_id = a.aoi_id AND r.moy = a.moy % 12 + 1)"""
HARM = f"{years_cte('full12', 12)},\n{HARM_OF}"
add("r1_qualifying_years", f"WITH {prep('nation')}, {years_cte('q', 9)} SELECT aoi_id, yr, count(*) AS n_months FROM q GROUP BY ALL")
add("r2_harmonic_fit", f"WITH {prep()}, {HARM} SELECT aoi_id, n, o AS fit_order, round(1 - (CASE o WHEN 0 THEN r0 WHEN 1 THEN r1 ELSE r2 END) / r0, 6) AS strength FROM ho")
add("r3_local_extrema", f"WITH {prep()}, {HARM} SELECT aoi_id, moy, round(value, 6) AS value, is_max, is_min FROM hx")
add("r4_seasonal_pattern", f"""WITH {prep()}, {HARM}, pk AS (SELECT aoi_id, arg_max(moy, (value, -moy)) FILTER (is_max) AS p, arg_min(moy, (value, moy)) FILTER (is_min) AS t, max(value) - min(value) AS rg, any_value(o) AS o, count(*) FILTER (is_max) AS mx, any_value(strength) AS strength FROM hx GROUP BY ALL)
SELECT aoi_id, CASE WHEN rg <= 1 THEN 'low_variability' WHEN o = 0 THEN 'weak_or_irregular' WHEN mx = 1 THEN 'unimodal_annual' ELSE 'bimodal_or_complex' END AS pattern, p AS peak_month, t AS trough_month, round(strength, 6) AS strength, (SELECT count(DISTINCT yr) FROM full12 f WHERE f.aoi_id = pk.aoi_id) AS n_complete_years FROM pk""")
SHAPE = f"""{HARM_OF}, sh AS (SELECT aoi_id, max(value) - min(value) AS rg, any_value(o) AS o, count(*) FILTER (is_max) AS mx, any_value(strength) AS strength, arg_max(moy, (value, -moy)) AS hi, arg_min(moy, (value, moy)) AS lo,
  list(moy ORDER BY value DESC, moy) FILTER (is_max) AS tops, list(moy ORDER BY value, moy) FILTER (is_min) AS lows FROM hx GROUP BY ALL)
SELECT aoi_id, CASE WHEN rg <= 1 THEN 'low_variability' WHEN o = 0 THEN 'weak_or_irregular' WHEN mx = 1 THEN 'unimodal_annual' ELSE 'bimodal_or_complex' END AS label, strength, hi, lo, tops, lows FROM sh"""
for by_, se_, tag in (("region", True, ""), ("nation", False, "_irregular")):
    add(f"r4_bootstrap_support{tag}", f"""WITH {prep(by_, se_)}, {years_cte('all12', 12)},
yrs AS (SELECT aoi_id, yr, row_number() OVER (PARTITION BY aoi_id ORDER BY yr) - 1 AS i, count(*) OVER (PARTITION BY aoi_id) AS n FROM (SELECT DISTINCT aoi_id, yr FROM all12)),
own AS (WITH full12 AS (SELECT * FROM all12 WHERE aoi_id IN (SELECT aoi_id FROM yrs WHERE n >= 5)), {SHAPE}),
pick AS (SELECT n, s_suppkey AS r, (s_suppkey * 31 + j * (s_nationkey + 7) + j * j) % n AS i FROM supplier, (SELECT n, unnest(range(n)) AS j FROM (SELECT DISTINCT n FROM yrs WHERE n >= 5))),
boot AS (WITH full12 AS (SELECT yrs.aoi_id * 10000000 + r AS aoi_id, month, extent_pct FROM yrs JOIN pick ON pick.n = yrs.n AND pick.i = yrs.i JOIN all12 a ON a.aoi_id = yrs.aoi_id AND a.yr = yrs.yr), {SHAPE}),
bl AS (SELECT aoi_id // 10000000 AS aoi_id, label, hi, lo FROM boot),
sup AS (SELECT aoi_id, count(*) FILTER (bl.label = own.label) / count(*)::DOUBLE AS support FROM bl JOIN own USING (aoi_id) GROUP BY ALL),
bm AS (SELECT aoi_id, w, m, 2 * pi() * (m - 1) / 12 AS t FROM bl, LATERAL (VALUES ('hi', hi), ('lo', lo)) x(w, m)),
bc AS (SELECT aoi_id, w, avg(cos(t)) AS c, avg(sin(t)) AS s FROM bm GROUP BY ALL),
iq AS (SELECT aoi_id, w, quantile_cont(o, 0.75) - quantile_cont(o, 0.25) AS iqr FROM (SELECT aoi_id, w, atan2(round(sin(t - atan2(s, c)), 12) + 0.0, cos(t - atan2(s, c))) * 12 / (2 * pi()) AS o FROM bm JOIN bc USING (aoi_id, w)) GROUP BY ALL)
SELECT aoi_id, CASE WHEN label IS NULL THEN 'insufficient_record' WHEN label <> 'low_variability' AND support < 0.8 THEN 'weak_or_irregular' ELSE label END AS pattern, CASE WHEN label <> 'low_variability' THEN coalesce(tops[1], hi) END AS peak_month, CASE WHEN label <> 'low_variability' THEN coalesce(lows[1], lo) END AS trough_month,
  tops[2] AS secondary_peak_month, lows[2] AS secondary_trough_month, round(coalesce(strength, 0), 6) AS strength, round(coalesce(support, 0), 6) AS bootstrap_support, round((SELECT iqr FROM iq WHERE iq.aoi_id = a.aoi_id AND w = 'hi'), 6) AS peak_phase_iqr_months, round((SELECT iqr FROM iq WHERE iq.aoi_id = a.aoi_id AND w = 'lo'), 6) AS trough_phase_iqr_months,
  (SELECT count(*) FROM yrs WHERE yrs.aoi_id = a.aoi_id) AS n_complete_years FROM (SELECT DISTINCT aoi_id FROM prep) a LEFT JOIN own USING (aoi_id) LEFT JOIN sup USING (aoi_id)""")
EXT = f"""{years_cte('q9', 9)}, ext AS (SELECT aoi_id, yr, month(arg_min(month, (-extent_pct, month)))::INT AS peak, month(arg_min(month, (extent_pct, month)))::INT AS trough FROM q9 GROUP BY ALL)"""
add("r10_annual_extremes", f"WITH {prep('nation', seasonal=False)}, {EXT} SELECT * FROM ext")
add("r9_amplitude_snr", f"WITH {prep('nation')}, {EXT}, m AS (SELECT aoi_id, month(month) AS k, avg(extent_pct) AS m, stddev_samp(extent_pct) AS s FROM q9 GROUP BY ALL) SELECT aoi_id, round((max(m) - min(m)) / avg(s), 6) AS snr FROM m GROUP BY ALL")


def circ(v: str) -> str:
    t = f"(({v} - 1) * 2 * pi() / 12)"
    return f"""cc AS (SELECT aoi_id, avg(cos({t})) AS c, avg(sin({t})) AS s, count(*) AS n FROM ext GROUP BY ALL),
co AS (SELECT *, atan2(round(sin(d), 12) + 0.0, cos(d)) * 12 / (2 * pi()) AS o FROM (SELECT aoi_id, yr, {v} AS v, c, s, n, {t} - atan2(s, c) AS d, row_number() OVER (PARTITION BY aoi_id ORDER BY {v}, yr) AS i FROM ext JOIN cc USING (aoi_id))),
cs AS (SELECT aoi_id, any_value(n) AS n, sqrt(any_value(c) ** 2 + any_value(s) ** 2) AS concentration, CASE WHEN any_value(n) >= 4 THEN quantile_cont(o, 0.75) - quantile_cont(o, 0.25) END AS iqr_months, max(i::DOUBLE / n - (v - 1) / 12.0::DOUBLE) + max((v - 1) / 12.0::DOUBLE - (i - 1)::DOUBLE / n) AS kuiper FROM co GROUP BY ALL)"""


add("r7_circular_peaks", f"WITH {prep('nation', seasonal=False)}, {EXT}, {circ('peak')} SELECT aoi_id, n, round(concentration, 6) AS concentration, round(iqr_months, 6) AS iqr_months, round(kuiper, 6) AS kuiper FROM cs")
add("r6_circular_troughs", f"WITH {prep('nation')}, {EXT}, {circ('trough')} SELECT aoi_id, n, round(concentration, 6) AS concentration, round(iqr_months, 6) AS iqr_months, round(kuiper, 6) AS kuiper FROM cs")

PEAKCLIM = f"{years_cte('q9', 9)}, pc AS (SELECT aoi_id, arg_min(k, (-m, k))::INT AS peak_month, arg_min(k, (m, k))::INT AS trough_month FROM (SELECT aoi_id, month(month) AS k, round(avg(extent_pct), 6) AS m FROM q9 GROUP BY ALL) GROUP BY ALL)"
add("f7_windows_around_peak", f"WITH {prep('nation')}, {PEAKCLIM} SELECT aoi_id, peak_month, ((peak_month + 9) % 12 + 1)::INT AS wet_start, 6 AS wet_len, ((peak_month + 3) % 12 + 1)::INT AS dry_start, 6 AS dry_len FROM pc")
FIXED = f"""seen AS (SELECT aoi_id, month, extent_pct AS v FROM prep WHERE extent_pct IS NOT NULL AND invalid_pct < 100),
sp AS (SELECT aoi_id, min(month) AS f, max(month) AS l FROM seen GROUP BY ALL),
yw AS (SELECT aoi_id, yr, make_date(yr - 1, 11, 1) AS w0, make_date(yr, 4, 1) AS w1, make_date(yr, 7, 1) AS d0, make_date(yr, 12, 1) AS d1 FROM (SELECT aoi_id, unnest(range(year(f), year(l) + 1))::INT AS yr FROM sp)),
wet AS (SELECT yw.aoi_id, yr, month, v, max(v) OVER (PARTITION BY yw.aoi_id, yr) AS b, count(*) OVER (PARTITION BY yw.aoi_id, yr) AS n FROM yw JOIN seen s ON s.aoi_id = yw.aoi_id AND month BETWEEN w0 AND w1),
dry AS (SELECT yw.aoi_id, yr, month, v, min(v) OVER (PARTITION BY yw.aoi_id, yr) AS b, count(*) OVER (PARTITION BY yw.aoi_id, yr) AS n FROM yw JOIN seen s ON s.aoi_id = yw.aoi_id AND month BETWEEN d0 AND d1),
pk AS (SELECT aoi_id, yr, month AS pm, v AS pv FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id, yr ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY aoi_id, yr) AS k FROM wet WHERE v = b AND n >= 2) WHERE i = k // 2),
en AS (SELECT aoi_id, yr, month AS em, v AS ev FROM (SELECT *, row_number() OVER (PARTITION BY aoi_id, yr ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY aoi_id, yr) AS k FROM dry WHERE v = b AND n >= 2) WHERE i = k // 2),
fm AS (SELECT aoi_id, yr, arg_min(month, (d, month)) AS mm, arg_min(v, (d, month)) AS mv FROM (SELECT pk.aoi_id, pk.yr, month, v, abs(2 * (month - DATE '1970-01-01') - (pm - DATE '1970-01-01') - (em - DATE '1970-01-01')) AS d FROM pk JOIN en USING (aoi_id, yr) JOIN seen s ON s.aoi_id = pk.aoi_id AND month BETWEEN pm AND em) GROUP BY ALL),
fy0 AS (SELECT aoi_id, yr AS hy_year, coalesce((lag(em) OVER (PARTITION BY aoi_id ORDER BY yr) + INTERVAL 1 MONTH)::DATE, f) AS hy_start, em AS hy_end, pm AS peak_month, round(pv, 6) AS peak_extent_pct, mm AS mid_dry_month, round(mv, 6) AS mid_extent_pct, em AS end_dry_month, round(ev, 6) AS end_extent_pct, round(pv - ev, 6) AS amplitude_pct FROM pk JOIN en USING (aoi_id, yr) JOIN fm USING (aoi_id, yr) JOIN sp USING (aoi_id)),
fy1 AS (SELECT *, (year(hy_end) * 12 + month(hy_end) - year(hy_start) * 12 - month(hy_start) + 1)::INT AS n_months_cycle FROM fy0),
{floor_(True).replace('FROM prep WHERE usable', 'FROM (SELECT aoi_id, month, v AS extent_pct FROM seen)')},
fty AS (SELECT aoi_id, quantile_cont(amplitude_pct, 0.5) FILTER (amplitude_pct > 0) AS t FROM fy1 GROUP BY ALL),
fg AS (SELECT fy1.*, CASE WHEN noise_pp > 0 THEN amplitude_pct / (noise_pp * 2 * sqrt(ln(greatest(n_months_cycle, 3)))) END AS ratio, CASE WHEN amplitude_pct <= greatest(0, coalesce(t, 0) * 0.25) THEN 'low' WHEN amplitude_pct <= greatest(0, coalesce(t, 0) * 0.5) THEN 'medium' ELSE 'high' END AS g FROM fy1 LEFT JOIN fty USING (aoi_id) LEFT JOIN fn USING (aoi_id)),
fy AS (SELECT * EXCLUDE (ratio, g, c), c AS confidence, CASE WHEN amplitude_pct <= 0 THEN 'flat_window' WHEN c = 'low' THEN 'annual_window_low_amplitude' ELSE 'annual_window' END AS boundary_source FROM (SELECT *, CASE WHEN ratio <= 1 THEN 'low' WHEN ratio <= 1.5 AND g = 'high' THEN 'medium' ELSE g END AS c FROM fg))"""
for n_, by_, se_ in (("f3_fixed_years", "region", True), ("f3_fixed_years_irregular", "nation", False)):
    add(n_, f"WITH {prep(by_, se_)}, {FIXED} SELECT * FROM fy")
add("f6_label_months", f"""WITH {prep()}, {FIXED}, e AS (SELECT aoi_id, min(hy_year) AS fy_, min(hy_start) AS fs, max(hy_year) AS ly, max(hy_end) AS le FROM fy GROUP BY ALL)
SELECT p.aoi_id, p.month, CASE WHEN fy.hy_year IS NOT NULL THEN CASE WHEN p.month <= peak_month THEN 'Wet' ELSE 'Dry' END WHEN p.month < fs THEN 'Wet' WHEN p.month > le THEN 'Dry' END AS season, coalesce(fy.hy_year, CASE WHEN p.month < fs THEN fy_ WHEN p.month > le THEN ly END) AS hy_year FROM prep p LEFT JOIN fy ON fy.aoi_id = p.aoi_id AND p.month BETWEEN hy_start AND hy_end JOIN e ON e.aoi_id = p.aoi_id""")
add("f8_fixed_year_quality", f"""WITH {prep()}, {FIXED}, j AS (SELECT fy.aoi_id, hy_year, a.invalid_pct AS p, b.invalid_pct AS m, c.invalid_pct AS e, confidence FROM fy LEFT JOIN prep a ON a.aoi_id = fy.aoi_id AND a.month = peak_month LEFT JOIN prep b ON b.aoi_id = fy.aoi_id AND b.month = mid_dry_month LEFT JOIN prep c ON c.aoi_id = fy.aoi_id AND c.month = end_dry_month), k AS (SELECT *, (p IS NULL OR m IS NULL OR e IS NULL OR p > 33 OR m > 33 OR e > 33) AS bad FROM j)
SELECT aoi_id, hy_year, round(p, 6) AS peak_invalid_pct, round(m, 6) AS mid_dry_invalid_pct, round(e, 6) AS end_dry_invalid_pct, CASE WHEN bad THEN 'provisional' ELSE 'confirmed' END AS boundary_status, CASE WHEN bad THEN 'partial' ELSE 'complete' END AS status, CASE WHEN bad THEN 'boundary_low_quality' ELSE 'ok' END AS status_reason, CASE WHEN bad THEN 'low' ELSE confidence END AS confidence FROM k""")


def extreme(rows: str, out: str, keys: str, kind: str) -> str:
    """CTEs picking the extreme of each window of ``rows`` into ``out``."""
    s = "" if kind == "min" else "-"
    return f"""{out}_r AS (SELECT *, CASE WHEN extent_pct IS NOT NULL AND invalid_pct < 100 THEN {s}extent_pct END AS cv FROM {rows}),
{out}_p AS (SELECT *, CASE WHEN count(*) OVER nb >= 2 THEN median(cv) OVER nb END AS med FROM {out}_r WHERE cv IS NOT NULL WINDOW nb AS (PARTITION BY {keys} ORDER BY month ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
{out}_a AS (SELECT {keys}, arg_min({{'m': month, 'e': extent_pct, 'i': invalid_pct, 'nv': n_valid, 'q': quality_state, 'u': usable, 'med': med, 'cv': cv}}, (cv, month)) AS raw FROM {out}_p GROUP BY ALL HAVING count(*) >= 2),
{out}_w AS (SELECT {keys}, count(*) FILTER (usable AND extent_pct IS NOT NULL) AS n_usable, min(month) AS lo, max(month) AS hi, any_value(expected) AS expected, any_value(expected_count) AS ec, any_value(noise_pp) AS nz, any_value(amplitude_pp) AS am FROM {rows} GROUP BY ALL),
{out}_j AS (SELECT *, CASE WHEN am <= 0 THEN 0 ELSE least(0.1 * am, greatest(coalesce(100.0::DOUBLE / nullif(raw.nv, 0), 0), nz)) END AS tol, nz > 0 AND coalesce(raw.med - raw.cv > 3 * nz, false) AS amb FROM {out}_w LEFT JOIN {out}_a USING ({keys})),
{out}_k AS (SELECT *, CASE WHEN raw IS NULL THEN 'unresolved' WHEN raw.q <> 'usable' OR NOT raw.u THEN 'low_quality' WHEN amb THEN 'ambiguous' ELSE 'raw' END AS sel, CASE WHEN raw IS NULL THEN 'internal_gap' WHEN lo > expected - to_months(((ec - 1) // 2)::INT) THEN 'left_truncated' WHEN hi < expected + to_months(((ec - 1) // 2)::INT) THEN 'right_truncated' WHEN n_usable / ec::DOUBLE < 0.7 THEN 'internal_gap' ELSE 'full' END AS win FROM {out}_j),
{out}_e AS (SELECT {keys}, r.month, raw.m AS atm, row_number() OVER (PARTITION BY {keys} ORDER BY r.month) AS i, coalesce(r.cv <= raw.cv + tol, false) AS eq FROM {out}_r r JOIN {out}_k USING ({keys}) WHERE raw IS NOT NULL),
{out}_u AS (SELECT {keys}, min(month) AS run_start, max(month) AS run_end FROM (SELECT *, i - row_number() OVER (PARTITION BY {keys} ORDER BY month) AS g FROM {out}_e WHERE eq) GROUP BY {keys}, g HAVING bool_or(month = atm)),
{out} AS (SELECT {keys}, raw.m AS atm, raw.e AS extent, raw.i AS invalid, run_start, run_end, win, sel, CASE WHEN raw IS NULL THEN 0 ELSE least(1.0::DOUBLE, n_usable / ec::DOUBLE) * CASE WHEN amb THEN 0.6::DOUBLE ELSE 1 END * CASE WHEN win <> 'full' THEN 0.75::DOUBLE ELSE 1 END END AS support, expected FROM {out}_k LEFT JOIN {out}_u USING ({keys}))"""


def sequence(src: str, out: str, tolerance: str | None) -> str:
    """CTEs: the lows chosen together, out(aoi_id, hy_year, out), from src(aoi_id, hy_year, expected, run_start, run_end): a recursion over the years of a block."""
    n = out
    keep = f"QUALIFY v <= min(v) OVER (PARTITION BY s.aoi_id, hy_year) * (1 + {tolerance}::DOUBLE)" if tolerance else ""
    return f"""{n}_c AS (SELECT s.aoi_id, hy_year, month AS m, extent_pct AS v, abs(year(month) * 12 + month(month) - year(expected) * 12 - month(expected)) AS phase FROM {src} s JOIN prep p ON p.aoi_id = s.aoi_id AND p.month BETWEEN run_start AND run_end WHERE extent_pct IS NOT NULL AND invalid_pct < 100 {keep}),
{n}_r AS (
  SELECT aoi_id, hy_year, m, phase AS cost, [m] AS path FROM {n}_c c WHERE NOT EXISTS (SELECT 1 FROM {n}_c b WHERE b.aoi_id = c.aoi_id AND b.hy_year = c.hy_year - 1)
  UNION ALL
  SELECT c.aoi_id, c.hy_year, c.m, any_value(c.phase) + min(r.cost + abs(datediff('month', r.m, c.m) - 12)), list_append(arg_min(r.path, (r.cost + abs(datediff('month', r.m, c.m) - 12), r.m)), c.m) FROM {n}_r r JOIN {n}_c c ON c.aoi_id = r.aoi_id AND c.hy_year = r.hy_year + 1 GROUP BY c.aoi_id, c.hy_year, c.m),
{n}_e AS (SELECT aoi_id, hy_year, arg_min(path, (cost, -(m - DATE '1900-01-01'))) AS path FROM {n}_r r WHERE NOT EXISTS (SELECT 1 FROM {n}_c b WHERE b.aoi_id = r.aoi_id AND b.hy_year = r.hy_year + 1) GROUP BY ALL),
{n}_x AS (SELECT aoi_id, hy_year - len(path) + i AS hy_year, path[i] AS m FROM (SELECT *, unnest(range(1, len(path) + 1)) AS i FROM {n}_e)),
{n} AS (SELECT s.aoi_id, s.hy_year, m AS {out} FROM {src} s LEFT JOIN {n}_x USING (aoi_id, hy_year))"""


def dynamic(month: int = 9, radius: int = 3) -> str:
    return f"""{SCALE},
dyr AS (SELECT aoi_id, hy_year, make_date(hy_year, {month}, 1) AS expected FROM (SELECT aoi_id, unnest(range(min(year(month)), max(year(month)) + 1))::INT AS hy_year FROM prep GROUP BY aoi_id)),
twin AS (SELECT p.*, hy_year, expected, {2 * radius + 1} AS expected_count, noise_pp, amplitude_pp FROM prep p JOIN dyr ON dyr.aoi_id = p.aoi_id AND p.month BETWEEN expected - INTERVAL {radius} MONTH AND expected + INTERVAL {radius} MONTH JOIN scale ON scale.aoi_id = p.aoi_id),
{extreme('twin', 'tx', 'aoi_id, hy_year', 'min')},
opp0 AS (SELECT dyr.aoi_id, dyr.hy_year, dyr.expected, atm, extent AS raw_trough_extent_pct, run_start, run_end, coalesce(win, 'internal_gap') AS window_status, coalesce(sel, 'unresolved') AS sel0, coalesce(support, 0) AS support FROM dyr LEFT JOIN tx USING (aoi_id, hy_year)),
{sequence('opp0', 'fit', '0.0')},
opp AS (SELECT aoi_id, hy_year, fit AS trough_month, p.extent_pct AS trough_extent_pct, p.invalid_pct AS trough_invalid_pct, atm AS raw_trough_month, raw_trough_extent_pct, run_start, run_end, window_status, CASE WHEN fit <> atm AND sel0 <> 'low_quality' THEN 'coherence_adjusted' ELSE sel0 END AS selection_status, support, (year(fit) * 12 + month(fit) - year(expected) * 12 - month(expected))::INT AS phase_offset,
  CASE WHEN fit IS NULL THEN 'unresolved' WHEN window_status = 'full' AND sel0 = 'raw' AND fit = atm AND support >= 0.8 THEN 'confirmed' ELSE 'provisional' END AS boundary_status FROM opp0 JOIN fit USING (aoi_id, hy_year) LEFT JOIN (SELECT aoi_id, month AS fit, extent_pct, invalid_pct FROM prep) p USING (aoi_id, fit)),
cyc AS (SELECT *, row_number() OVER (PARTITION BY aoi_id ORDER BY hy_year) = 1 AS began, lag(trough_month) OVER (PARTITION BY aoi_id ORDER BY hy_year) AS prev FROM opp),
cyc2 AS (SELECT c.*, CASE WHEN trough_month IS NULL THEN NULL WHEN began THEN f ELSE (prev + INTERVAL 1 MONTH)::DATE END AS hy_start FROM cyc c JOIN (SELECT aoi_id, min(month) AS f FROM prep GROUP BY ALL) USING (aoi_id)),
cm AS (SELECT p.*, hy_year, hy_start, trough_month FROM prep p JOIN cyc2 c ON c.aoi_id = p.aoi_id AND p.month BETWEEN hy_start AND trough_month),
cf AS (SELECT aoi_id, hy_year, count(*) AS cycle_months, count(*) FILTER (usable) AS n_usable_months, avg(observed_fraction) FILTER (usable) AS q, bool_or(quality_state = 'unknown') AS unk FROM cm GROUP BY ALL),
pw0 AS (SELECT cm.*, noise_pp, amplitude_pp, count(*) OVER (PARTITION BY cm.aoi_id, hy_year) AS expected_count, row_number() OVER (PARTITION BY cm.aoi_id, hy_year ORDER BY month) - 1 AS i FROM cm JOIN scale ON scale.aoi_id = cm.aoi_id WHERE month < trough_month),
pw AS (SELECT *, max(CASE WHEN i = expected_count // 2 THEN month END) OVER (PARTITION BY aoi_id, hy_year) AS expected FROM pw0),
{extreme('pw', 'px', 'aoi_id, hy_year', 'max')},
po AS (SELECT cm.*, atm AS peak_month, extent AS peak, noise_pp, low.extent_pct AS lowv FROM cm JOIN px ON px.aoi_id = cm.aoi_id AND px.hy_year = cm.hy_year AND cm.month >= atm JOIN scale ON scale.aoi_id = cm.aoi_id JOIN prep low ON low.aoi_id = cm.aoi_id AND low.month = cm.trough_month),
pr AS (SELECT *, coalesce(usable AND coalesce(lag(usable) OVER o, false) AND extent_pct - lag(extent_pct) OVER o > noise_pp, false) AS rise FROM po WINDOW o AS (PARTITION BY aoi_id, hy_year ORDER BY month)),
pp AS (SELECT *, rise AND NOT coalesce(lag(rise) OVER (PARTITION BY aoi_id, hy_year ORDER BY month), false) AS pulse, abs(2 * (month - DATE '1970-01-01') - (peak_month - DATE '1970-01-01') - (trough_month - DATE '1970-01-01')) AS d FROM pr),
pt AS (SELECT aoi_id, hy_year, min(month) FILTER (usable AND extent_pct <= (peak + lowv) / 2) AS half_loss_month, arg_min(month, (d, month)) FILTER (usable) AS mid, count(*) FILTER (pulse) AS pulses, any_value((peak + lowv) / 2) AS target FROM pp GROUP BY ALL),
an0 AS (SELECT c.*, cycle_months, n_usable_months, q, unk, px.atm AS pm, px.extent AS pe, px.sel AS psel, px.support AS psup, half_loss_month, mid, pulses, target, CASE WHEN trough_month IS NULL THEN 'unresolved' WHEN hy_start IS NULL THEN 'none' WHEN n_usable_months >= 8 AND px.atm IS NOT NULL THEN 'ok' ELSE 'thin' END AS k FROM cyc2 c LEFT JOIN cf USING (aoi_id, hy_year) LEFT JOIN px USING (aoi_id, hy_year) LEFT JOIN pt USING (aoi_id, hy_year)),
an1 AS (SELECT *, psel = 'low_quality' OR began OR boundary_status <> 'confirmed' AS prov FROM an0),
an2 AS (SELECT *, n_usable_months / cycle_months::DOUBLE * coalesce(q, 0.5) * CASE WHEN prov THEN 0.75::DOUBLE ELSE 1 END AS sc FROM an1),
an AS (SELECT aoi_id, hy_year, CASE k WHEN 'unresolved' THEN 'unresolved' WHEN 'ok' THEN CASE WHEN prov THEN 'partial' ELSE 'complete' END ELSE 'partial' END AS status,
  CASE k WHEN 'unresolved' THEN 'insufficient_trough_candidates' WHEN 'none' THEN 'no_previous_boundary' WHEN 'thin' THEN 'insufficient_cycle_coverage' ELSE CASE WHEN began THEN 'record_start_boundary' WHEN psel = 'low_quality' THEN 'peak_low_quality' WHEN NOT prov THEN 'ok' ELSE 'boundary_provisional' END END AS status_reason,
  CASE WHEN k IN ('ok', 'thin') THEN hy_start END AS hy_start, CASE WHEN k IN ('ok', 'thin') THEN trough_month END AS hy_end, CASE WHEN k IN ('ok', 'thin') THEN cycle_months END AS cycle_months, CASE WHEN k IN ('ok', 'thin') THEN n_usable_months END AS n_usable_months,
  CASE WHEN k = 'ok' THEN pm END AS peak_month, CASE WHEN k = 'ok' THEN pe END AS peak_extent_pct, CASE WHEN k = 'ok' THEN psel END AS peak_selection_status, CASE WHEN k = 'ok' THEN psup END AS peak_selection_support, trough_month, trough_extent_pct, trough_invalid_pct, boundary_status,
  CASE WHEN k = 'ok' THEN mid END AS temporal_mid_dry_month, CASE WHEN k = 'ok' THEN half_loss_month END AS half_loss_month, CASE WHEN k = 'ok' THEN target END AS half_loss_target_pct, CASE WHEN k = 'ok' THEN pe - trough_extent_pct END AS drawdown_pct, CASE WHEN k = 'ok' AND pe > 0 THEN trough_extent_pct / pe END AS persistence_ratio,
  CASE WHEN k = 'ok' THEN (year(trough_month) * 12 + month(trough_month) - year(pm) * 12 - month(pm))::INT END AS recession_months, CASE WHEN k = 'ok' THEN pulses END AS n_rewetting_pulses, CASE WHEN k <> 'ok' THEN 'low' WHEN (CASE WHEN unk THEN least(sc, 0.59) ELSE sc END) >= 0.8 THEN 'high' WHEN (CASE WHEN unk THEN least(sc, 0.59) ELSE sc END) >= 0.6 THEN 'medium' ELSE 'low' END AS confidence FROM an2)"""


def rounded(cols: str, doubles: str) -> str:
    return ", ".join([*cols.split(), *[f"round({c}, 6) AS {c}" for c in doubles.split()]])


LABEL = f"""lab AS (WITH full12 AS (SELECT *, year(month)::INT AS yr FROM prep WHERE usable AND (aoi_id, year(month)) IN (SELECT (aoi_id, year(month)) FROM prep WHERE usable GROUP BY aoi_id, year(month) HAVING count(DISTINCT month(month)) >= 12)), {SHAPE}),
pat AS (SELECT a.aoi_id, CASE WHEN coalesce(n, 0) < 5 THEN 'insufficient_record' ELSE label END AS pattern, coalesce(tops[1], hi) AS pk, coalesce(lows[1], lo) AS tr FROM (SELECT DISTINCT aoi_id FROM prep) a LEFT JOIN lab USING (aoi_id)
  LEFT JOIN (SELECT aoi_id, count(*) AS n FROM (SELECT aoi_id, year(month) FROM prep WHERE usable GROUP BY ALL HAVING count(DISTINCT month(month)) >= 12) GROUP BY ALL) USING (aoi_id))"""
add("y1_suggested_months", f"""WITH {prep('nation', False)}, {LABEL} SELECT aoi_id, CASE WHEN pattern IN ('unimodal_annual', 'bimodal_or_complex') THEN tr END AS expected_trough_month, CASE WHEN pattern IN ('unimodal_annual', 'bimodal_or_complex') THEN pk END AS expected_peak_month,
  CASE WHEN pattern NOT IN ('unimodal_annual', 'bimodal_or_complex') THEN 'no stable trough phase: ' || pattern END AS error FROM pat""")
for by_, se_, tag in (("region", True, ""), ("nation", False, "_irregular")):
    D = f"WITH {prep(by_, se_, 40)}, {dynamic()}"
    add(f"y5_trough_opportunities{tag}", f"{D} SELECT {rounded('aoi_id hy_year trough_month raw_trough_month run_start run_end window_status selection_status phase_offset boundary_status', 'trough_extent_pct trough_invalid_pct raw_trough_extent_pct support')} FROM opp")
    add(f"y3_cycle_peaks{tag}", f"{D} SELECT {rounded('aoi_id hy_year peak_month peak_selection_status', 'peak_extent_pct peak_selection_support')} FROM an WHERE peak_month IS NOT NULL")
    add(f"y6_annual_table{tag}", f"{D} SELECT {rounded('aoi_id hy_year status status_reason hy_start hy_end cycle_months n_usable_months peak_month peak_selection_status trough_month boundary_status confidence', 'peak_extent_pct trough_extent_pct')} FROM an")
    add(f"y7_half_loss{tag}", f"{D} SELECT {rounded('aoi_id hy_year half_loss_month', 'half_loss_target_pct')} FROM an WHERE peak_month IS NOT NULL")
    add(f"y8_mid_dry{tag}", f"{D} SELECT aoi_id, hy_year, temporal_mid_dry_month FROM an WHERE peak_month IS NOT NULL")
    add(f"y9_rewetting_pulses{tag}", f"{D} SELECT {rounded('aoi_id hy_year n_rewetting_pulses recession_months', 'drawdown_pct persistence_ratio')} FROM an WHERE peak_month IS NOT NULL")
add("y4_boundary_sequence", f"""WITH {prep('nation', False, 40)}, {dynamic(radius=5)}, {sequence('opp0', 'coherent', None)}, {sequence('opp0', 'within_5_pct', '0.05')}
SELECT coherent.aoi_id, coherent.hy_year, coherent, within_5_pct, fit AS least_only FROM coherent JOIN within_5_pct USING (aoi_id, hy_year) JOIN fit USING (aoi_id, hy_year)""")
add("y10_secondary_extrema", f"""WITH {prep('nation', False, 40)}, {dynamic()}, sr AS (SELECT p.aoi_id, hy_year, p.month, extent_pct AS v, peak_month, an.trough_month, row_number() OVER o AS i, lag(extent_pct) OVER o AS l, lead(extent_pct) OVER o AS r, count(*) OVER (PARTITION BY p.aoi_id, hy_year) AS n, count(*) FILTER (p.month < peak_month) OVER (PARTITION BY p.aoi_id, hy_year) + 1 AS pp, count(*) FILTER (p.month < an.trough_month) OVER (PARTITION BY p.aoi_id, hy_year) + 1 AS tp
FROM prep p JOIN an ON an.aoi_id = p.aoi_id AND p.month BETWEEN hy_start AND hy_end WHERE usable AND peak_month IS NOT NULL WINDOW o AS (PARTITION BY p.aoi_id, hy_year ORDER BY p.month))
SELECT aoi_id, hy_year, arg_min(month, (-v, month)) FILTER (v > l AND v >= r AND abs(i - least(pp, n)) >= 2) AS secondary_peak_month, round(max(v) FILTER (v > l AND v >= r AND abs(i - least(pp, n)) >= 2), 6) AS secondary_peak_extent_pct, arg_min(month, (v, month)) FILTER (v < l AND v <= r AND abs(i - least(tp, n)) >= 2) AS secondary_trough_month, round(min(v) FILTER (v < l AND v <= r AND abs(i - least(tp, n)) >= 2), 6) AS secondary_trough_extent_pct FROM sr GROUP BY ALL""")
add("y10_bimodal_extrema", f"""WITH {prep('nation', False, 40)}, {dynamic()}, {LABEL}, sr AS (SELECT p.aoi_id, hy_year, p.month, extent_pct AS v, peak_month, an.trough_month, row_number() OVER o AS i, lag(extent_pct) OVER o AS l, lead(extent_pct) OVER o AS r, count(*) OVER (PARTITION BY p.aoi_id, hy_year) AS n, count(*) FILTER (p.month < peak_month) OVER (PARTITION BY p.aoi_id, hy_year) + 1 AS pp, count(*) FILTER (p.month < an.trough_month) OVER (PARTITION BY p.aoi_id, hy_year) + 1 AS tp
FROM prep p JOIN an ON an.aoi_id = p.aoi_id AND p.month BETWEEN hy_start AND hy_end WHERE usable AND peak_month IS NOT NULL WINDOW o AS (PARTITION BY p.aoi_id, hy_year ORDER BY p.month))
SELECT aoi_id, hy_year, arg_min(month, (-v, month)) FILTER (v > l AND v >= r AND abs(i - least(pp, n)) >= 2) AS secondary_peak_month, round(max(v) FILTER (v > l AND v >= r AND abs(i - least(pp, n)) >= 2), 6) AS secondary_peak_extent_pct, arg_min(month, (v, month)) FILTER (v < l AND v <= r AND abs(i - least(tp, n)) >= 2) AS secondary_trough_month, round(min(v) FILTER (v < l AND v <= r AND abs(i - least(tp, n)) >= 2), 6) AS secondary_trough_extent_pct FROM sr WHERE aoi_id IN (SELECT aoi_id FROM pat WHERE pattern = 'bimodal_or_complex') GROUP BY ALL""")

add("c7_monthly_condition", f"""WITH {prep('nation', False, 40)} SELECT a.aoi_id, a.month, round(a.extent_pct, 6) AS extent_pct, round(quantile_cont(b.extent_pct, 0.5), 6) AS reference_median_pct, CASE WHEN a.usable THEN round(a.extent_pct - quantile_cont(b.extent_pct, 0.5), 6) END AS anomaly_pct,
CASE WHEN a.usable THEN round(100.0::DOUBLE * (count(*) FILTER (b.extent_pct < a.extent_pct) + 0.5::DOUBLE * count(*) FILTER (b.extent_pct = a.extent_pct)) / nullif(count(b.extent_pct), 0), 6) END AS condition_percentile, count(b.extent_pct) AS reference_n, a.quality_state
FROM prep a LEFT JOIN prep b ON a.aoi_id = b.aoi_id AND month(a.month) = month(b.month) AND a.month <> b.month AND b.usable GROUP BY a.aoi_id, a.month, a.extent_pct, a.usable, a.quality_state""")


def condition(eligible: str, pairs: str, mode: str, few: str) -> str:
    pct = "100.0::DOUBLE * (count(*) FILTER (b.{0} < a.{0}) + 0.5::DOUBLE * count(*) FILTER (b.{0} = a.{0})) / nullif(count(b.{0}), 0)"
    tag = lambda c: f"CASE WHEN few THEN 'insufficient_baseline' WHEN {c} <= 20 THEN 'low' WHEN {c} >= 80 THEN 'high' WHEN {c} IS NOT NULL THEN 'typical' ELSE 'insufficient_baseline' END"
    return f"""WITH {prep('nation', False)}, {FIXED}, an AS (SELECT aoi_id, hy_year, peak_extent_pct AS p, end_extent_pct AS t, {eligible} AS eligible, row_number() OVER (PARTITION BY aoi_id ORDER BY hy_year) AS i, count(*) FILTER ({eligible}) OVER (PARTITION BY aoi_id) AS k FROM fy),
cp AS (SELECT a.aoi_id, a.hy_year, a.p, a.t, a.eligible, a.k, count(b.hy_year) AS nb, {pct.format('p')} AS pp, {pct.format('t')} AS tp FROM an a LEFT JOIN an b ON a.aoi_id = b.aoi_id AND b.eligible AND {pairs} GROUP BY a.aoi_id, a.hy_year, a.p, a.t, a.eligible, a.k),
cq AS (SELECT *, {few} AS few FROM cp),
cl AS (SELECT *, {tag('pp')} AS rc, {tag('tp')} AS rf FROM cq),
cj AS (SELECT *, CASE WHEN few THEN 'insufficient_baseline' WHEN rc = 'high' AND rf = 'high' THEN 'wet_persistent' WHEN rc = 'high' AND rf = 'low' THEN 'recharged_then_contracting' WHEN rc = 'low' AND rf = 'high' THEN 'buffered_low_recharge' WHEN rc = 'low' AND rf = 'low' THEN 'dry_low_refuge' ELSE 'typical_or_mixed' END AS ac FROM cl),
cr AS (SELECT *, count(*) FILTER (ac <> 'dry_low_refuge') OVER o AS gd, count(*) FILTER (ac <> 'wet_persistent') OVER o AS gw, p - lag(p) OVER o AS dp, t - lag(t) OVER o AS dt FROM cj WINDOW o AS (PARTITION BY aoi_id ORDER BY hy_year))
SELECT aoi_id, hy_year, p AS peak_extent_pct, t AS trough_extent_pct, eligible, {mode} AS baseline_mode, nb::INT AS n_baseline, round(pp, 6) AS peak_percentile, round(tp, 6) AS trough_percentile, rc AS recharge_condition, rf AS refuge_condition, ac AS annual_condition, round(dp, 6) AS peak_change_from_previous_pct, round(dt, 6) AS trough_change_from_previous_pct,
count(*) FILTER (ac = 'dry_low_refuge') OVER (PARTITION BY aoi_id, gd ORDER BY hy_year) AS consecutive_dry_cycles, count(*) FILTER (ac = 'wet_persistent') OVER (PARTITION BY aoi_id, gw ORDER BY hy_year) AS consecutive_wet_cycles FROM cr"""


add("c6_annual_condition", condition("confidence <> 'low'", "b.hy_year <> a.hy_year", "'full'", "k < 4"))
add("c2_rolling_condition", condition("true", "b.i < a.i AND a.i > 5 AND b.i >= a.i - 10", "CASE WHEN nb < 5 THEN 'insufficient' WHEN nb < 10 THEN 'expanding' ELSE 'rolling' END", "nb < 5"))

add("f1_checked_windows", """WITH w AS (SELECT n_nationkey::INT AS aoi_id, (n_nationkey % 14)::INT AS wet_start, (n_nationkey % 9 + 1)::INT AS wet_len, (n_nationkey * 5 % 12 + 1)::INT AS dry_start, (n_nationkey % 7 + 1)::INT AS dry_len FROM nation), p AS (SELECT *, (dry_start - ((wet_start + wet_len - 2) % 12 + 1) - 1 + 24) % 12 + 1 AS gap FROM w)
SELECT aoi_id, wet_start, wet_len, dry_start, dry_len, CASE WHEN wet_start NOT BETWEEN 1 AND 12 OR dry_start NOT BETWEEN 1 AND 12 THEN 'months and lengths lie between 1 and 12' WHEN gap = 12 THEN 'the dry window begins in the wet window''s last month' WHEN wet_len + gap - 1 + dry_len > 18 THEN 'windows span more than 18 months' END AS error FROM p""")
add("f2_climatology_windows", f"""WITH {prep('nation', False)}, m AS (SELECT aoi_id, month(month)::INT AS k, avg(extent_pct) AS v FROM prep WHERE extent_pct IS NOT NULL GROUP BY ALL),
a AS (SELECT aoi_id, avg(v) AS mean, arg_min(k, (-v, k)) AS p, arg_min(k, (v, k)) AS t FROM m GROUP BY ALL HAVING count(*) = 12),
s AS (SELECT a.aoi_id, p, t, k, v > mean AS up FROM a JOIN m USING (aoi_id)),
r AS (SELECT aoi_id, p, t, least(11, coalesce(min((k - p + 12) % 12) FILTER (k <> p AND NOT up) - 1, 11)) AS pf, coalesce(min((p - k + 12) % 12) FILTER (k <> p AND NOT up) - 1, 11) AS pb, least(11, coalesce(min((k - t + 12) % 12) FILTER (k <> t AND up) - 1, 11)) AS tf, coalesce(min((t - k + 12) % 12) FILTER (k <> t AND up) - 1, 11) AS tb FROM s GROUP BY ALL),
q AS (SELECT aoi_id, p, t, (p - 1 - least(pb, 11 - pf) + 12) % 12 + 1 AS ws, pf + least(pb, 11 - pf) + 1 AS wl, (t - 1 - least(tb, 11 - tf) + 12) % 12 + 1 AS ds, tf + least(tb, 11 - tf) + 1 AS dl FROM r),
z AS (SELECT *, (ws + wl - 2) % 12 + 1 = ds AS meets FROM q)
SELECT aoi_id, p AS peak_month, t AS trough_month, ws::INT AS wet_start, wl::INT AS wet_len, (CASE WHEN meets THEN ds % 12 + 1 ELSE ds END)::INT AS dry_start, (CASE WHEN meets THEN CASE dl WHEN 1 THEN 12 ELSE dl - 1 END ELSE dl END)::INT AS dry_len FROM z""")
_OWN = "yw AS (SELECT aoi_id, yr, (w1 - INTERVAL 5 MONTH)::DATE AS w0, w1, (w1 + INTERVAL 1 MONTH)::DATE AS d0, (w1 + INTERVAL 6 MONTH)::DATE AS d1 FROM (SELECT aoi_id, yr, make_date(yr, ((peak_month + 2) % 12 + 1)::INT, 1) AS w1 FROM pc JOIN (SELECT aoi_id, unnest(range(year(f), year(l) + 1))::INT AS yr FROM sp) USING (aoi_id))),\nwet AS"
AROUND = FIXED[: FIXED.index("yw AS")] + _OWN + FIXED[FIXED.index("wet AS") + 6 :]
add("f3_fixed_years_by_area", f"WITH {prep('nation', False)}, {PEAKCLIM}, {AROUND} SELECT * FROM fy")
DN = f"WITH {prep('nation', False, 40)}, {dynamic()}"
FROMDYN = "fd AS (SELECT aoi_id, hy_year, hy_start, hy_end, peak_month, peak_extent_pct, temporal_mid_dry_month AS mid_dry_month, trough_month AS end_dry_month, trough_extent_pct AS end_extent_pct, peak_extent_pct - trough_extent_pct AS amplitude_pct, cycle_months AS n_months_cycle, confidence, 'dynamic_trough' AS boundary_source FROM an WHERE status IN ('complete', 'partial') AND hy_start IS NOT NULL AND hy_end IS NOT NULL AND peak_month IS NOT NULL AND trough_month IS NOT NULL)"
add("f9_from_dynamic", f"{DN}, {FROMDYN} SELECT {rounded('aoi_id hy_year hy_start hy_end peak_month mid_dry_month end_dry_month n_months_cycle confidence boundary_source', 'peak_extent_pct end_extent_pct amplitude_pct')} FROM fd")
LEVELS = "lv AS (SELECT *, quantile_cont(CASE WHEN usable THEN extent_pct END, 0.5) OVER (PARTITION BY aoi_id, month(month)) AS level, CASE WHEN row_number() OVER o = 1 THEN extent_pct - extent_pct ELSE extent_pct - lag(extent_pct) OVER o END AS slope FROM prep WINDOW o AS (PARTITION BY aoi_id ORDER BY month))"
CROSS = f"""{LEVELS},
hc0 AS (SELECT a.*, l.month, l.extent_pct AS v, l.usable AND l.level IS NOT NULL AS seen, l.level, l.slope, s.noise_pp, pl.level AS plevel FROM an a JOIN lv l ON l.aoi_id = a.aoi_id AND l.month BETWEEN hy_start AND hy_end JOIN scale s ON s.aoi_id = a.aoi_id JOIN lv pl ON pl.aoi_id = a.aoi_id AND pl.month = a.peak_month WHERE a.status IN ('complete', 'partial')),
hc1 AS (SELECT *, CASE WHEN peak_extent_pct - plevel > 0 THEN peak_extent_pct - plevel WHEN peak_extent_pct - trough_extent_pct > 0 THEN peak_extent_pct - trough_extent_pct ELSE greatest(noise_pp, 1e-6) END AS h FROM hc0),
hc2 AS (SELECT *, min(CASE WHEN seen AND month > peak_month AND v <= level + 0.5 * h THEN month END) OVER (PARTITION BY aoi_id, hy_year) AS half FROM hc1),
hcut AS (SELECT aoi_id, hy_year, any_value(hy_start) AS s, any_value(hy_end) AS e, any_value(peak_month) AS pm, any_value(status) AS st, any_value(boundary_status) AS bs, any_value(peak_selection_status) AS ps, coalesce(min(month) FILTER (seen AND month <= peak_month AND v >= level AND slope >= -noise_pp), any_value(peak_month)) AS wet_start, coalesce(any_value(half), (any_value(peak_month) + INTERVAL 1 MONTH)::DATE) AS half_start, any_value(half) IS NOT NULL AS half_seen, coalesce(min(month) FILTER (seen AND month > coalesce(half, (peak_month + INTERVAL 1 MONTH)::DATE) AND v <= level), any_value(hy_end)) AS dry_start FROM hc2 GROUP BY aoi_id, hy_year)"""
add("h1_levels", f"WITH {prep('nation', False, 40)}, {LEVELS} SELECT aoi_id, month, round(level, 6) AS level, round(slope, 6) AS slope FROM lv")
add("h2_crossings", f"{DN}, {CROSS} SELECT aoi_id, hy_year, wet_start, half_start, half_seen, dry_start FROM hcut")
for by_, se_, tag in (("region", True, ""), ("nation", False, "_irregular")):
    add(f"h4_phases{tag}", f"""WITH {prep(by_, se_, 40)}, {dynamic()}, {CROSS} SELECT p.aoi_id, p.month, coalesce(c.hy_year, o.hy_year)::INT AS hy_year, CASE WHEN c.hy_year IS NULL THEN 'unspecified' WHEN p.month = c.e THEN 'dry' WHEN p.month < wet_start THEN 'recovery' WHEN p.month < half_start THEN 'wet' WHEN p.month < dry_start THEN 'recession' ELSE 'dry' END AS phase,
CASE WHEN c.hy_year IS NOT NULL THEN CASE WHEN NOT usable THEN 'unusable' WHEN st = 'complete' THEN 'ok' ELSE 'provisional' END WHEN o.hy_year IS NOT NULL THEN 'unresolved_cycle' ELSE 'outside_cycle' END AS phase_status,
CASE WHEN c.hy_year IS NOT NULL THEN round(least(1, greatest(0, 0.55::DOUBLE + CASE WHEN bs = 'confirmed' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN half_seen THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN ps = 'raw' THEN 0.1::DOUBLE ELSE 0 END - CASE WHEN NOT usable THEN 0.25::DOUBLE ELSE 0 END)), 6) END AS phase_confidence, 'rule_based' AS phase_method, 'robust_extrema' AS boundary_basis, round(extent_pct, 6) AS extent_pct, usable AS candidate_usable
FROM prep p LEFT JOIN hcut c ON c.aoi_id = p.aoi_id AND p.month BETWEEN c.s AND c.e LEFT JOIN an o ON o.aoi_id = p.aoi_id AND o.status <> 'complete' AND p.month BETWEEN o.hy_start AND o.hy_end""")
REG = "['seasonal', 'marginal', 'aseasonal', 'insufficient_record']"
add("r14_divergence_rules", f"""WITH e AS (SELECT n_nationkey::INT AS k, {REG}[n_nationkey % 4 + 1] AS er, n_nationkey / 10.0::DOUBLE AS es, (n_nationkey * 7 % 12 + 1)::INT AS ep FROM nation), r AS (SELECT n_nationkey::INT AS k, {REG}[n_nationkey // 4 % 4 + 1] AS rr, n_nationkey / 5.0::DOUBLE AS rs, (n_nationkey * 5 % 12 + 1)::INT AS rp FROM nation WHERE n_nationkey % 6 <> 5),
j AS (SELECT *, (ep - rp + 12) % 12 AS g FROM e LEFT JOIN r USING (k))
SELECT k AS aoi_id, er AS extent_regime, es AS extent_snr, ep AS extent_peak, rr AS rain_regime, rs AS rain_snr, rp AS rain_peak, CASE WHEN er IN ('seasonal', 'marginal') AND rr IN ('seasonal', 'marginal') THEN CASE WHEN g > 6 THEN g - 12 ELSE g END END::INT AS lag_months,
CASE WHEN rr IS NULL THEN 'no_rainfall' WHEN rr = 'insufficient_record' THEN 'rainfall_insufficient' WHEN er = 'insufficient_record' THEN 'extent_insufficient' WHEN er = rr THEN CASE er WHEN 'marginal' THEN 'partial' ELSE 'agree' END WHEN rr = 'seasonal' THEN 'extent_damped' WHEN rr = 'marginal' THEN CASE er WHEN 'aseasonal' THEN 'extent_damped' ELSE 'extent_more_seasonal' END ELSE 'extent_more_seasonal' END AS divergence FROM j""")
add("r11_regime_rules", "WITH o AS (SELECT o_orderkey AS id, o_orderkey % 300 / 100.0::DOUBLE AS snr, o_orderkey % 11 / 10.0::DOUBLE AS ci, o_orderkey % 13 / 50.0::DOUBLE AS p, o_orderkey % 17 AS n FROM orders) SELECT id, CASE WHEN snr >= 2 AND ci >= 0.7 THEN 'seasonal' WHEN snr < 0.7 THEN 'aseasonal' WHEN p >= 0.1 AND n >= 10 THEN 'aseasonal' ELSE 'marginal' END AS regime FROM o")
add("r13_route_rules", f"""WITH o AS (SELECT o_orderkey::BIGINT AS id, {REG}[o_orderkey % 4 + 1] AS r, CASE WHEN o_orderkey % 19 > 0 THEN o_orderkey % 11 / 10.0::DOUBLE END AS tc, o_orderkey % 7 / 40.0::DOUBLE AS pp, o_orderkey % 9 / 50.0::DOUBLE AS tp, o_orderkey % 10 / 10.0::DOUBLE AS pr, CASE WHEN o_orderkey % 23 > 0 THEN o_orderkey % 13 / 20.0::DOUBLE END AS tr FROM orders),
g AS (SELECT id, r, r = 'seasonal' AND coalesce(tc >= 0.7, false) AS a, r = 'seasonal' OR (r = 'marginal' AND coalesce(pp < 0.1 AND tp < 0.1 AND pr >= 0.3 AND tr >= 0.3, false)) AS b FROM o)
SELECT id, a AS supports_per_year, b AS supports_fixed_window, CASE WHEN r = 'insufficient_record' THEN 'insufficient_record' WHEN a THEN 'per_year_detection' WHEN b THEN 'fixed_climatological_window' ELSE 'event_characterisation' END AS route FROM g""")
ALIGN = f"""{DN}, {FIXED},
al AS (SELECT fy.aoi_id, hy_year AS event_id, end_dry_month AS truth_month, arg_min(o.low, (abs(o.low - end_dry_month), o.low)) AS actual_month FROM fy LEFT JOIN (SELECT aoi_id, trough_month AS low FROM opp WHERE trough_month IS NOT NULL) o ON o.aoi_id = fy.aoi_id AND o.low > fy.hy_start - INTERVAL 1 MONTH AND o.low <= fy.hy_end GROUP BY ALL),
ad AS (SELECT *, (year(actual_month) * 12 + month(actual_month) - year(truth_month) * 12 - month(truth_month))::INT AS d FROM al)"""
add("o5_aligned_events", f"{ALIGN} SELECT aoi_id, event_id, truth_month, actual_month, d AS delta_months FROM ad")
add("o6_timing", f"{ALIGN} SELECT aoi_id, count(*) AS n_eligible, count(d) AS n_resolved, round(count(d) / count(*)::DOUBLE, 6) AS coverage, round(count(*) FILTER (abs(d) <= 1) / count(*)::DOUBLE, 6) AS within_1_month, round(avg(d), 6) AS signed_bias_months, round(avg(abs(d)), 6) AS resolved_mae_months, round(avg(coalesce(abs(d), 12)), 6) AS total_mae_months, round(quantile_cont(coalesce(abs(d), 12)::DOUBLE, 0.5), 6) AS median_abs_error_months, round(quantile_cont(coalesce(abs(d), 12)::DOUBLE, 0.9), 6) AS p90_abs_error_months, max(coalesce(abs(d), 12))::DOUBLE AS max_abs_error_months FROM ad GROUP BY aoi_id")
OTHER = prep("region", False)
for x_ in ("obs", "axis", "prep0", "prep1", "prep"):
    for end_ in (" AS", " GROUP", " USING", ")", " LEFT", " WHERE"):
        OTHER = OTHER.replace(f" {x_}{end_}", f" {x_}_{end_}").replace(f"\n{x_}{end_}", f"\n{x_}_{end_}")
OTHER = OTHER.replace("obs AS", "obs_ AS", 1)
add("o19_compare_series", f"WITH {prep()}, {OTHER}, j AS (SELECT a.aoi_id, a.month, a.extent_pct AS n, b.extent_pct AS c FROM prep a JOIN prep_ b USING (aoi_id, month) WHERE a.extent_pct IS NOT NULL AND b.extent_pct IS NOT NULL), k AS (SELECT aoi_id, count(*) AS n_months_compared, round(corr(n, c), 6) AS correlation, round(max(abs(n - c)), 6) AS max_abs_diff_extent_pct, round(avg(abs(n - c)), 6) AS mean_abs_diff_extent_pct, arg_min(month, (-n, month)) AS native_wet_month, arg_min(month, (n, month)) AS native_dry_month, arg_min(month, (-c, month)) AS coarse_wet_month, arg_min(month, (c, month)) AS coarse_dry_month FROM j GROUP BY aoi_id) SELECT *, native_wet_month = coarse_wet_month AS same_wet_month, native_dry_month = coarse_dry_month AS same_dry_month FROM k")
EXPORT = f"{DN}, {FROMDYN}, {event_ctes('quantile')}"
add("o8_hydro_years_export", f"{EXPORT} SELECT aoi_id, hy_year, hy_start AS start_date, hy_end AS end_date, n_months_cycle AS n_months, peak_month AS peak_date, round(peak_extent_pct, 6) AS peak_extent_pct, mid_dry_month AS mid_dry_date, end_dry_month AS trough_date, round(end_extent_pct, 6) AS trough_extent_pct, round(amplitude_pct, 6) AS amplitude_pct, confidence, boundary_source FROM fd")
add("o8_wet_events_export", f"{EXPORT} SELECT aoi_id, event_id AS wet_event_id, start_month AS start_date, end_month AS end_date, duration_months, peak_month AS peak_date, peak_extent_pct, mean_extent_pct, magnitude_pp_months, baseline_extent_pct FROM ev")
add("o8_low_spells_export", f"{EXPORT} SELECT aoi_id, low_spell_id, start_month AS start_date, end_month AS end_date, duration_months, baseline_extent_pct, min_extent_pct FROM ls")
add("o7_monthly_export", f"""{EXPORT}, {RAIN}, mc AS (SELECT a.aoi_id, a.month, round(quantile_cont(b.extent_pct, 0.5), 6) AS reference_median_pct, CASE WHEN a.usable THEN round(a.extent_pct - quantile_cont(b.extent_pct, 0.5), 6) END AS anomaly_pct, CASE WHEN a.usable THEN round(100.0::DOUBLE * (count(*) FILTER (b.extent_pct < a.extent_pct) + 0.5::DOUBLE * count(*) FILTER (b.extent_pct = a.extent_pct)) / nullif(count(b.extent_pct), 0), 6) END AS condition_percentile FROM prep a LEFT JOIN prep b ON a.aoi_id = b.aoi_id AND month(a.month) = month(b.month) AND a.month <> b.month AND b.usable GROUP BY a.aoi_id, a.month, a.extent_pct, a.usable),
ra AS (SELECT p.aoi_id, p.month, rainfall_mm, round(rainfall_mm - quantile_cont(rainfall_mm, 0.5) OVER (PARTITION BY p.aoi_id, month(p.month)), 6) AS rainfall_anomaly_mm FROM prep p LEFT JOIN rain r USING (aoi_id, month)),
iy AS (SELECT p.aoi_id, p.month, min(hy_year) AS hy_year, bool_or(fd.peak_month = p.month) AS is_peak, bool_or(fd.end_dry_month = p.month) AS is_trough FROM prep p JOIN fd ON fd.aoi_id = p.aoi_id AND p.month BETWEEN hy_start AND hy_end GROUP BY p.aoi_id, p.month),
ie AS (SELECT p.aoi_id, p.month, min(event_id) AS wet_event_id FROM prep p JOIN ev ON ev.aoi_id = p.aoi_id AND p.month BETWEEN start_month AND end_month GROUP BY p.aoi_id, p.month),
il AS (SELECT p.aoi_id, p.month, min(low_spell_id) AS low_spell_id FROM prep p JOIN ls ON ls.aoi_id = p.aoi_id AND p.month BETWEEN start_month AND end_month GROUP BY p.aoi_id, p.month)
SELECT p.aoi_id, p.month, round(p.extent_pct, 6) AS extent_pct, round(p.invalid_pct, 6) AS invalid_pct, p.quality_state, p.usable AS candidate_usable, reference_median_pct, anomaly_pct, condition_percentile, hy_year, coalesce(is_peak, false) AS is_peak, coalesce(is_trough, false) AS is_trough, wet_event_id, low_spell_id, round(rainfall_mm, 6) AS rainfall_mm, rainfall_anomaly_mm
FROM prep p JOIN mc USING (aoi_id, month) JOIN ra USING (aoi_id, month) LEFT JOIN iy USING (aoi_id, month) LEFT JOIN ie USING (aoi_id, month) LEFT JOIN il USING (aoi_id, month)""")
_FLAT = ", ".join(f"CASE WHEN aoi_id % 5 = 0 THEN 'not_applicable_low_variability' ELSE {x} END AS {x}" for x in ("recharge_condition", "refuge_condition", "annual_condition"))
add("c3_low_variability", f"SELECT aoi_id, hy_year, {_FLAT} FROM ({ORACLES['c6_annual_condition']})")

PIX = """ob AS (SELECT (l_suppkey % 5)::INT AS aoi_id, date_trunc('month', l_shipdate)::DATE AS month, l_shipdate AS ts, l_orderkey AS sid, l_linenumber AS part, (l_partkey % 16)::INT AS y, (l_partkey // 16)::INT AS x, CASE WHEN l_returnflag = 'R' THEN 128 WHEN l_returnflag = 'A' THEN 0 WHEN l_linenumber % 2 = 1 THEN 1 ELSE 64 END AS raw FROM lineitem),
dm AS (SELECT aoi_id, month, ts::DATE AS day, y, x, arg_min(raw, ((raw & 1)::INT, ts, sid, part)) AS raw FROM ob GROUP BY ALL),
cd AS (SELECT aoi_id, month, day, y, x, CASE WHEN raw & 1 = 1 THEN -1 WHEN raw = 128 THEN 1 WHEN raw = 0 THEN 0 ELSE -1 END AS code FROM dm),
mj AS (SELECT aoi_id, month, y, x, CASE WHEN sum(CASE code WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END) > 0 THEN 1 WHEN max(code) >= 0 THEN 0 ELSE max(code) END::INT AS code FROM cd GROUP BY ALL),
cells AS (SELECT DISTINCT aoi_id, (p_partkey % 16)::INT AS y, (p_partkey // 16)::INT AS x FROM part, (SELECT unnest(range(5))::INT AS aoi_id) WHERE (p_partkey % 16 + p_partkey // 16 + aoi_id) % 8 <> 0),
cl AS (SELECT mj.aoi_id, month, mj.y, mj.x, CASE WHEN c.y IS NULL THEN -2 ELSE code END AS code FROM mj LEFT JOIN cells c ON c.aoi_id = mj.aoi_id AND c.y = mj.y AND c.x = mj.x),
st AS (SELECT aoi_id, y, x, count(*) FILTER (code = 1) AS count_wet, count(*) FILTER (code IN (0, 1)) AS count_clear FROM cl GROUP BY ALL),
hm AS (SELECT aoi_id, y, x FROM st SEMI JOIN cells USING (aoi_id, y, x) WHERE count_wet > 0),
rd AS (SELECT aoi_id, month, count(*) FILTER (code = 1) AS n_water, count(*) FILTER (code = 0) AS n_dry, count(*) FILTER (code IN (0, 1)) AS n_valid, count(*) FILTER (code <> -2) AS n_aoi FROM cl GROUP BY ALL)"""
PCT = "round(100.0::DOUBLE * n_water / nullif(n_valid, 0), 6) AS extent_pct, round(100.0::DOUBLE * n_invalid / nullif(n_aoi, 0), 6) AS invalid_pct"


def coarse(f: int) -> str:
    return f"SELECT aoi_id, month, (y // {f})::INT AS y, (x // {f})::INT AS x, (CASE WHEN count(*) FILTER (code <> -2) = 0 THEN -2 WHEN count(*) FILTER (code = 1) > count(*) FILTER (code = 0) THEN 1 WHEN count(*) FILTER (code = 0) > count(*) FILTER (code = 1) THEN 0 ELSE -1 END)::INT AS code FROM cl GROUP BY aoi_id, month, y // {f}, x // {f}"


def around(src: str, k: int) -> str:
    return f"SELECT aoi_id, (y + dy)::INT AS y, (x + dx)::INT AS x FROM {src}, (SELECT unnest(range({-k}, {k + 1})) AS dy), (SELECT unnest(range({-k}, {k + 1})) AS dx)"


def far(src: str, close: int, buffer: int) -> str:
    """Cells within the square roots of ``close`` and ``buffer``: all distances, cell by cell."""
    disc = lambda square: f"(SELECT dy, dx FROM (SELECT unnest(range(-12, 13)) AS dy), (SELECT unnest(range(-12, 13)) AS dx) WHERE dy * dy + dx * dx <= {square})"
    near = lambda s, square: f"(SELECT DISTINCT aoi_id, y + dy AS y, x + dx AS x FROM {s}, {disc(square)})"
    grown = near(src, close)
    shut = f"(SELECT g.aoi_id, g.y, g.x FROM {grown} g, {disc(close)} o JOIN {grown} h ON h.aoi_id = g.aoi_id AND h.y = g.y + dy AND h.x = g.x + dx GROUP BY ALL HAVING count(*) = (SELECT count(*) FROM {disc(close)}))"
    return f"SELECT aoi_id, y::INT AS y, x::INT AS x FROM {near(shut, buffer)}"


for n_, sql_ in {
    "p1_decode": "SELECT aoi_id, month, y, x, day, code FROM cd",
    "p2_day_mosaic": "SELECT aoi_id, month, day, y, x, raw FROM dm",
    "p3_monthly_composite": "SELECT aoi_id, month, y, x, code FROM mj",
    "p3_any_wet_composite": "SELECT aoi_id, month, y, x, max(code)::INT AS code FROM cd GROUP BY ALL",
    "p4_clip": "SELECT aoi_id, month, y, x, code::INT AS code FROM cl",
    "p5_fill_inside": "SELECT aoi_id, month, y, x, CASE WHEN y + x < 40 AND EXISTS (SELECT 1 FROM cells c WHERE c.aoi_id = mj.aoi_id AND c.y = mj.y AND c.x = mj.x) THEN CASE WHEN code = 0 THEN -1 ELSE code END ELSE CASE WHEN code = 0 THEN -2 ELSE code END END::INT AS code FROM mj",
    "p6_monthly_reduction": f"SELECT aoi_id, month, n_water, n_dry, n_valid, n_aoi, n_valid AS n_wet_aoi, n_invalid, {PCT}, round(100.0::DOUBLE * n_water / nullif(n_valid, 0), 6) AS wet_fill_pct FROM (SELECT *, n_aoi - n_valid AS n_invalid FROM rd)",
    "p6_wet_area_reduction": f"SELECT aoi_id, month, n_water, n_dry, n_valid, n_aoi, n_wet_aoi, n_invalid, {PCT}, round(100.0::DOUBLE * n_water / nullif(n_wet_aoi, 0), 6) AS wet_fill_pct FROM (SELECT *, n_aoi - n_valid AS n_invalid FROM rd) JOIN (SELECT cl.aoi_id, month, count(hm.y) FILTER (code <> -2) AS n_wet_aoi FROM cl LEFT JOIN hm ON hm.aoi_id = cl.aoi_id AND hm.y = cl.y AND hm.x = cl.x GROUP BY ALL) USING (aoi_id, month)",
    "p7_sum_tiles": f"SELECT aoi_id, month, n_water, n_valid, n_invalid, n_aoi, {PCT}, true AS sound FROM (SELECT *, n_aoi - n_valid AS n_invalid FROM rd)",
    "p8_unseen_months": "SELECT aoi_id, m::DATE AS month, 0::BIGINT AS n_water, 0::BIGINT AS n_valid, 0::BIGINT AS n_wet_aoi, n AS n_aoi, n AS n_invalid, NULL::DOUBLE AS extent_pct, 100.0::DOUBLE AS invalid_pct FROM (SELECT aoi_id, count(*) AS n FROM cells GROUP BY ALL), (SELECT unnest(generate_series(DATE '2000-03-01', DATE '2001-02-01', INTERVAL 1 MONTH)) AS m)",
    "p33_complete_cube": "SELECT ax.aoi_id, ax.month, c.y, c.x, coalesce(code, -1)::INT AS code FROM cells c JOIN (SELECT aoi_id, unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month FROM mj GROUP BY aoi_id) ax ON ax.aoi_id = c.aoi_id LEFT JOIN mj ON mj.aoi_id = c.aoi_id AND mj.month = ax.month AND mj.y = c.y AND mj.x = c.x",
    "s16_statistics": "SELECT aoi_id, y, x, count_wet, count_clear, round(100.0::DOUBLE * count_wet / nullif(count_clear, 0), 6) AS frequency FROM st",
    "p10_ever_wet": "SELECT aoi_id, y, x FROM st WHERE count_clear > 0 AND count_wet / count_clear::DOUBLE >= 0.5",
    "p11_wet_area": far("hm", 4, 9),
    "p34_footprint_area": far("(SELECT aoi_id, y, x FROM st WHERE count_wet > 0)", 25, 100),
    "p12_historical_mask": "SELECT * FROM hm",
    "p15_planning_footprint": f"SELECT DISTINCT * FROM ({around('(SELECT DISTINCT aoi_id, y // 4 AS y, x // 4 AS x FROM hm)', 1)}) WHERE y >= 0 AND x >= 0",
    "p16_union_inside": "SELECT DISTINCT aoi_id, y, x FROM cl SEMI JOIN cells USING (aoi_id, y, x) WHERE code = 1 AND (year(month) < 1995 OR year(month) > 1996)",
    "p17_coarsen": coarse(4),
    "p18_mismatches": "SELECT cl.aoi_id, cl.month, count(*) AS n_shared, count(*) FILTER (code <> cb) AS n_mismatch FROM cl JOIN (SELECT aoi_id, month, y, x, max(code) AS cb FROM cd GROUP BY ALL) USING (aoi_id, month, y, x) WHERE code <> -2 AND cb <> -2 GROUP BY ALL",
    "p20_active_windows": "SELECT DISTINCT aoi_id, (y // 4)::INT AS tile_y, (x // 4)::INT AS tile_x FROM st WHERE count_wet > 0",
    "p21_grid_windows": "SELECT aoi_id, ty::INT AS tile_y, tx::INT AS tile_x, (ty * 6)::INT AS y0, least(ty * 6 + 6, h)::INT AS y1, (tx * 6)::INT AS x0, least(tx * 6 + 6, w)::INT AS x1 FROM (SELECT *, unnest(range(((w + 5) // 6)::BIGINT)) AS tx FROM (SELECT *, unnest(range(((h + 5) // 6)::BIGINT)) AS ty FROM (SELECT aoi_id, max(y) + 1 AS h, max(x) + 1 AS w FROM cells GROUP BY ALL)))",
    "p22_plan_resolution": "SELECT aoi_id, res::INT AS res_m, round(area / (res * res) * 24 * 5 / 1e9, 6) AS peak_gb, round(100.0::DOUBLE * res * res / area, 6) AS floor_pp, CASE WHEN NOT fits THEN 'native_no_fit' WHEN 100.0::DOUBLE * res * res / area > 0.1 * amp THEN 'signal_veto_no_fit' WHEN res = 30 THEN 'ok' ELSE 'coarsened' END AS reason FROM (SELECT *, coalesce(list_filter([30, 60, 100, 150, 300], lambda r: area / (r * r) * 24 * 5 / 1e9 <= 0.05)[1], 300) AS res, len(list_filter([30, 60, 100, 150, 300], lambda r: area / (r * r) * 24 * 5 / 1e9 <= 0.05)) > 0 AS fits FROM (SELECT n_nationkey::INT AS aoi_id, power(3.0::DOUBLE, n_nationkey % 13 + 14) AS area, CASE WHEN n_nationkey % 3 > 0 THEN n_nationkey / 100.0::DOUBLE END AS amp FROM nation))",
    "p32_scenes_by_year": "SELECT aoi_id, year(ts)::INT AS yr, count(DISTINCT sid) AS n_scenes, count(*) AS n_observations FROM ob GROUP BY ALL",
    "p35_same_cells": "SELECT aoi_id, count(*) FILTER (b IS NULL) AS only_first, count(*) FILTER (a IS NULL) AS only_second FROM (SELECT *, 1 AS a FROM hm) FULL JOIN (SELECT aoi_id, y, x, 1 AS b FROM st WHERE count_wet > 0) USING (aoi_id, y, x) GROUP BY ALL",
    "p36_tiles_in": "SELECT DISTINCT aoi_id, y // 4 AS tile_y, x // 4 AS tile_x FROM hm",
    "p37_spans_tiles": "SELECT aoi_id, (min(y) // 64 <> max(y) // 64 OR min(x) // 64 <> max(x) // 64) AS spans_tiles FROM cells GROUP BY ALL",
    "p38_containment": "SELECT aoi_id, month, count(*) AS n_outside FROM mj ANTI JOIN cells USING (aoi_id, y, x) WHERE code = 1 GROUP BY ALL",
    "p39_differing": "SELECT aoi_id, month, count(*) AS n_pixels, count(*) FILTER (a.code IS DISTINCT FROM b.code) AS n_differing FROM cl a FULL JOIN (SELECT aoi_id, month, y, x, max(code)::INT AS code FROM cd WHERE code >= 0 GROUP BY ALL) b USING (aoi_id, month, y, x) GROUP BY ALL",
    "p40_fidelity": " UNION ALL ".join(f"SELECT aoi_id, {f} AS factor, count(*) AS n_valid, count(*) FILTER (cl.code <> k.code) AS n_mismatch, round(1 - count(*) FILTER (cl.code <> k.code) / count(*)::DOUBLE, 6) AS fidelity FROM cl JOIN ({coarse(f)}) k USING (aoi_id, month) WHERE k.y = cl.y // {f} AND k.x = cl.x // {f} AND cl.code IN (0, 1) GROUP BY aoi_id" for f in (2, 4)),
}.items():
    add(n_, f"WITH {PIX} {sql_}")

MONTHS = "(SELECT unnest(generate_series(DATE '1995-03-01', DATE '1998-10-01', INTERVAL 1 MONTH))::DATE AS month)"
add("s12_cached_extent", f"""WITH {PIX} SELECT aoi_id, month, n_water, n_valid, n_aoi - n_valid AS n_invalid, n_aoi, round(100.0::DOUBLE * n_water / nullif(n_valid, 0), 6) AS extent_pct, round(100.0::DOUBLE * (n_aoi - n_valid) / n_aoi, 6) AS invalid_pct
FROM (SELECT a.aoi_id, a.month, n_aoi, count(cl.code) FILTER (code = 1) AS n_water, count(cl.code) FILTER (code IN (0, 1)) AS n_valid FROM (SELECT aoi_id, count(*) AS n_aoi, month FROM cells, {MONTHS} GROUP BY ALL) a LEFT JOIN cl USING (aoi_id, month) GROUP BY ALL)""")
add("s28_completed_years", f"WITH {PIX} SELECT aoi_id, year(month)::INT AS yr, count(DISTINCT month) AS n_months FROM cells, {MONTHS} WHERE year(month) < 1997 AND aoi_id < 2 GROUP BY ALL")
add("p13_mask_versions", f"WITH {PIX} SELECT aoi_id, y, x, count(*) FILTER (code = 1) AS count_wet, count(*) AS count_clear FROM cl WHERE code IN (0, 1) AND year(month) BETWEEN 1990 AND 1999 GROUP BY ALL")
GAP = "greatest(1, (year({b}) - year({a})) * 12 + month({b}) - month({a}) + (day({b}) > day({a}))::INT)"
add("p14_coverage_gaps", f"""WITH o AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY ALL),
g AS (SELECT o_custkey, CASE WHEN a < DATE '1996-01-01' THEN {GAP.format(a='a', b="DATE '1996-01-01'")} END::INT AS before, CASE WHEN b > DATE '1997-12-31' THEN {GAP.format(a="DATE '1997-12-31'", b='b')} END::INT AS after FROM o)
SELECT *, 'the window ' || nullif(concat_ws(' and ', 'begins ' || before || ' month(s) before the coverage', 'ends ' || after || ' month(s) after it, so cells first wet since then are missing'), '') AS note FROM g""")
add("p31_wet_area_from_years", f"WITH {PIX} {far('(SELECT DISTINCT aoi_id, y, x FROM cl WHERE code = 1 AND year(month) BETWEEN 1995 AND 1998)', 9, 36)}")
SPARSE = f"""{PIX}, sp AS (SELECT * FROM cells WHERE aoi_id = 0 OR x % (40 * aoi_id) < 9), sh AS (SELECT aoi_id, max(y) + 1 AS h, max(x) + 1 AS w FROM cells GROUP BY ALL),
tl AS (SELECT DISTINCT aoi_id, t, y // t AS ty, x // t AS tx FROM sp, (VALUES (64), (32), (8)) v(t)),
sc AS (SELECT aoi_id, t, count(*) AS n_tiles, sum((least((ty + 1) * t, h) - ty * t) * (least((tx + 1) * t, w) - tx * t))::BIGINT AS px FROM tl JOIN sh USING (aoi_id) GROUP BY ALL UNION ALL SELECT aoi_id, NULL, 1, (h * w)::BIGINT FROM sh),
pl AS (SELECT aoi_id, first(struct_pack(t, n_tiles, px, c) ORDER BY c, t IS NOT NULL, t DESC) AS b, first(struct_pack(t, n_tiles, px, c)) FILTER (t IS NULL) AS w FROM (SELECT *, px + 40.0::DOUBLE * n_tiles AS c FROM sc) GROUP BY ALL),
pn AS (SELECT aoi_id, b.t IS NOT NULL AND (w.c - b.c) / w.c >= 0.15 AS tiled, b, w FROM pl)"""
add("p19_plan_tiles", f"WITH {SPARSE} SELECT aoi_id, CASE WHEN tiled THEN b.t END AS tile_pixels, CASE WHEN tiled THEN b.n_tiles ELSE 1 END AS n_tiles, CASE WHEN tiled THEN b.px ELSE w.px END AS intersecting_pixels, round(CASE WHEN tiled THEN b.c ELSE w.c END, 6) AS predicted_cost, round(CASE WHEN tiled THEN (w.c - b.c) / w.c ELSE 0 END, 6) AS relative_improvement, tiled FROM pn")
add("p19_planned_windows", f"""WITH {SPARSE} SELECT aoi_id, ty::INT AS tile_y, tx::INT AS tile_x, (ty * t)::INT AS y0, least((ty + 1) * t, h)::INT AS y1, (tx * t)::INT AS x0, least((tx + 1) * t, sh.w)::INT AS x1 FROM tl JOIN pn USING (aoi_id) JOIN sh USING (aoi_id) WHERE tiled AND t = b.t
UNION ALL SELECT aoi_id, 0, 0, 0, h::INT, 0, sh.w::INT FROM pn JOIN sh USING (aoi_id) WHERE NOT tiled""")
add("s10_tile_scan", f"WITH {SPARSE} SELECT aoi_id, y // 8 AS tile_y, x // 8 AS tile_x, count(*) AS n_pixels, count(*) FILTER (code = 1) AS n_water FROM cl WHERE (aoi_id, y // 8, x // 8) IN (SELECT (aoi_id, y // 8, x // 8) FROM sp) AND (aoi_id, y // 8, x // 8) NOT IN ((0, 0, 0), (1, 1, 2)) GROUP BY ALL")
add("p25_rasterise", """WITH bands AS (SELECT (p_partkey % 5)::INT AS aoi_id, 'b' || p_partkey // 5 // 64 AS ring, p_partkey // 5 * 1.5::DOUBLE + 0.37::DOUBLE AS x, p_size % 7 + 9.25::DOUBLE AS hi, 7.75::DOUBLE - p_size % 5 AS lo FROM part),
boxes AS (SELECT (s_suppkey % 5)::INT AS aoi_id, 's' || s_suppkey AS ring, s_suppkey // 5 * 12.0::DOUBLE + 3.2::DOUBLE AS x FROM supplier),
pts AS (SELECT aoi_id, ring, row_number() OVER (PARTITION BY aoi_id, ring ORDER BY x) AS o, x, 20 - hi AS y FROM bands UNION ALL SELECT aoi_id, ring, 1000 + row_number() OVER (PARTITION BY aoi_id, ring ORDER BY x DESC), x, 20 - lo FROM bands
  UNION ALL SELECT aoi_id, ring, o, x + dx, 20 - y FROM boxes, (VALUES (1, 0.0::DOUBLE, 8.1::DOUBLE), (2, 4.1::DOUBLE, 8.1::DOUBLE), (3, 4.1::DOUBLE, 8.9::DOUBLE), (4, 0.0::DOUBLE, 8.9::DOUBLE)) v(o, dx, y)),
e AS (SELECT aoi_id, x AS px, y AS py, coalesce(lead(x) OVER w, first_value(x) OVER w) AS qx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS qy FROM pts WINDOW w AS (PARTITION BY aoi_id, ring ORDER BY o)),
grid AS (SELECT aoi_id, (max(p_partkey // 5) * 3 // 2)::INT AS width FROM (SELECT (p_partkey % 5)::INT AS aoi_id, p_partkey FROM part) GROUP BY ALL),
cell AS (SELECT aoi_id, r, unnest(range(width)) AS c FROM (SELECT aoi_id, width, unnest(range(18)) AS r FROM grid)),
middle AS (SELECT cell.aoi_id, r, c FROM cell JOIN e ON e.aoi_id = cell.aoi_id AND least(py, qy) <= r + 0.5 AND r + 0.5 < greatest(py, qy) AND px + (r + 0.5 - py) * (qx - px) / (qy - py) <= c + 0.5 GROUP BY ALL HAVING count(*) % 2 = 1),
through AS (SELECT DISTINCT cell.aoi_id, r, c FROM cell JOIN e ON e.aoi_id = cell.aoi_id AND c < greatest(px, qx) AND c + 1 > least(px, qx) AND r < greatest(py, qy) + 1e-300 AND r + 1 > least(py, qy)
  WHERE (px <> qx OR (c < px AND px < c + 1)) AND (py <> qy OR (r < py AND py < r + 1))
    AND greatest(0, CASE WHEN px <> qx THEN least((c - px) / (qx - px), (c + 1 - px) / (qx - px)) ELSE 0 END, CASE WHEN py <> qy THEN least((r - py) / (qy - py), (r + 1 - py) / (qy - py)) ELSE 0 END)
      < least(1, CASE WHEN px <> qx THEN greatest((c - px) / (qx - px), (c + 1 - px) / (qx - px)) ELSE 1 END, CASE WHEN py <> qy THEN greatest((r - py) / (qy - py), (r + 1 - py) / (qy - py)) ELSE 1 END))
SELECT aoi_id, r::INT AS y, c::INT AS x FROM (SELECT * FROM middle UNION SELECT * FROM through)""")

add("o13_batch_outcomes", f"""WITH {prep('nation', False).replace('obs AS (', 'whole AS (', 1).replace("""
axis AS (""", """
broken AS (SELECT aoi_id, month, n_aoi, n_valid, n_aoi - n_valid + (aoi_id % 9 = 2 AND month(month) = 5)::INT AS n_invalid, CASE WHEN aoi_id % 9 = 3 AND month(month) = 7 THEN -1 ELSE n_water END AS n_water, 1 + (aoi_id % 9 = 1 AND month(month) = 3)::INT AS times
  FROM whole WHERE (aoi_id % 9 <> 4 OR year(month) = 1997) AND (aoi_id % 9 <> 5 OR year(month) < 1996)),
asked AS (SELECT n_nationkey::INT AS aoi_id FROM nation UNION SELECT max(aoi_id) + 1 FROM broken),
within AS (SELECT * FROM broken WHERE month BETWEEN DATE '1996-02-01' AND DATE '1999-11-01'),
judged AS (SELECT asked.aoi_id, (SELECT count(*) FROM broken b WHERE b.aoi_id = asked.aoi_id) AS n_all, count(w.month) AS n_months, min(month) AS first_month, max(month) AS last_month, string_agg(CASE WHEN times > 1 THEN month::VARCHAR END, ', ' ORDER BY month) AS twice, bool_or(n_water < 0) AS negative, bool_or(n_valid + n_invalid <> n_aoi) AS uneven, count(*) FILTER (n_valid > 0) AS seen FROM asked LEFT JOIN within w USING (aoi_id) GROUP BY asked.aoi_id),
outcome AS (SELECT *, CASE WHEN n_all = 0 THEN 'NoRecord' WHEN n_months = 0 THEN 'NoMonths' WHEN twice IS NOT NULL OR negative OR uneven THEN 'BadRecord' WHEN seen < 12 THEN 'ShortRecord' END AS error_type FROM judged),
obs AS (SELECT aoi_id, month, n_aoi, n_valid, n_water FROM within WHERE aoi_id IN (SELECT aoi_id FROM outcome WHERE error_type IS NULL)),
axis AS (""", 1)}, {event_ctes()}
SELECT aoi_id, error_type IS NULL AS succeeded, error_type, CASE error_type WHEN 'NoRecord' THEN 'no record' WHEN 'NoMonths' THEN 'no months inside the requested dates' WHEN 'ShortRecord' THEN 'months with a value: ' || seen || ', needed: 12'
  WHEN 'BadRecord' THEN CASE WHEN twice IS NOT NULL THEN 'duplicate months: ' || twice WHEN negative THEN 'negative counts' ELSE 'valid and invalid pixels don''t add up' END END AS error, n_months, first_month, last_month, n_wet_events, n_low_spells
FROM outcome LEFT JOIN (SELECT aoi_id, count(*) AS n_wet_events FROM ev GROUP BY ALL) USING (aoi_id) LEFT JOIN (SELECT aoi_id, count(*) AS n_low_spells FROM ls GROUP BY ALL) USING (aoi_id)""")


def resolution(f: int) -> str:
    """CTEs of a coarsened record's months, labels, events and fixed years, each under a name of its own resolution; a WITH inside keeps the names apart."""
    months = f"obs AS (SELECT aoi_id, month, count(*) FILTER (code <> -2) AS n_aoi, count(*) FILTER (code IN (0, 1)) AS n_valid, count(*) FILTER (code = 1) AS n_water FROM ({coarse(f)}) GROUP BY ALL)"
    base = f"{PIX}, {prep().replace(obs(), months)}"
    parts = {
        "m": f"WITH {base} SELECT aoi_id, month, extent_pct FROM prep WHERE extent_pct IS NOT NULL",
        "r": f"WITH {base}, {EXT}, m AS (SELECT aoi_id, month(month) AS k, avg(extent_pct) AS m, stddev_samp(extent_pct) AS s FROM q9 GROUP BY ALL) SELECT aoi_id, (max(m) - min(m)) / avg(s) AS snr FROM m GROUP BY ALL",
        "e": f"WITH {base}, {event_ctes('quantile')} SELECT * FROM ev",
        "s": f"WITH {base}, {event_ctes('quantile')} SELECT * FROM ls",
        "y": f"WITH {base}, {FIXED} SELECT aoi_id, hy_year, peak_month, end_dry_month FROM fy",
    }
    return ", ".join(f"{k}{f} AS MATERIALIZED ({sql})" for k, sql in parts.items())


def fidelity(f: int) -> str:
    near = lambda c: f"avg(coalesce(least(abs(month(a.{c}) - month(b.{c})), 12 - abs(month(a.{c}) - month(b.{c}))) <= 1, false)::INT)"
    grade = lambda x: f"CASE WHEN {x} >= 2 THEN 2 WHEN {x} < 0.7 THEN 0 ELSE 1 END"
    many = lambda t, a, out: f"(SELECT aoi_id, {a} AS {out} FROM {t} GROUP BY ALL)"
    count = lambda t, a: f"coalesce((SELECT {a} FROM {t} q WHERE q.aoi_id = k.aoi_id), 0)"
    return f"""SELECT k.aoi_id, k.n_months, CASE WHEN k.flat THEN NULL ELSE k.r END AS correlation, CASE WHEN k.flat THEN 'constant_input' ELSE 'ok' END AS correlation_status, mad AS mean_absolute_difference, xad AS max_absolute_difference, mad / greatest(top, 1e-6) AS normalized_mae,
  rb.snr - ra.snr AS amplitude_bias, ({grade('rb.snr')}) = ({grade('ra.snr')}) AS regime_match, ({grade('rb.snr')}) = ({grade('ra.snr')}) AS route_match,
  ({count(f'e{f}', 'count(*)')} - {count('e1', 'count(*)')})::BIGINT AS event_count_delta, ({count(f's{f}', 'max(duration_months)')} - {count('s1', 'max(duration_months)')})::BIGINT AS longest_low_spell_delta,
  coalesce(w.p, 1) AS peak_within_one_month_fraction, coalesce(w.t, 1) AS trough_within_one_month_fraction, {30 * f} AS candidate_resolution_m
  FROM (SELECT a.aoi_id, count(*) AS n_months, corr(a.extent_pct, b.extent_pct) AS r, min(a.extent_pct) = max(a.extent_pct) OR min(b.extent_pct) = max(b.extent_pct) AS flat, avg(abs(a.extent_pct - b.extent_pct)) AS mad, max(abs(a.extent_pct - b.extent_pct)) AS xad, max(a.extent_pct) AS top FROM m1 a JOIN m{f} b USING (aoi_id, month) GROUP BY ALL) k
  JOIN r1 ra ON ra.aoi_id = k.aoi_id JOIN r{f} rb ON rb.aoi_id = k.aoi_id LEFT JOIN (SELECT a.aoi_id, {near('peak_month')} AS p, {near('end_dry_month')} AS t FROM y1 a JOIN y{f} b USING (aoi_id, hy_year) GROUP BY ALL) w ON w.aoi_id = k.aoi_id"""


FIDELITY = f"WITH {resolution(1)}, {resolution(2)}, {resolution(4)}, fid AS (SELECT * FROM ({fidelity(2)}) UNION ALL SELECT * FROM ({fidelity(4)}))"
_WHOLE = ("aoi_id", "candidate_resolution_m", "n_months", "correlation_status", "regime_match", "route_match", "event_count_delta", "longest_low_spell_delta")
_REAL = ("correlation", "mean_absolute_difference", "max_absolute_difference", "normalized_mae", "amplitude_bias", "peak_within_one_month_fraction", "trough_within_one_month_fraction")
add("o17_resolution_fidelity", f"{FIDELITY} SELECT {', '.join(_WHOLE)}, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in _REAL)} FROM fid")
add("o17_resolution_decisions", f"""{FIDELITY}, g AS (SELECT candidate_resolution_m, count(*) AS n, count(*) FILTER (route_match) AS same, quantile_cont(correlation, 0.5) AS r, quantile_cont(normalized_mae, 0.5) AS e, quantile_cont(peak_within_one_month_fraction, 0.5) AS p, quantile_cont(trough_within_one_month_fraction, 0.5) AS t, max(abs(event_count_delta)) AS ev, max(abs(longest_low_spell_delta)) AS sp FROM fid GROUP BY ALL),
h AS (SELECT *, list_filter([CASE WHEN same < n THEN 'route agreement ' || same || '/' || n END, CASE WHEN r IS NULL OR r < 0.995 THEN 'median correlation ' || coalesce(printf('%.4f', r), 'nan') || ' < 0.995' END, CASE WHEN e > 0.05 THEN printf('median nMAE %.4f > 0.05', e) END, CASE WHEN p < 0.9 THEN printf('peak within 1 month fraction %.3f < 0.90', p) END,
  CASE WHEN t < 0.9 THEN printf('trough within 1 month fraction %.3f < 0.90', t) END, CASE WHEN ev > 1 THEN 'max event delta ' || ev || ' > 1' END, CASE WHEN sp > 2 THEN 'max low spell delta ' || sp || ' > 2' END], lambda x: x IS NOT NULL) AS bad FROM g)
SELECT candidate_resolution_m, same || '/' || n AS route_agreement_count, round(r, 4) AS median_correlation, round(e, 4) AS median_normalized_mae, round(p, 3) AS median_peak_within_one_month, round(t, 3) AS median_trough_within_one_month, ev AS max_abs_event_count_delta, sp AS max_abs_longest_low_spell_delta, len(bad) = 0 AS recommended, CASE WHEN len(bad) = 0 THEN 'passes all gates' ELSE 'fails: ' || array_to_string(bad, '; ') END AS decision_reason FROM h""")
add("o17_matched_events", f"""WITH {resolution(1)}, {resolution(2)}, j AS (SELECT aoi_id, a.event_id AS n, b.event_id AS c, year(a.peak_month) * 12 + month(a.peak_month) AS nm, year(b.peak_month) * 12 + month(b.peak_month) AS cm FROM e1 a JOIN e2 b USING (aoi_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY aoi_id, n ORDER BY abs(cm - nm), cm, c) AS i, row_number() OVER (PARTITION BY aoi_id, c ORDER BY abs(cm - nm), nm, n) AS o FROM j WHERE abs(cm - nm) <= 1)
SELECT aoi_id, n AS event_id, c AS candidate_event_id, (cm - nm)::INT AS delta_months FROM k WHERE i = 1 AND o = 1""")


def _side(v: str) -> str:
    return f"{v}_c AS (SELECT aoi_id, round(concentration, 6) AS r, round(kuiper - 0.4, 6) AS p FROM (WITH {circ(v)} SELECT * FROM cs))"


_COUNTS = """ym AS (SELECT DISTINCT aoi_id, year(m) AS yr FROM (SELECT aoi_id, unnest(generate_series(start_month, end_month, INTERVAL 1 MONTH)) AS m FROM ev)),
nd AS (SELECT aoi_id, count(*) AS dry FROM (SELECT DISTINCT aoi_id, year(month) AS yr FROM es) e WHERE NOT EXISTS (SELECT 1 FROM ym WHERE ym.aoi_id = e.aoi_id AND ym.yr = e.yr) GROUP BY ALL)"""
_BOTH = "obs AS (SELECT * FROM (" + " UNION ALL ".join(f"SELECT * FROM (WITH {obs(*a)} SELECT aoi_id + {n} AS aoi_id, month, n_aoi, n_valid, n_water FROM obs)" for a, n in ((("region", True), 0), (("nation", False), 100))) + ") WHERE aoi_id % 7 <> 3 OR month < DATE '1996-01-01')"
add("r12_explained", f"""WITH {prep('nation', False, 40).replace(obs('nation', False), _BOTH)}, {EXT}, {_side('peak')}, {_side('trough')}, {event_ctes('quantile')}, {_COUNTS},
mm AS (SELECT aoi_id, month(month) AS k, avg(extent_pct) AS m, stddev_samp(extent_pct) AS s FROM q9 GROUP BY ALL), sn AS (SELECT aoi_id, (max(m) - min(m)) / avg(s) * (aoi_id % 4) / 2 AS snr FROM mm GROUP BY aoi_id),
n0 AS (SELECT aoi_id, count(*) FILTER (usable) AS months FROM prep GROUP BY ALL), ny AS (SELECT aoi_id, count(*) AS years FROM ext GROUP BY ALL),
b AS (SELECT n0.aoi_id, months, coalesce(years, 0) AS years, sn.snr, a.r AS pr, a.p AS pp, c.r AS tr, c.p AS tp, n0.aoi_id % 5 = 0 AS lost, coalesce((SELECT count(*) FROM ev WHERE ev.aoi_id = n0.aoi_id), 0) AS nev, coalesce((SELECT max(duration_months) FROM ls WHERE ls.aoi_id = n0.aoi_id), 0) AS nlow, coalesce(dry, 0) AS dry
  FROM n0 LEFT JOIN ny USING (aoi_id) LEFT JOIN sn USING (aoi_id) LEFT JOIN peak_c a USING (aoi_id) LEFT JOIN trough_c c USING (aoi_id) LEFT JOIN nd USING (aoi_id)),
g AS (SELECT *, CASE WHEN years < 5 THEN 'insufficient_record' WHEN snr >= 2 AND pr >= 0.7 THEN 'seasonal' WHEN snr < 0.7 THEN 'aseasonal' WHEN pp >= 0.1 AND years >= 10 THEN 'aseasonal' ELSE 'marginal' END AS regime FROM b),
t AS (SELECT *, CASE WHEN regime = 'insufficient_record' THEN regime WHEN regime = 'seasonal' AND tr >= 0.7 THEN 'per_year_detection' WHEN regime = 'seasonal' OR (regime = 'marginal' AND pp < 0.1 AND tp < 0.1 AND pr >= 0.3 AND tr >= 0.3) THEN 'fixed_climatological_window' ELSE 'event_characterisation' END AS r0 FROM g),
l AS (SELECT *, CASE WHEN lost AND r0 = 'per_year_detection' THEN 'no usual low' WHEN lost AND r0 = 'fixed_climatological_window' THEN 'no usual peak' END AS f, array_to_string(list_filter(['extent is surface water as observed, neither rainfall nor a climate variable', 'regulation, extraction, diversion and land use move extent apart from rainfall',
  CASE WHEN years BETWEEN 5 AND 29 THEN 'under 30 annual timings: the regime stands, intervals may be wide' END, CASE WHEN years BETWEEN 5 AND 9 AND snr >= 2 AND pr < 0.7 AND pp >= 0.1 THEN 'under 10 annual timings the test of uniformity has little power, so the record stays marginal' END,
  CASE regime WHEN 'marginal' THEN 'peaks are too scattered for yearly boundaries; the usual peak is an average only' WHEN 'aseasonal' THEN 'no annual cycle recurs, so no peak or low is given' END, CASE WHEN years >= 5 AND dry > 0 THEN 'years without a wet event: ' || dry || ' of ' || years END], lambda x: x IS NOT NULL), '; ') AS notes FROM t)
SELECT aoi_id, regime, CASE WHEN f IS NULL THEN r0 ELSE 'event_characterisation' END AS route,
  CASE WHEN r0 = 'insufficient_record' THEN 'usable years: ' || years || '; regime unknown, no hydrological year' WHEN f IS NOT NULL THEN 'boundaries can''t be placed (' || f || '); described by events' WHEN r0 = 'per_year_detection' THEN printf('seasonal (SNR %.2f, lows'' concentration at least %.2f): own boundaries each year', snr, tr)
    WHEN r0 = 'fixed_climatological_window' THEN regime || printf(' (SNR %.2f): timing supports one window, imposed on each year', snr) ELSE regime || printf(' (SNR %.2f): timing supports no window, no hydrological year', snr) END AS route_reason,
  CASE WHEN years < 5 THEN 0 ELSE years END AS n_timing_years, months AS n_usable_months, CASE WHEN years < 5 THEN 0 ELSE nev END AS n_wet_events, CASE WHEN years < 5 THEN 0 ELSE nlow END::INT AS longest_low_spell_months, CASE WHEN years < 5 THEN 0 ELSE dry END AS years_without_wet_event,
  CASE regime WHEN 'seasonal' THEN 'Detect a hydrological year''s own boundaries each year; peaks and lows recur.' WHEN 'marginal' THEN 'Report no yearly peak or low; at most one fixed window, named as imposed, beside events.' WHEN 'aseasonal' THEN 'Define no hydrological year; describe the area by wet events and low spells.' ELSE 'Lengthen the record or loosen the quality screen; too few years say nothing on seasonality.' END AS recommended_action,
  notes AS caveats, notes || coalesce('; fell back to events: ' || f, '') AS warnings FROM l""")


add("o21_hydro_years_wide", f"{DN}, {FROMDYN}, {EXT}, mm AS (SELECT aoi_id, month(month) AS k, avg(extent_pct) AS m, stddev_samp(extent_pct) AS s FROM q9 GROUP BY ALL), sn AS (SELECT aoi_id, (max(m) - min(m)) / avg(s) AS snr FROM mm GROUP BY ALL) SELECT {rounded('aoi_id hy_year hy_start hy_end peak_month mid_dry_month end_dry_month n_months_cycle confidence boundary_source', 'peak_extent_pct end_extent_pct amplitude_pct')}, 'marginal' AS regime, 'fixed_climatological_window' AS route, 'imposed_fixed_window' AS boundary_basis FROM fd SEMI JOIN (SELECT aoi_id FROM sn WHERE snr >= 1) USING (aoi_id)")
_IN = "CASE WHEN EXISTS (SELECT 1 FROM {0} x WHERE x.aoi_id = p.aoi_id AND p.month BETWEEN x.start_month AND x.end_month) THEN 'Yes' ELSE 'No' END"
add("o22_annotated_months", f"{EXPORT} SELECT aoi_id, month, year(month)::INT AS year, strftime(month, '%b %Y') AS display_date, round(extent_pct, 6) AS extent_pct, round(invalid_pct, 6) AS invalid_pct, CASE WHEN invalid_pct IS NULL OR quality_state IN ('missing', 'unknown') THEN 'missing' WHEN quality_state = 'usable' AND invalid_pct <= 35 THEN 'good' ELSE 'flagged' END AS quality_filter, {_IN.format('ev')} AS wet_event, {_IN.format('ls')} AS low_extent_spell FROM prep p")
add("o22_year_cards", f"""WITH ph AS MATERIALIZED ({ORACLES['h4_phases_irregular']}), a AS MATERIALIZED ({DN.replace('WITH', 'WITH RECURSIVE', 1)} SELECT * FROM an), m AS MATERIALIZED (WITH {prep('nation', False, 40)} SELECT * FROM prep), n AS (SELECT *, (row_number() OVER (PARTITION BY aoi_id ORDER BY hy_year DESC))::INT AS card FROM a)
SELECT n.aoi_id, card, n.hy_year, m.month, CASE WHEN m.month IS NOT NULL THEN CASE WHEN ph.phase IS NULL OR ph.phase = 'unspecified' THEN 'Unassigned' ELSE upper(ph.phase[1]) || ph.phase[2:] END END AS phase, round(m.extent_pct, 6) AS extent_pct, round(m.invalid_pct, 6) AS invalid_pct,
  CASE m.month WHEN peak_month THEN 'Wet Peak' WHEN temporal_mid_dry_month THEN 'Mid Dry' WHEN trough_month THEN 'Dry End' END AS marker, cycle_months, round(drawdown_pct, 6) AS drawdown_pct, confidence, status_reason
FROM n LEFT JOIN m ON m.aoi_id = n.aoi_id AND m.month BETWEEN hy_start AND hy_end LEFT JOIN ph ON ph.aoi_id = n.aoi_id AND ph.month = m.month""")
add("o24_season_labels", f"{DN}, y AS (SELECT p.aoi_id, p.month, arg_max(an.hy_year, an.hy_year) AS hy_year, arg_max(coalesce(p.month <= peak_month, false), an.hy_year) AS wet FROM prep p JOIN an ON an.aoi_id = p.aoi_id AND an.status = 'complete' AND p.month BETWEEN hy_start AND hy_end GROUP BY ALL) SELECT p.aoi_id, p.month, hy_year, CASE WHEN wet IS NULL THEN 'unassigned' WHEN wet THEN 'Wet' ELSE 'Dry' END AS season FROM prep p LEFT JOIN y USING (aoi_id, month)")
_NEAR = "CASE WHEN {0}_condition IN ('low', 'high') AND coalesce(abs({1}_extent_pct - {1}_m) < noise_pp, false) THEN 'typical_uncertain' ELSE {0}_condition END"
add("c5_qualified_conditions", f"""WITH c AS MATERIALIZED ({ORACLES['c6_annual_condition']}), z AS (WITH {prep('nation', False)}, {SCALE} SELECT aoi_id, noise_pp FROM scale),
m AS (SELECT a.aoi_id, a.hy_year, quantile_cont(b.peak_extent_pct, 0.5) AS peak_m, quantile_cont(b.trough_extent_pct, 0.5) AS trough_m FROM c a LEFT JOIN c b ON b.aoi_id = a.aoi_id AND b.eligible AND b.hy_year <> a.hy_year GROUP BY ALL),
q AS (SELECT *, {_NEAR.format('recharge', 'peak')} AS rq, {_NEAR.format('refuge', 'trough')} AS fq, peak_extent_pct - trough_extent_pct AS size FROM c JOIN m USING (aoi_id, hy_year) LEFT JOIN z USING (aoi_id))
SELECT aoi_id, hy_year, rq AS recharge_condition_qualified, fq AS refuge_condition_qualified, CASE WHEN annual_condition = 'insufficient_baseline' THEN annual_condition WHEN rq = 'high' AND fq = 'high' THEN 'wet_persistent' WHEN rq = 'high' AND fq = 'low' THEN 'recharged_then_contracting' WHEN rq = 'low' AND fq = 'high' THEN 'buffered_low_recharge' WHEN rq = 'low' AND fq = 'low' THEN 'dry_low_refuge' ELSE 'typical_or_mixed' END AS annual_condition_qualified,
  CASE WHEN size IS NULL OR noise_pp IS NULL THEN 'unknown' WHEN size < 2 * noise_pp THEN 'low' ELSE 'high' END AS timing_confidence FROM q""")
