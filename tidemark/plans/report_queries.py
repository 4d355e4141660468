"""Reports 01 to 11: typology, statistics, drift, ranking, periodicity, regimes, correlation, lead and lag, influence, departure, validity.

Periods of a signal's life (the first and last fifth, what follows the first fifth, halves) are told by conditional
aggregates over one pass, not by a join of a subset for each.
"""

from __future__ import annotations

from .dag import corr, div, first_of, ladder, r, rank, view

K = "partition by cohort, signal_id"
W = f"over ({K} order by s0)"


def slope(where: str) -> str:
    """Least-squares slope of value along s0 over the rows that the condition holds for; null where the axis doesn't vary."""
    both = f"{where} and value is not null"
    return div(f"covar_pop(value, s0) filter (where {both})", f"var_pop(s0) filter (where {both})")


def log_ratio(x: str) -> str:
    return f"case when {x} = 0 then null else {r(f'ln(abs({x}))', 2)} end"


def shares(n: str) -> str:
    return r(f"100.0 * {n} / sum({n}) over ()", 1)


# --- 01 typology -------------------------------------------------------------------------------------------------
view("report_01_signal_overview", f"""
select t.cohort, t.signal_id, t.continuity, t.memory, t.trend, t.derivative_depth, d.onset, d.most_active, s.mean, s.std, {r('s.cv', 2)} as cv, {r('m.acf1', 3)} as acf_lag1, m.r2 as trend_r2
from @typology t left join @signal_statistics s on t.cohort = s.cohort and t.signal_id = s.signal_id left join @signal_derivatives d on t.cohort = d.cohort and t.signal_id = d.signal_id left join @signal_temporal m on t.cohort = m.cohort and t.signal_id = m.signal_id""")
view("report_01_class_shares", " union all ".join(f"select '{n}' as dimension, class, n_signals, {shares('n_signals')} as pct from (select {c} as class, count(distinct signal_id) as n_signals from @typology_enriched group by {c}) x" for n, c in (("Continuity", "continuity"), ("Memory", "memory_class"), ("Temporal", "trend"), ("Complexity", "complexity_class"))))
view("report_01_memory_summary", f"""
select t.cohort, t.signal_id, t.memory_class, {r('m.acf1', 4)} as acf_lag1, {first_of(("t.memory_class = 'long_memory'", 'ACF-driven (4 x half-life)'), ("t.memory_class in ('short_memory', 'anti_persistent')", 'Minimum window (noise averaging)'), other='ACF-driven')} as window_rationale
from @typology_enriched t left join @signal_temporal m on t.cohort = m.cohort and t.signal_id = m.signal_id""")
_DEPTH = ("depth >= 4", "DEEP_DYNAMICS (complex oscillator)"), ("depth = 3", "MODERATE_DYNAMICS (accelerating system)"), ("depth = 2", "SHALLOW_DYNAMICS (trending signal)"), ("depth = 1", "MINIMAL_DYNAMICS (smooth drift)"), ("depth = 0", "FLAT (constant or noise)")
view("report_01_derivative_depth", f"select s.cohort, s.signal_id, p.depth, {r('s.d1_snr', 2)} as d1_snr, {r('s.d2_snr', 2)} as d2_snr, {first_of(*_DEPTH, other='UNKNOWN')} as dynamics_interpretation from @derivative_stats s join @derivative_depth p on s.cohort = p.cohort and s.signal_id = p.signal_id")
_ONSET = (0.2, "VERY_EARLY_ONSET (degradation from start)"), (0.4, "EARLY_ONSET (early degradation)"), (0.6, "MID_LIFE_ONSET"), (0.8, "LATE_ONSET (long stable period)")
view("report_01_onset", f"select o.cohort, o.signal_id, o.onset_life, {ladder('o.onset_life', '<', *_ONSET, other='VERY_LATE_ONSET (sudden end-of-life)')} as onset_class, g.most_active, t.trend from @derivative_onset o left join @derivative_regions g on o.cohort = g.cohort and o.signal_id = g.signal_id left join @typology t on o.cohort = t.cohort and o.signal_id = t.signal_id")
view("report_01_system_summary", f"""
select count(distinct t.signal_id) as total_signals, count(distinct t.signal_id) filter (where t.continuity = 'continuous') as n_continuous, count(distinct t.signal_id) filter (where t.continuity = 'discrete') as n_discrete, count(distinct t.signal_id) filter (where t.memory_class in ('long_memory', 'persistent')) as n_persistent,
       count(distinct t.signal_id) filter (where t.memory_class = 'short_memory') as n_short_memory, {r('avg(t.derivative_depth)', 4)} as avg_derivative_depth, count(distinct t.signal_id) filter (where o.onset is not null) as n_signals_with_onset
from @typology_enriched t left join @derivative_onset o on t.cohort = o.cohort and t.signal_id = o.signal_id""")

# --- 02 statistics -----------------------------------------------------------------------------------------------
view("report_02_basic_statistics", f"select cohort, signal_id, {r('mean', 4)} as mean, {r('std', 4)} as std, {r('cv', 2)} as cv, {r('skewness', 3)} as skewness, {r('kurtosis', 3)} as kurtosis, value_min, value_max, {r('value_max - value_min', 4)} as value_range, {r('median', 4)} as median, {r('q3 - q1', 4)} as iqr, n, continuity from @signal_statistics")
_plain_shape = "abs(skewness) < 0.5 and kurtosis between 2.5 and 3.5"
view("report_02_distribution_shape", f"""
select cohort, signal_id, skewness, kurtosis, {first_of(('abs(skewness) < 0.5', 'SYMMETRIC'), ('skewness > 0.5', 'RIGHT_SKEWED'), ('skewness < -0.5', 'LEFT_SKEWED'), other='UNKNOWN')} as skew_class, {first_of(('kurtosis < 2.5', 'PLATYKURTIC (light tails)'), ('kurtosis <= 3.5', 'MESOKURTIC (normal-like)'), ('kurtosis > 3.5', 'LEPTOKURTIC (heavy tails)'), other='UNKNOWN')} as tail_class,
       {first_of((_plain_shape, 'APPROXIMATELY_NORMAL'), ('kurtosis > 6', 'EXTREME_TAILS (outlier-prone)'), ('abs(skewness) > 2', 'HIGHLY_ASYMMETRIC'), other='NON_NORMAL')} as distribution_summary from @signal_statistics""")
view("report_02_temporal_properties", f"select cohort, signal_id, acf1, slope, r2, direction, n_reversals, n_crossings, std_ratio, mean_drift, {ladder('r2', '>', (0.5, 'STRONG_TREND'), (0.1, 'MODERATE_TREND'), (0.01, 'WEAK_TREND'), other='NO_TREND')} as trend_class from @signal_temporal")
view("report_02_primitives", f"""
select cohort, signal_id, {r('hurst', 4)} as hurst, {first_of(('hurst > 0.65', 'PERSISTENT (trending)'), ('hurst >= 0.35', 'RANDOM_WALK'), ('hurst < 0.35', 'ANTI_PERSISTENT (mean-reverting)'), other='UNKNOWN')} as hurst_class, sample_entropy, permutation_entropy, {r('spectral_entropy', 4)} as spectral_flatness,
       {first_of(('spectral_entropy > 0.5', 'BROADBAND (noise-like)'), ('spectral_entropy > 0.1', 'MIXED_SPECTRUM'), ('spectral_entropy <= 0.1', 'NARROWBAND (periodic)'), other='UNKNOWN')} as spectral_class from @typology_enriched""")
view("report_02_comparison_matrix", f"""
select s.cohort, s.signal_id, s.std, s.cv, m.acf1, e.hurst, e.spectral_entropy, e.derivative_depth, {rank('s.std', 's.cohort')} as rank_by_variability, {rank('m.acf1', 's.cohort')} as rank_by_persistence, {rank('e.hurst', 's.cohort')} as rank_by_hurst, {rank('e.derivative_depth', 's.cohort')} as rank_by_complexity
from @signal_statistics s left join @signal_temporal m on s.cohort = m.cohort and s.signal_id = m.signal_id left join @typology_enriched e on s.cohort = e.cohort and s.signal_id = e.signal_id""")
_FLAGS = (("s.cv > 100", "cv_flag", "HIGH_CV (>100%)"), ("s.kurtosis > 10", "kurtosis_flag", "EXTREME_KURTOSIS (>10)"), ("abs(s.skewness) > 2", "skew_flag", "EXTREME_SKEW (|s|>2)"), ("m.r2 > 0.5", "trend_flag", "STRONG_TREND (r2>0.5)"), ("m.acf1 > 0.99", "unit_root_flag", "NEAR_UNIT_ROOT (acf>0.99)"), ("e.hurst < 0.2", "hurst_flag", "STRONG_ANTI_PERSIST (H<0.2)"))
view("report_02_anomaly_flags", f"""
select s.cohort, s.signal_id, {', '.join(f"case when {c} then '{t}' end as {n}" for c, n, t in _FLAGS)} from @signal_statistics s left join @signal_temporal m on s.cohort = m.cohort and s.signal_id = m.signal_id left join @typology_enriched e on s.cohort = e.cohort and s.signal_id = e.signal_id
where {' or '.join(c for c, _, _ in _FLAGS)}""")

# --- 03 drift ----------------------------------------------------------------------------------------------------
view("lives", f"""
-- each place with the bounds of its signal's first and last fifth, its tenth of the whole and its fifth of what follows the first fifth
select *, case when s0 > base_end then ntile(5) over ({K}, s0 > base_end order by s0) end as post_fifth, case when s0 > base_end then ntile(10) over ({K}, s0 > base_end order by s0) end as post_tenth
from (select cohort, signal_id, s0, value, ntile(10) {W} as tenth, min(s0) over ({K}) + 0.2 * (max(s0) over ({K}) - min(s0) over ({K})) as base_end, min(s0) over ({K}) + 0.8 * (max(s0) over ({K}) - min(s0) over ({K})) as late_start from @obs) x""")
_base, _late, _post = "s0 <= base_end", "s0 >= late_start", "s0 > base_end"
view("life_slopes", f"""
select cohort, signal_id, count(*) as n, {r(slope(_base), 9)} as base_slope, {r(slope(_late), 9)} as late_slope, {r(slope(_post), 9)} as post_slope, {', '.join(f"{r(f'avg(value) filter (where {c})', 9)} as {n}_mean, {r(f'stddev_pop(value) filter (where {c})', 9)} as {n}_std" for n, c in (('base', _base), ('late', _late)))} from @lives group by cohort, signal_id""")
view("tenth_slopes", f"select cohort, signal_id, tenth as window_id, min(s0) as t_start, max(s0) as t_end, {r(slope('true'), 9)} as window_slope from @lives group by cohort, signal_id, tenth")
view("post_slopes", f"select cohort, signal_id, post_fifth as window_id, {r(slope('true'), 9)} as window_slope from @lives where post_fifth is not null group by cohort, signal_id, post_fifth")
view("persistence", "select cohort, signal_id, count(*) filter (where window_slope > 0) as up, count(*) filter (where window_slope < 0) as down, count(*) as n_windows, avg(window_slope) as mean_slope from @post_slopes group by cohort, signal_id")
_ratio = div("late_slope", "base_slope")
view("report_03_baseline_departure", f"""
select l.cohort, l.signal_id, l.base_slope as baseline_slope, l.late_slope, {r(_ratio, 2)} as slope_ratio, {log_ratio(_ratio)} as log_slope_ratio, case when sign(base_slope) <> sign(late_slope) then 'YES' else 'NO' end as slope_reversed, {r('abs(late_slope - base_slope) * n', 4)} as drift_magnitude, {r(div('late_std', 'base_std'), 2)} as vol_ratio, {r(div('100.0 * (late_std - base_std)', 'base_std'), 1)} as std_change_pct,
       {first_of(('p.n_windows >= 5 and p.up = p.n_windows', 'PERSISTENT_ACCELERATION'), ('p.n_windows >= 5 and p.down = p.n_windows', 'PERSISTENT_DECELERATION'), ('p.n_windows >= 5 and greatest(p.up, p.down) >= p.n_windows - 1', 'PERSISTENT_DRIFT'), ('sign(base_slope) <> sign(late_slope)', 'REVERSED'), (f'abs({_ratio}) > 3.0', 'DRIFT'), (f'abs({_ratio}) > 1.5', 'WATCH'), other='WITHIN_BASELINE')} as drift_status
from @life_slopes l left join @persistence p on l.cohort = p.cohort and l.signal_id = p.signal_id""")
_wr = div("w.window_slope", "l.base_slope")
_turn = "sign(w.window_slope) <> sign(l.base_slope)"
view("report_03_drift_start", f"""
select w.cohort, w.signal_id, w.window_id, w.t_start, w.t_end, l.base_slope as baseline_slope, w.window_slope, {r(_wr, 2)} as slope_ratio, {log_ratio(_wr)} as log_slope_ratio, {first_of((_turn, 'REVERSED'), (f'abs({_wr}) > 2.0', 'ACCELERATING'), (f'abs({_wr}) < 0.5', 'DECELERATING'), other='WITHIN_BASELINE')} as status
from @tenth_slopes w join @life_slopes l on w.cohort = l.cohort and w.signal_id = l.signal_id where w.window_id > 2 and ({_turn} or abs({_wr}) > 1.5 or abs({_wr}) < 0.5)""")
_pr = div("p.mean_slope", "l.base_slope")
view("report_03_nonreverting_drift", f"""
select p.cohort, p.signal_id, l.base_slope as baseline_slope, {r('p.mean_slope', 9)} as avg_post_slope, {r(_pr, 2)} as slope_ratio, {log_ratio(_pr)} as log_slope_ratio, p.up as windows_positive, p.down as windows_negative, p.n_windows,
       {first_of(('p.up = p.n_windows', 'PERSISTENT_INCREASE'), ('p.down = p.n_windows', 'PERSISTENT_DECREASE'), ('p.up >= 4', 'MOSTLY_INCREASING'), ('p.down >= 4', 'MOSTLY_DECREASING'), other='OSCILLATING')} as drift_pattern from @persistence p join @life_slopes l on p.cohort = l.cohort and p.signal_id = l.signal_id where greatest(p.up, p.down) >= 4""")
_vr = div("late_std * late_std", "base_std * base_std")
view("report_03_volatility_drift", f"select cohort, signal_id, base_std as baseline_std, late_std, {r(div('100.0 * (late_std - base_std)', 'base_std'), 1)} as pct_change, {r(_vr, 2)} as variance_ratio, {first_of((f'{_vr} > 1.5', 'VOLATILITY_UP'), (f'{_vr} < 0.67', 'VOLATILITY_DOWN'), other='STABLE')} as volatility_status from @life_slopes")
view("report_03_system_drift", f"""
select cohort, direction, count(*) as n_signals, {r('100.0 * count(*) / sum(count(*)) over (partition by cohort)', 1)} as pct_of_total, {r('avg(ratio)', 4)} as avg_slope_ratio, {r('min(ratio)', 4)} as min_slope_ratio, {r('max(ratio)', 4)} as max_slope_ratio
from (select cohort, {div('post_slope', 'base_slope')} as ratio, {first_of(('sign(base_slope) <> sign(post_slope)', 'REVERSED'), (f"{div('post_slope', 'base_slope')} > 1.5", 'ACCELERATING'), (f"{div('post_slope', 'base_slope')} < 0.5", 'DECELERATING'), other='STABLE')} as direction from @life_slopes where base_slope is not null and post_slope is not null) x group by cohort, direction""")
view("report_03_exceedance_events", f"""
select o.cohort, o.signal_id, count(*) as n_exceedances, min(o.s0) as first_exceedance_t, max(o.s0) as last_exceedance_t, count(*) filter (where o.value > l.base_mean) as n_high_exceedances, count(*) filter (where o.value < l.base_mean) as n_low_exceedances
from @lives o join @life_slopes l on o.cohort = l.cohort and o.signal_id = l.signal_id where o.s0 > o.base_end and abs(o.value - l.base_mean) > 2 * l.base_std group by o.cohort, o.signal_id""")
view("report_03_coordinated_drift", f"""
select cohort, first_departure_window, count(*) as n_signals, #list(signal_id; ', ') as affected_signals from (
  select w.cohort, w.signal_id, min(w.window_id) as first_departure_window from (select cohort, signal_id, post_tenth as window_id, {r(slope('true'), 9)} as window_slope from @lives where post_tenth is not null group by cohort, signal_id, post_tenth) w join @life_slopes l on w.cohort = l.cohort and w.signal_id = l.signal_id
  where abs({_wr}) > 2.0 or {_turn} group by w.cohort, w.signal_id) x group by cohort, first_departure_window""")
view("report_03_drift_timeline", f"""
select w.cohort, w.signal_id, w.window_id, w.t_start as t, l.base_slope as baseline_slope, w.window_slope, {r(_wr, 2)} as slope_ratio, {log_ratio(_wr)} as log_slope_ratio, repeat('█', cast(greatest(0, least(20, round(10 + 5 * coalesce({_wr}, 0), 0))) as integer)) as bar
from @tenth_slopes w join @life_slopes l on w.cohort = l.cohort and w.signal_id = l.signal_id where l.base_slope <> 0""")

# --- 04 ranking --------------------------------------------------------------------------------------------------
_cv = div("std_val", "abs(mean_val)")
view("report_04_signal_importance", f"""
select s.cohort, s.signal_id, u.unit, s.n_points, {r(_cv, 3)} as coeff_variation, {r(div('s.hi - s.lo', 's.std_val'), 2)} as range_std_ratio, {r('100.0 * s.std_val / nullif(max(s.std_val) over (partition by s.cohort), 0)', 1)} as pct_max_variability, {ladder(_cv, '>', (0.5, 'HIGH_INFO'), (0.1, 'MEDIUM_INFO'), other='LOW_INFO')} as information_class, {rank('s.std_val', 's.cohort')} as variability_rank
from (select cohort, signal_id, count(*) as n_points, avg(value) as mean_val, stddev_pop(value) as std_val, min(value) as lo, max(value) as hi from @obs group by cohort, signal_id) s left join @signals u on s.signal_id = u.signal_id""")
view("halves", f"""
-- either half of the cohort's axis
select cohort, signal_id, {', '.join(f"{r(f'avg(value) filter (where {c})', 9)} as {n}_mean, {r(f'stddev_samp(value) filter (where {c})', 9)} as {n}_std, {r(slope(c), 9)} as {n}_slope" for n, c in (('early', 's0 < mid'), ('late', 's0 >= mid')))}
from (select cohort, signal_id, s0, value, min(s0) over (partition by cohort) + 0.5 * (max(s0) over (partition by cohort) - min(s0) over (partition by cohort)) as mid from @obs) x group by cohort, signal_id having count(*) filter (where s0 < mid) > 0 and count(*) filter (where s0 >= mid) > 0""")
_vol, _turned = div("late_std", "early_std"), div("abs(late_slope - early_slope)", "abs(early_slope)")
view("report_04_departure_signals", f"""
select cohort, signal_id, {r('vol', 2)} as vol_ratio, early_slope, late_slope, {r('turned', 2)} as slope_change_pct, {first_of(('vol > 1.5 and turned > 2', 'CRITICAL'), ('turned > 2', 'TRAJECTORY_CHANGED'), ('vol > 1.5', 'UNSTABLE'), other='WITHIN_BASELINE')} as departure_type, {rank('vol * (1 + coalesce(turned, 0))', 'cohort', digits=4)} as departure_rank
from (select *, {_vol} as vol, {_turned} as turned from @halves) x where vol > 1.3 or turned > 1.0""")
view("report_04_leading_indicators", f"""
select cohort, signal_id, first_move_window, {ladder('first_move_window', '<=', (2, 'EARLY_MOVER'), (4, 'MID_MOVER'), (6, 'LATE_MOVER'), other='STABLE')} as movement_class, rank() over (partition by cohort order by first_move_window) as early_rank
from (select cohort, signal_id, min(window_id) as first_move_window from (select cohort, signal_id, window_id, {div(f'abs(m - lag(m) over ({K} order by window_id))', 's')} as moved from (select cohort, signal_id, tenth as window_id, avg(value) as m, stddev_pop(value) as s from @lives group by cohort, signal_id, tenth) a) b where moved > 0.5 group by cohort, signal_id) c""")
view("report_04_redundant_pairs", f"""
select cohort, signal_a, signal_b, {r('correlation', 3)} as correlation, {ladder('abs(correlation)', '>', (0.95, 'HIGHLY_REDUNDANT'), (0.85, 'REDUNDANT'), (0.7, 'CORRELATED'), other='INDEPENDENT')} as redundancy_class, {first_of(('correlation > 0.95', 'Consider removing one'), ('correlation < -0.95', 'Inverse relationship - keep both'), other='WITHIN_BASELINE')} as recommendation
from @pairwise_full where abs(correlation) > 0.7""")
_hr = div("late_slope", "early_slope")
view("report_04_departure_dashboard", f"""
select h.cohort, h.signal_id, u.unit, h.early_mean, h.late_mean, {r('vol', 2)} as vol_ratio, early_slope, late_slope, {r('ratio', 2)} as slope_ratio, {log_ratio('ratio')} as log_slope_ratio, turned as slope_reversed, {r(f"coalesce({log_ratio('ratio')}, 0) + abs({r('vol', 2)} - 1) * 2 + turned * 3", 4)} as departure_score,
       {first_of(('turned = 1 or abs(ratio) > 3.0 or vol > 1.5', 'DEPARTED'), ('abs(ratio) > 2.0 or vol > 1.2', 'SHIFTED'), other='STABLE')} as status, {first_of(('turned = 1', 'SLOPE_REVERSED'), ('ratio > 3.0', 'ACCELERATING'), ('ratio < -1.0', 'REVERSED'), ('vol > 1.5', 'UNSTABLE'), other='WITHIN_BASELINE')} as issue
from (select *, {_vol} as vol, {_hr} as ratio, case when sign(early_slope) <> sign(late_slope) then 1 else 0 end as turned from @halves) h left join @signals u on h.signal_id = u.signal_id""")

# --- 05 periodicity ----------------------------------------------------------------------------------------------
view("centred", f"""
-- departures from the signal's mean with their neighbours
select cohort, signal_id, s0, x, lag(x) {W} as prv, lead(x) {W} as nxt, dev, ntile(5) {W} as fifth from (select cohort, signal_id, s0, value - avg(value) over ({K}) as x, stddev_pop(value) over ({K}) as dev from @obs) c""")
_rate = div("1.0 * n_crossings", "span")
view("report_05_zero_crossings", f"""
select cohort, signal_id, n_crossings, n_points, span as time_span, {r(_rate, 4)} as crossing_rate, {r(f'0.5 * {_rate}', 4)} as approx_frequency, {ladder(_rate, '>', (0.5, 'HIGH_FREQUENCY'), (0.1, 'MEDIUM_FREQUENCY'), (0.01, 'LOW_FREQUENCY'), other='QUASI_STATIC')} as frequency_class
from (select cohort, signal_id, count(*) filter (where x * prv < 0) as n_crossings, count(*) as n_points, max(s0) - min(s0) as span from @centred group by cohort, signal_id) y""")
_peak, _trough = "x > prv and x > nxt", "x < prv and x < nxt"
view("report_05_oscillation_amplitude", f"""
select cohort, signal_id, n_peaks, n_troughs, {r('amp', 4)} as avg_oscillation_amp, {r('top', 4)} as max_oscillation_amp, {r(div('amp', 'dev'), 2)} as normalized_amplitude, {ladder(div('amp', 'dev'), '>', (1.5, 'STRONG_OSCILLATION'), (0.8, 'MODERATE_OSCILLATION'), (0.3, 'WEAK_OSCILLATION'), other='NO_OSCILLATION')} as oscillation_class
from (select cohort, signal_id, count(*) filter (where {_peak}) as n_peaks, count(*) filter (where {_trough}) as n_troughs, avg(abs(x)) filter (where ({_peak}) or ({_trough})) as amp, max(abs(x)) filter (where ({_peak}) or ({_trough})) as top, max(dev) as dev from @centred group by cohort, signal_id) y""")
_pv = div("stddev_pop(gap)", "avg(gap)")
view("report_05_period_estimation", f"""
select cohort, signal_id, count(*) as n_intervals, {r('avg(gap)', 4)} as avg_period, {r('stddev_pop(gap)', 4)} as period_std, min(gap) as min_period, max(gap) as max_period, {r(_pv, 3)} as period_variability, {ladder(_pv, '<', (0.1, 'HIGHLY_PERIODIC'), (0.3, 'QUASI_PERIODIC'), (0.5, 'IRREGULAR'), other='APERIODIC')} as periodicity_class
from (select cohort, signal_id, s0 - lag(s0) {W} as gap from @centred where {_peak}) y where gap > 0 group by cohort, signal_id having count(*) >= 3""")
view("report_05_autocorrelation", f"""
select cohort, signal_id, acf_lag1, acf_lag5, acf_lag10, {ladder('acf_lag1', '>', (0.95, 'HIGHLY_PERSISTENT'), (0.8, 'PERSISTENT'), (0.5, 'MODERATE_MEMORY'), (0, 'LOW_MEMORY'), other='ANTI_PERSISTENT')} as memory_class, {first_of(('acf_lag5 > 0.5 and acf_lag10 > 0.3', 'LONG_MEMORY'), ('acf_lag5 > 0.3', 'MEDIUM_MEMORY'), other='SHORT_MEMORY')} as memory_horizon,
       {first_of(('acf_lag5 < -0.3 or acf_lag10 < -0.3', 'OSCILLATING'), other='NON_OSCILLATING')} as oscillation_hint from @v_autocorrelation""")
view("report_05_cyclic_changes", f"""
select cohort, signal_id, {', '.join(f'{r(f"max(case when fifth = {k} then rate end)", 4)} as rate_w{k}' for k in range(1, 6))}, {r('max(rate) - min(rate)', 4)} as rate_change, {first_of(('max(rate) - min(rate) > 0.2', 'FREQUENCY_SHIFT'), ('max(rate) > 1.5 * min(rate)', 'FREQUENCY_DRIFT'), other='STABLE_FREQUENCY')} as frequency_stability
from (select cohort, signal_id, fifth, 1.0 * count(*) filter (where x * before < 0) / count(*) as rate from (select cohort, signal_id, fifth, x, lag(x) over ({K}, fifth order by s0) as before from @centred) a group by cohort, signal_id, fifth) b group by cohort, signal_id having max(rate) - min(rate) > 0.05""")
_rev = "1.0 * n_reversals / n_points"
view("report_05_hunting", f"""
select h.cohort, h.signal_id, n_reversals, n_points, {r(_rev, 4)} as reversal_rate, {r('excursion', 4)} as avg_excursion, {ladder(_rev, '>', (0.3, 'SEVERE_HUNTING'), (0.2, 'MODERATE_HUNTING'), (0.1, 'MILD_HUNTING'), other='WITHIN_BASELINE')} as hunting_severity, {ladder(_rev, '>', (0.3, 'HIGH_FREQUENCY_REVERSALS'), (0.2, 'ELEVATED_REVERSAL_RATE'), other='WITHIN_BASELINE')} as recommendation
from (select cohort, signal_id, count(*) filter (where sign(x) <> sign(prv)) as n_reversals, count(*) as n_points, avg(abs(x)) as excursion, max(dev) as dev from @centred group by cohort, signal_id) h join @typology t on h.cohort = t.cohort and h.signal_id = t.signal_id where t.continuity = 'continuous' and {_rev} > 0.4 and excursion > 0.8 * dev""")

view("drift_windows", f"select cohort, signal_id, q, avg(value) as m, stddev_samp(value) as s from (select cohort, signal_id, value, ntile(10) {W} as q from @obs) x group by cohort, signal_id, q")
view("regime_tiles", f"select cohort, signal_id, tile, avg(value) as m, max(value) - min(value) as span, stddev_samp(value) as s from (select cohort, signal_id, value, ntile(20) {W} as tile from @obs) x group by cohort, signal_id, tile")

# --- 06 regimes --------------------------------------------------------------------------------------------------
view("tile_moves", f"""
select cohort, signal_id, tile as window_id, m as sig_mean, span as sig_range, {div(f'abs(m - lag(m) over ({K} order by tile))', 'span')} as moved, {div('span', f'lag(span) over ({K} order by tile)')} as range_ratio from @regime_tiles""")
_shifted = "100.0 * n_mean_shifts / n_signals"
view("report_06_regime_identification", f"""
select cohort, window_id, n_signals, n_mean_shifts, n_vol_shifts, {r(_shifted, 1)} as pct_signals_shifted, {first_of((f'{_shifted} > 25', 'REGIME_CHANGE'), (f'{_shifted} > 5', 'PARTIAL_SHIFT'), ('n_vol_shifts > n_signals * 0.3', 'VOLATILITY_CHANGE'), ('n_mean_shifts between 1 and 3', 'SIGNAL_DRIFT'), other='STABLE')} as boundary_type
from (select cohort, window_id, count(*) as n_signals, count(*) filter (where moved > 0.5) as n_mean_shifts, count(*) filter (where range_ratio > 1.5 or range_ratio < 0.67) as n_vol_shifts from @tile_moves where moved is not null group by cohort, window_id) x where n_mean_shifts > 0 or n_vol_shifts > 0""")
view("report_06_signal_shifts", f"select cohort, signal_id, window_id, {r('sig_mean', 4)} as sig_mean, {r('moved', 4)} as change_magnitude, {r('range_ratio', 4)} as volatility_ratio, {rank('moved', 'cohort')} as shift_rank from @tile_moves where moved > 0.5 order by round(moved, 6) desc, cohort, signal_id, window_id limit 50")
view("report_06_steady_state", f"""
select cohort, window_id, n_steady_signals, n_total_signals, {r('100.0 * n_steady_signals / n_total_signals', 1)} as pct_steady, {ladder('100.0 * n_steady_signals / n_total_signals', '>', (90, 'STEADY_STATE'), (70, 'QUASI_STEADY'), (50, 'TRANSITION'), other='DYNAMIC')} as operating_mode
from (select cohort, window_id, count(*) filter (where moved < 0.05) as n_steady_signals, count(*) as n_total_signals from (select cohort, signal_id, window_id, {div(f'abs(m - lag(m) over ({K} order by window_id))', 'span')} as moved from (select cohort, signal_id, window_id, avg(value) as m, max(value) - min(value) as span from (select cohort, signal_id, value, ntile(50) {W} as window_id from @obs) a group by cohort, signal_id, window_id) b) c group by cohort, window_id) d""")
view("report_06_transients", f"""
select cohort, signal_id, s0 as transient_time, {r('rate', 4)} as rate, {r('p', 4)} as rate_pctl, {rank('p', 'cohort')} as transient_rank from (select cohort, signal_id, s0, rate, percent_rank() over ({K} order by round(abs(rate), 6)) as p from (select cohort, signal_id, s0, {div(f'value - lag(value) {W}', f's0 - lag(s0) {W}')} as rate from @obs) a where rate is not null) b where p > 0.98""")

# --- 07 correlation ----------------------------------------------------------------------------------------------
_cr = lambda where: f"({div(f'covar_pop(va, vb) filter (where {where})', f'stddev_pop(case when vb is not null then va end) filter (where {where}) * stddev_pop(case when va is not null then vb end) filter (where {where})')})"
view("pair_periods", f"""
select cohort, signal_a, signal_b, {r(_cr('s0 <= base_end'), 9)} as base, {r(_cr('s0 >= late_start'), 9)} as late
from (select p.*, l.lo + 0.2 * (l.hi - l.lo) as base_end, l.lo + 0.8 * (l.hi - l.lo) as late_start from @pair_points p join (select cohort, min(s0) as lo, max(s0) as hi from @obs group by cohort) l on p.cohort = l.cohort) x group by cohort, signal_a, signal_b""")
view("report_07_baseline_vs_late", f"""
select cohort, signal_a, signal_b, {r('base', 3)} as baseline_corr, {r('late', 3)} as late_corr, {r('late - base', 3)} as corr_change, {ladder('abs(late - base)', '>', (0.3, 'MAJOR_CHANGE'), (0.15, 'MODERATE_CHANGE'), other='STABLE')} as status,
       {first_of(('base > 0.5 and late < 0.3', 'DECOUPLED'), ('base < 0.3 and late > 0.5', 'COUPLED'), ('base * late < 0', 'SIGN_FLIP'), other='SHIFT')} as change_type from @pair_periods where abs(late - base) > 0.1""")
view("fifth_pairs", f"""
select a.cohort, a.fifth, a.signal_id as signal_a, b.signal_id as signal_b, {r(corr('a.value', 'b.value'), 9)} as correlation from (select cohort, signal_id, s0, value, ntile(5) {W} as fifth from @obs) a join (select cohort, signal_id, s0, value, ntile(5) {W} as fifth from @obs) b on a.cohort = b.cohort and a.s0 = b.s0 and a.fifth = b.fifth and a.signal_id < b.signal_id group by a.cohort, a.fifth, a.signal_id, b.signal_id""")
view("report_07_rolling_correlation", f"""
select cohort, signal_a, signal_b, {', '.join(f'{r(f"max(case when fifth = {k} then correlation end)", 3)} as w{k}_corr' for k in range(1, 6))}, {r('max(correlation) - min(correlation)', 3)} as corr_range, {first_of(('max(correlation) - min(correlation) > 0.3', 'UNSTABLE'), other='STABLE')} as stability from @fifth_pairs group by cohort, signal_a, signal_b having max(correlation) - min(correlation) > 0.15""")
view("report_07_decoupling_events", f"""
select cohort, signal_a, signal_b, {r('base', 3)} as baseline_corr, {r('late', 3)} as late_corr, case when abs(base) > 0.6 then 'DECOUPLED' else 'NEWLY_COUPLED' end as event_type, case when abs(base) > 0.6 then 'Strongly correlated before, uncorrelated now: check for a broken linkage' else 'Uncorrelated before, strongly correlated now: a new interaction' end as interpretation
from @pair_periods where (abs(base) > 0.6 and abs(late) < 0.3) or (abs(base) < 0.3 and abs(late) > 0.6)""")
view("report_07_network_density", f"select cohort, fifth as window_id, count(*) as n_pairs, count(*) filter (where abs(correlation) > 0.5) as n_strong, {r('1.0 * count(*) filter (where abs(correlation) > 0.5) / count(*)', 4)} as density, {r('avg(abs(correlation))', 6)} as mean_abs_corr from @fifth_pairs where correlation is not null group by cohort, fifth")

# --- 08 lead and lag ---------------------------------------------------------------------------------------------
_LAGS = (1, 2, 5, 10)
view("row_lags", f"""
select cohort, signal_a, signal_b, {r(corr('va', 'vb'), 6)} as lag_0, {', '.join(f"{r(corr('va', f'b{k}'), 6)} as back_{k}, {r(corr('va', f'f{k}'), 6)} as ahead_{k}" for k in _LAGS)}
from (select cohort, signal_a, signal_b, va, vb, {', '.join(f'lag(vb, {k}) over w as b{k}, lead(vb, {k}) over w as f{k}' for k in _LAGS)} from @pair_points window w as (partition by cohort, signal_a, signal_b order by s0)) x group by cohort, signal_a, signal_b""")
_best = f"greatest({', '.join(f'abs(back_{k}), abs(ahead_{k})' for k in _LAGS)})"
view("report_08_cross_correlation", f"""
select cohort, signal_a, signal_b, lag_0, {', '.join(f'back_{k}, ahead_{k}' for k in _LAGS)}, {r(_best, 6)} as best_abs, {first_of((f'{_best} <= abs(lag_0) + 0.05', 'CONTEMPORANEOUS'), (f"greatest({', '.join(f'abs(back_{k})' for k in _LAGS)}) >= {_best}", 'B_LEADS'), other='A_LEADS')} as lead_class from @row_lags""")
view("first_moves", """
-- the first place after the first fifth at which a signal leaves its baseline's 5th to 95th percentile
select d.cohort, d.signal_id, min(d.s0) as first_move from @signal_deviations d join @lives l on d.cohort = l.cohort and d.signal_id = l.signal_id and d.s0 = l.s0 where d.side <> 'in' and d.s0 > l.base_end group by d.cohort, d.signal_id""")
view("report_08_first_movers", f"select cohort, signal_id, first_move, first_move - min(first_move) over (partition by cohort) as delay, rank() over (partition by cohort order by first_move) as move_rank, {first_of(('first_move = min(first_move) over (partition by cohort)', 'FIRST_MOVER'), other='FOLLOWER')} as mover_class from @first_moves")
view("report_08_propagation", "select a.cohort, a.signal_id as leader, b.signal_id as follower, b.first_move - a.first_move as delay from @first_moves a join @first_moves b on a.cohort = b.cohort and a.signal_id <> b.signal_id where b.first_move > a.first_move and b.first_move <= a.first_move + 50")
view("report_08_fault_propagation", f"select cohort, leader as signal_id, count(*) as n_downstream, {r('avg(delay)', 4)} as mean_delay, min(delay) as min_delay, {first_of(('count(*) >= 3', 'ROOT_CANDIDATE'), ('count(*) >= 1', 'UPSTREAM'), other='TERMINAL')} as propagation_role from @report_08_propagation group by cohort, leader")
view("report_08_lag_stability", f"""
select cohort, signal_a, signal_b, count(*) as n_windows, {r('avg(c)', 6)} as mean_lag_corr, {r('stddev_samp(c)', 6)} as lag_corr_std, {first_of(('stddev_samp(c) < 0.1', 'STABLE'), ('stddev_samp(c) < 0.3', 'VARIABLE'), other='UNSTABLE')} as stability
from (select cohort, signal_a, signal_b, fifth, {r(corr('va', 'before'), 6)} as c from (select cohort, signal_a, signal_b, va, ntile(5) over w as fifth, lag(vb, 5) over w as before from @pair_points window w as (partition by cohort, signal_a, signal_b order by s0)) x group by cohort, signal_a, signal_b, fifth) y where c is not null group by cohort, signal_a, signal_b""")
view("report_08_executive", """
select cohort, count(*) as n_movers, min(first_move) as first_move, max(first_move) - min(first_move) as spread, max(case when k = 1 then signal_id end) as first_mover, max(case when k = 2 then signal_id end) as second_mover from (select *, row_number() over (partition by cohort order by first_move, signal_id) as k from @first_moves) x group by cohort""")

# --- 09 influence ------------------------------------------------------------------------------------------------
_b, _a, _z = "greatest(abs(back_1), abs(back_5))", "greatest(abs(ahead_1), abs(ahead_5))", "abs(lag_0)"
view("report_09_lead_lag_relationships", f"select cohort, signal_a, signal_b, lag_0, back_1, ahead_1, back_5, ahead_5, {first_of((f'{_z} > 0.7', 'SYNCHRONOUS'), (f'{_a} > {_z} + 0.1 and {_a} > {_b}', 'A_LEADS'), (f'{_b} > {_z} + 0.1 and {_b} > {_a}', 'B_LEADS'), other='UNRELATED')} as relationship from @row_lags")
view("large_steps", f"select cohort, signal_id, s0, cast(floor(s0 / 20) as bigint) as block from (select cohort, signal_id, s0, abs(d) as d, avg(abs(d)) over ({K}) as typical from (select cohort, signal_id, s0, value - lag(value) {W} as d from @obs) a) b where d > 2 * typical")
view("report_09_influence_propagation", f"""
select s.cohort, s.signal_id as source, t.signal_id as target, count(*) as n_propagations, {r('avg(t.s0 - s.s0)', 4)} as mean_delay, min(t.s0 - s.s0) as min_delay
from (select cohort, signal_id, s0, block + step as block from (select cohort, signal_id, s0, block, #each(0, 1) as step from @large_steps) m) s join @large_steps t on s.cohort = t.cohort and s.block = t.block and s.signal_id <> t.signal_id where t.s0 > s.s0 and t.s0 <= s.s0 + 20 group by s.cohort, s.signal_id, t.signal_id having count(*) >= 3""")
view("lag3", f"select p.cohort, p.signal_id as source, t.signal_id as target, {r(corr('t.value', 'p.before'), 6)} as c from (select cohort, signal_id, s0, lag(value, 3) {W} as before from @obs) p join @obs t on p.cohort = t.cohort and p.s0 = t.s0 and p.signal_id <> t.signal_id where p.before is not null group by p.cohort, p.signal_id, t.signal_id")
for _name, _side, _col in (("report_09_influence_ranking", "source", "influence"), ("report_09_responsive_signals", "target", "responsiveness")):
    view(_name, f"select cohort, {_side} as signal_id, {r('avg(abs(c))', 8)} as mean_{_col}, max(abs(c)) as max_{_col}, count(*) as n_pairs, {ladder('avg(abs(c))', '>', (0.4, 'HIGH'), (0.2, 'MODERATE'), other='LOW')} as {_col}_class, rank() over (partition by cohort order by round(avg(abs(c)), 8) desc nulls last) as {_col}_rank from @lag3 group by cohort, {_side}")
view("report_09_feedback_loops", f"select a.cohort, a.source as signal_a, a.target as signal_b, a.c as a_to_b, b.c as b_to_a, case when a.c * b.c > 0 then 'POSITIVE_FEEDBACK' else 'NEGATIVE_FEEDBACK' end as loop_type from @lag3 a join @lag3 b on a.cohort = b.cohort and a.source = b.target and a.target = b.source where a.source < a.target and abs(a.c) > 0.3 and abs(b.c) > 0.3")
view("report_09_causal_chains", "select a.cohort, a.source as first_signal, a.target as second_signal, b.target as third_signal, a.c as first_link, b.c as second_link, case when a.c * b.c > 0 then 'AMPLIFYING' else 'DAMPENING' end as chain_type from @lag3 a join @lag3 b on a.cohort = b.cohort and a.target = b.source and a.source <> b.target where abs(a.c) > 0.3 and abs(b.c) > 0.3")

# --- 10 departure ------------------------------------------------------------------------------------------------
_state = first_of((f"abs({_hr}) > 3 or {_vol} > 1.5", "DEPARTED"), (f"abs({_hr}) > 2 or {_vol} > 1.2", "SHIFTED"), other="STABLE")
view("signal_states", f"select cohort, signal_id, early_slope, late_slope, {r(_hr, 6)} as slope_ratio, {r(_vol, 6)} as vol_ratio, {_state} as status, sign(early_slope) <> sign(late_slope) as reversed from @halves")
view("report_10_system_scorecard", f"""
select cohort, n_signals, n_departed, n_shifted, n_reversed, {r('100.0 * n_departed / n_signals', 1)} as pct_departed, {first_of(('n_departed > 0.5 * n_signals', 'CRITICAL'), ('n_departed + n_shifted > 0.5 * n_signals', 'DEGRADED'), ('n_departed + n_shifted > 0', 'WATCH'), other='HEALTHY')} as system_status
from (select cohort, count(*) as n_signals, count(*) filter (where status = 'DEPARTED') as n_departed, count(*) filter (where status = 'SHIFTED') as n_shifted, count(*) filter (where reversed) as n_reversed from @signal_states group by cohort) x""")
view("report_10_departure_matrix", "select cohort, " + ", ".join(f"max(case when signal_id = '{s}' then status end) as {s}_status" for s in ("click", "error", "purchase", "signup", "view")) + ", count(*) as n_signals from @signal_states group by cohort")
view("report_10_trend_detection", f"""
select cohort, signal_id, up, down, n, {first_of(('1.0 * up / n >= 0.8', 'MONOTONIC_UP'), ('1.0 * down / n >= 0.8', 'MONOTONIC_DOWN'), ('1.0 * up / n >= 0.6', 'MOSTLY_UP'), ('1.0 * down / n >= 0.6', 'MOSTLY_DOWN'), other='NO_TREND')} as trend
from (select cohort, signal_id, count(*) filter (where step > 0) as up, count(*) filter (where step < 0) as down, count(step) as n from (select cohort, signal_id, round(m - lag(m) over ({K} order by q), 9) as step from @drift_windows) a group by cohort, signal_id having count(step) > 0) b""")
view("report_10_deviation_summary", f"select cohort, signal_id, n_exceedances, first_exceedance_t, {r('1.0 * n_exceedances / n', 6)} as exceedance_rate, {ladder('1.0 * n_exceedances / n', '>', (0.2, 'FREQUENT'), (0.05, 'OCCASIONAL'), other='RARE')} as deviation_class from (select e.cohort, e.signal_id, e.n_exceedances, e.first_exceedance_t, l.n from @report_03_exceedance_events e join @life_slopes l on e.cohort = l.cohort and e.signal_id = l.signal_id) x")
view("report_10_executive_dashboard", "select s.cohort, s.system_status, s.n_signals, s.n_departed, s.pct_departed, m.first_mover, m.spread from @report_10_system_scorecard s left join @report_08_executive m on s.cohort = m.cohort")

# --- 11 validity -------------------------------------------------------------------------------------------------
_NEEDS = (("lyapunov", 10000, 3000), ("correlation_dimension", 5000, 1000), ("rqa", 1000, 1000), ("topology", 500, 500))
view("report_11_data_sufficiency", f"""
select cohort, n_observations, n_signals, per_signal, {', '.join(f"{ladder('per_signal', '>=', (a, 'sufficient'), (b, 'marginal'), other='insufficient')} as {n}" for n, a, b in _NEEDS)}, {ladder('per_signal', '>=', (5000, 'FULL'), (1000, 'STANDARD'), (200, 'BASIC'), other='LIMITED')} as overall
from (select cohort, count(*) as n_observations, count(distinct signal_id) as n_signals, cast(floor(1.0 * count(*) / count(distinct signal_id)) as bigint) as per_signal from @obs group by cohort) x""")
_bcv, _brs = div("stddev_pop(value)", "abs(avg(value))"), div("max(value) - min(value)", "stddev_pop(value)")
view("report_11_baseline_validity", f"""
select cohort, signal_id, count(*) as baseline_n, {r(_bcv, 4)} as baseline_cv, {r(_brs, 4)} as range_over_sigma, {ladder('count(*)', '>=', (100, 'GOOD_SIZE'), (50, 'ACCEPTABLE_SIZE'), (30, 'MINIMAL_SIZE'), other='TOO_SMALL')} as size_class, {ladder(_bcv, '<', (0.2, 'STABLE'), (0.5, 'MODERATE'), other='UNSTABLE')} as stability_class, {ladder(_brs, '<', (4, 'TIGHT'), (6, 'NORMAL'), other='OUTLIERS')} as spread_class
from @lives where s0 <= base_end group by cohort, signal_id""")
_valid = "100.0 * n_valid / n_signals"
view("report_11_baseline_summary", f"select cohort, n_signals, n_valid, {r(_valid, 1)} as pct_valid, {ladder(_valid, '>=', (90, 'VALID'), (70, 'MOSTLY_VALID'), other='QUESTIONABLE')} as baseline_status from (select cohort, count(*) as n_signals, count(*) filter (where size_class <> 'TOO_SMALL' and stability_class <> 'UNSTABLE') as n_valid from @report_11_baseline_validity group by cohort) x")
view("report_11_fleet_validity", f"select n_cohorts, {ladder('n_cohorts', '>=', (30, 'ROBUST'), (10, 'ADEQUATE'), (5, 'LIMITED'), other='INSUFFICIENT')} as fleet_class from (select count(distinct cohort) as n_cohorts from @obs) x")
view("report_11_engine_thresholds", "select engine, min_observations, rationale from @config_engine_requirements")
view("report_11_minimum_data", "select * from (values ('trend', 20), ('autocorrelation', 50), ('entropy', 100), ('spectral', 128), ('hurst', 256), ('correlation_dimension', 1000), ('lyapunov', 3000)) as t(analysis, min_points)")
view("report_11_window_guidance", "select * from (values ('short memory', 64, 32), ('moderate memory', 128, 64), ('long memory', 256, 128), ('periodic', 512, 256)) as t(signal_kind, window_size, stride)")
view("report_11_effect_sizes", f"select cohort, signal_id, effect_size, {ladder('abs(effect_size)', '>=', (0.8, 'LARGE'), (0.5, 'MEDIUM'), (0.2, 'SMALL'), other='NEGLIGIBLE')} as effect_class from @drift_segments")
view("report_11_agreement", "select * from (values (1, 'WEAK', 'one pillar'), (2, 'MODERATE', 'two pillars agree'), (3, 'STRONG', 'three pillars agree'), (4, 'VERY_STRONG', 'all pillars agree')) as t(n_pillars, confidence, reading)")
view("report_11_coherence_velocity", f"select cohort, signal_0_center, coherence, coherence_velocity, {first_of(('coherence_velocity > 0.001', 'COUPLING'), ('coherence_velocity < -0.001', 'DECOUPLING'), other='STEADY')} as coherence_trend, {ladder('coherence', '>', (0.7, 'STRONG'), (0.4, 'WEAK'), other='UNCOUPLED')} as coupling_state from @physics")
view("report_11_validation_summary", """
select 'n_cohorts' as item, cast(n_cohorts as double) as value from @report_11_fleet_validity union all select 'n_cohorts_sufficient', cast(count(*) as double) from @report_11_data_sufficiency where overall <> 'LIMITED' union all select 'n_valid_baselines', cast(sum(n_valid) as double) from @report_11_baseline_summary
union all select 'n_signals', cast(count(distinct signal_id) as double) from @obs union all select 'n_observations', cast(count(*) as double) from @obs""")
view("report_11_checklist", "select * from (values (1, 'enough observations for the method'), (2, 'baseline long and stable enough'), (3, 'effect larger than the baseline spread'), (4, 'seen by more than one pillar'), (5, 'seen in more than one cohort')) as t(step, question)")
