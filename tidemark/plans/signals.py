"""Observations, calculus, statistics, dynamics and typology of single signals."""

from __future__ import annotations

from .dag import corr, div, first_of, ladder, moments, oracle, quantile, r, view

K = "partition by cohort, signal_id"
W = f"over ({K} order by s0)"

# --- observations -----------------------------------------------------------------------------------------------
view("obs", """
select concat('c', cast(user_id % 8 as #string)) as cohort, event_type as signal_id,
       cast(row_number() over (partition by user_id % 8, event_type order by ts, event_id) - 1 as double) as s0,
       case when not #isnan(value) then value end as value
from @events""")
view("obs_daily", """
select 'all' as cohort, event_type as signal_id, cast(day as double) as s0, sum(value) as value
from (select event_type, value, extract(day from ts) as day from @events) e group by event_type, day""")
view("obs_lines_wide", """
select cohort, s0, l_quantity, l_extendedprice, l_discount, l_tax from (
  select concat('s', cast(l_suppkey % 4 as #string)) as cohort, l_quantity, l_extendedprice, l_discount, l_tax,
         cast(row_number() over (partition by l_suppkey % 4 order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 as double) as s0
  from @lineitem) x""")
view("obs_lines", """
select cohort, 'quantity' as signal_id, s0, l_quantity as value from @obs_lines_wide
union all select cohort, 'price', s0, l_extendedprice from @obs_lines_wide
union all select cohort, 'discount', s0, l_discount from @obs_lines_wide
union all select cohort, 'tax', s0, l_tax from @obs_lines_wide""")
view("signals", """
select signal_id, case signal_id when 'purchase' then 'usd' when 'error' then 'count' when 'click' then 'hz' when 'view' then 's' end as unit,
       concat('events of type ', signal_id) as description, 'events' as source_name
from (select distinct event_type as signal_id from @events) t""")
view("labels", """
select o.cohort, o.s0 as signal_0_center, 'late_life' as label_name, case when o.s0 >= 0.8 * m.top then '1' else '0' end as label_value
from (select distinct cohort, s0 from @obs) o join (select cohort, max(s0) as top from @obs group by cohort) m on o.cohort = m.cohort""")
view("v_base", """
select o.cohort, o.signal_id, o.s0, o.value, s.unit as value_unit, cast(null as #string) as index_dimension, cast(null as #string) as signal_class from @obs o left join @signals s on o.signal_id = s.signal_id""")
view("observations", """
-- defaults for what is missing; a row without a signal gets one of its own, and only such rows are numbered, by cohort
select coalesce(cohort, 'default') as cohort, signal_id, s0, value, coalesce(value_unit, 'unknown') as unit from @raw_upload where signal_id is not null
union all select coalesce(cohort, 'default') as cohort, 'signal_' || cast(row_number() over (partition by cohort order by s0, value) as #string) as signal_id, s0, value, coalesce(value_unit, 'unknown') as unit from @raw_upload where signal_id is null""")
view("raw_upload", "select cohort, signal_id, s0, value, value_unit from @v_base")
view("v_schema_validation", """
select count(*) as n_rows, count(distinct cohort) as n_cohorts, count(distinct signal_id) as n_signals, min(s0) as s0_min, max(s0) as s0_max,
       count(*) - count(value) as n_null, case when count(*) = 0 then 'empty' when count(value) = 0 then 'no_values' else 'valid' end as status
from @obs""")
view("v_observations_summary", """
select count(distinct cohort) as n_entities, count(distinct signal_id) as n_signals, count(*) as n_rows, min(s0) as i_min, max(s0) as i_max, count(distinct unit) as n_measurement_units from @observations""")
view("v_signal_inventory", f"""
select cohort, signal_id, value_unit, count(*) as n_points, min(value) as value_min, max(value) as value_max, {r('avg(value)')} as value_avg
from @v_base group by cohort, signal_id, value_unit""")
view("v_data_quality", """
select cohort, signal_id, count(*) < 50 as insufficient, coalesce(min(value) = max(value), true) as is_constant, count(*) > count(value) as has_nulls
from @obs group by cohort, signal_id""")
view("reaxis", """
-- any signal may serve as the axis: its values order the others, equal ones keep the old order
select a.cohort, o.signal_id, a.value + (row_number() over (partition by a.cohort, o.signal_id, a.value order by a.s0) - 1) * 1e-9 as axis, o.value
from @obs a join @obs o on a.cohort = o.cohort and a.s0 = o.s0 where a.signal_id = 'click' and o.signal_id <> 'click'""")

# --- calculus: one window pass for all derivatives ---------------------------------------------------------------
view("calc_raw", f"""
select cohort, signal_id, s0, value, (nxt - prv) / 2 as d1, nxt - 2 * value + prv as d2
from (select cohort, signal_id, s0, value, lag(value) {W} as prv, lead(value) {W} as nxt from @obs) x""")
view("calc", f"""
select cohort, signal_id, s0, value, d1, d2, (lead(d2) {W} - lag(d2) {W}) / 2 as d3, abs(d2) / pow(1 + d1 * d1 + 1e-10, 1.5) as kappa from @calc_raw""")
_at = "cohort, signal_id, s0"
_rough, _smooth = "case when abs(d1) > 1e-10 then abs(d2) / abs(d1) end", "case when abs(d1) > 1e-10 then abs(d1) / (abs(d2) + 1e-10) end"
_diverge = first_of(("d2 > 0.1", "expanding"), ("d2 < -0.1", "contracting"), other="stable")
_arc = f"sum(sqrt(1 + coalesce(d1 * d1, 0))) over ({K} order by s0 rows between unbounded preceding and current row)"
view("v_dvalue", f"select {_at}, value, {r('d1')} as dvalue from @calc")
view("v_d2value", f"select {_at}, value, {r('d1')} as dvalue, {r('d2')} as d2value from @calc")
view("v_d3value", f"select {_at}, value, {r('d1')} as dvalue, {r('d2')} as d2value, {r('d3')} as d3value from @calc")
view("v_curvature", f"select {_at}, value, {r('d1')} as dvalue, {r('d2')} as d2value, {r('kappa')} as kappa from @calc where d2 is not null")
view("v_laplacian", f"select {_at}, value, {r('d2')} as laplacian from @calc")
view("v_gradient", f"select {_at}, value, {r('d1')} as dvalue, {r('abs(d1)')} as gradient_magnitude from @calc")
view("v_arc_length", f"select {_at}, value, {r('d1')} as dvalue, {r('sqrt(1 + d1 * d1)')} as segment_length, {r(_arc, 4)} as arc_length_cumulative from @calc")
view("v_velocity", f"select {_at}, value, {r('d1')} as velocity, {r('abs(d1)')} as speed, {r('d2')} as acceleration, {r('abs(d2)')} as acceleration_magnitude from @calc")
view("v_divergence", f"select {_at}, {r('d2')} as divergence, {_diverge} as divergence_state from @calc")
view("v_smoothness", f"select {_at}, {r('d1')} as dvalue, {r('d2')} as d2value, {r(_rough, 4)} as roughness_index, {r(_smooth, 4)} as smoothness_index from @calc")
view("v_calculus_complete", f"""
-- all of the above from one pass over the derivatives; the first and last place, which have none, are left out at the end
select * from (select {_at}, value, {r('d1')} as dvalue, {r('d2')} as d2value, {r('d3')} as d3value, {r('kappa')} as kappa, {r('d2')} as laplacian, {r('abs(d1)')} as gradient_magnitude, {r(_arc, 4)} as arc_length_cumulative,
       {r(_rough, 4)} as roughness_index, {r(_smooth, 4)} as smoothness_index, {r('d2')} as divergence, {_diverge} as divergence_state from @calc) x where d2value is not null""")
oracle("v_calculus_complete", """
select c.cohort, c.signal_id, c.s0, c.value, c.dvalue, c.d2value, d.d3value, c.kappa, l.laplacian, abs(c.dvalue) as gradient_magnitude, a.arc_length_cumulative, s.roughness_index, s.smoothness_index, v.divergence, v.divergence_state
from @v_curvature c left join @v_d3value d using (cohort, signal_id, s0) left join @v_laplacian l using (cohort, signal_id, s0) left join @v_arc_length a using (cohort, signal_id, s0)
left join @v_smoothness s using (cohort, signal_id, s0) left join @v_divergence v using (cohort, signal_id, s0)""")

# --- statistics --------------------------------------------------------------------------------------------------
view("v_stats_global", f"""
select cohort, signal_id, count(*) as n_points, min(value) as value_min, max(value) as value_max, {r('max(value) - min(value)')} as value_range, {r('avg(value)')} as value_mean, {r('stddev_samp(value)')} as value_std, {r('var_samp(value)')} as value_var,
       {r(quantile(0.25, 'value'))} as value_q1, {r(quantile(0.5, 'value'))} as value_median, {r(quantile(0.75, 'value'))} as value_q3, {r(quantile(0.75, 'value') + ' - ' + quantile(0.25, 'value'))} as value_iqr
from @obs group by cohort, signal_id""")
view("v_statistics", f"""
select cohort, signal_id, count(*) as n_points, {r('avg(value)')} as mean, {r('stddev_samp(value)')} as std, min(value) as value_min, max(value) as value_max, {r('max(value) - min(value)')} as value_range, {r(quantile(0.5, 'value'))} as median, {r(quantile(0.25, 'value'))} as q1,
       {r(quantile(0.75, 'value'))} as q3, {r(quantile(0.75, 'value') + ' - ' + quantile(0.25, 'value'))} as iqr, {r('var_samp(value)')} as variance, {r(div('stddev_samp(value)', 'abs(avg(value))'))} as cv from @observations group by cohort, signal_id""")
view("v_derivative_stats", f"""
select cohort, signal_id, {', '.join(f"{r(f'avg(abs({d}))')} as {n}_mean_abs, {r(f'stddev_samp({d})')} as {n}_std, {r(quantile(0.5, f'abs({d})'))} as {n}_median_abs, {r(quantile(0.95, f'abs({d})'))} as {n}_p95_abs" for d, n in (('d1', 'dvalue'), ('d2', 'd2value')))}
from @calc where d2 is not null group by cohort, signal_id""")
view("v_trajectory_deviation", f"""
select cohort, signal_id, s0, value, {r('p')} as value_percentile, {first_of(('p > 0.99 or p < 0.01', 'extreme'), ('p > 0.95 or p < 0.05', 'outlier'), other='normal')} as deviation_category
from (select cohort, signal_id, s0, value, percent_rank() over ({K} order by value nulls last) as p from @obs) x""")
view("v_derivative_anomaly", f"""
select c.cohort, c.signal_id, c.s0, {r('d1')} as dvalue, {r('d2')} as d2value, dvalue_median_abs, d2value_median_abs, abs(d1) > 3 * dvalue_median_abs as dvalue_anomaly, abs(d2) > 3 * d2value_median_abs as d2value_anomaly,
       {r(div('abs(d1)', 'dvalue_median_abs') + ' + ' + div('abs(d2)', 'd2value_median_abs'))} as anomaly_score
from @calc c join @v_derivative_stats s on c.cohort = s.cohort and c.signal_id = s.signal_id where d2 is not null""")
view("v_local_extrema", f"""
select cohort, signal_id, s0, value, {r('d1')} as dvalue, {r('before')} as dvalue_prev, case when d1 > 0 and before < 0 then 'valley' when d1 < 0 and before > 0 then 'peak' end as extrema_type
from (select cohort, signal_id, s0, value, d1, lag(d1) {W} as before from @calc where d1 is not null) x""")
view("v_trend", f"select {_at}, value, {r('d1')} as dvalue, {first_of(('d1 > 0.001', 'up'), ('d1 < -0.001', 'down'), other='flat')} as trend_direction, {r('case when abs(d1) > 0 then abs(d2) / abs(d1) end', 4)} as trend_acceleration from @calc")
view("v_volatility_proxy", f"""
select c.cohort, c.signal_id, c.s0, c.value, {r('d2')} as d2value, {r('kappa')} as kappa, {r('abs(d2)')} as instantaneous_volatility, {r('kappa')} as curvature_volatility, {r(div('abs(d2)', 'd2value_median_abs'))} as relative_volatility
from @calc c join @v_derivative_stats s on c.cohort = s.cohort and c.signal_id = s.signal_id where d2 is not null""")
view("v_autocorrelation", f"""
select cohort, signal_id, {r(corr('value', 'l1'))} as acf_lag1, {r(corr('value', 'l5'))} as acf_lag5, {r(corr('value', 'l10'))} as acf_lag10
from (select cohort, signal_id, value, lag(value, 1) {W} as l1, lag(value, 5) {W} as l5, lag(value, 10) {W} as l10 from @obs) x where l10 is not null group by cohort, signal_id""")
view("v_statistics_complete", """
select g.cohort, g.signal_id, g.n_points, g.value_mean, g.value_std, g.value_median, g.value_iqr, d.dvalue_median_abs, d.d2value_median_abs, a.acf_lag1, a.acf_lag5, a.acf_lag10
from @v_stats_global g left join @v_derivative_stats d on g.cohort = d.cohort and g.signal_id = d.signal_id left join @v_autocorrelation a on g.cohort = a.cohort and g.signal_id = a.signal_id""")
_skew, _kurt = moments("x")
view("signal_statistics", f"""
select cohort, signal_id, count(x) as n, {r('max(mean)')} as mean, {r('stddev_samp(x)')} as std, {r(_skew)} as skewness, {r(_kurt)} as kurtosis, min(value) as value_min, max(value) as value_max,
       {r(quantile(0.25, 'value'))} as q1, {r(quantile(0.5, 'value'))} as median, {r(quantile(0.75, 'value'))} as q3, {r(div('stddev_samp(x)', 'abs(max(mean))'))} as cv,
       count(distinct round(value, 8)) as n_unique,
       case when count(distinct round(value, 8)) <= 1 then 'constant' when count(distinct round(value, 8)) < 0.05 * count(x) then 'discrete' else 'continuous' end as continuity
from (select cohort, signal_id, value, value - avg(value) over ({K}) as x, avg(value) over ({K}) as mean from @obs where value is not null) c group by cohort, signal_id""")

# --- dynamics ----------------------------------------------------------------------------------------------------
view("v_regime_changes", f"""
select x.cohort, x.signal_id, x.s0, {r('d1')} as dvalue, {r('d2')} as d2value, {r('p1')} as dvalue_prev, {r('p2')} as d2value_prev, {r('abs(d1 - p1)')} as dvalue_jump, {r('abs(d2 - p2)')} as d2value_jump,
       {r(div('abs(d1 - p1)', 'dvalue_median_abs') + ' + ' + div('abs(d2 - p2)', 'd2value_median_abs'))} as change_score, coalesce(abs(d1 - p1) > 3 * dvalue_median_abs or abs(d2 - p2) > 3 * d2value_median_abs, false) as is_regime_change
from (select cohort, signal_id, s0, d1, d2, lag(d1) {W} as p1, lag(d2) {W} as p2 from @calc where d2 is not null) x join @v_derivative_stats s on x.cohort = s.cohort and x.signal_id = s.signal_id""")
view("v_regime_boundaries", f"select cohort, signal_id, s0 as regime_boundary, change_score, row_number() {W} as regime_number from @v_regime_changes where is_regime_change")
view("v_regime_assignment", f"""
-- the latest boundary at or before a place is a running count of boundaries
select b.cohort, b.signal_id, b.s0, cast(sum(case when c.is_regime_change then 1 else 0 end) over (partition by b.cohort, b.signal_id order by b.s0 rows between unbounded preceding and current row) as bigint) as regime_id
from @obs b left join @v_regime_changes c on b.cohort = c.cohort and b.signal_id = c.signal_id and b.s0 = c.s0""")
oracle("v_regime_assignment", """
select b.cohort, b.signal_id, b.s0, coalesce(r.regime_number, 0) as regime_id from @obs b asof left join @v_regime_boundaries r on b.cohort = r.cohort and b.signal_id = r.signal_id and b.s0 >= r.regime_boundary""")
view("v_regime_stats", f"""
select a.cohort, a.signal_id, a.regime_id, count(*) as regime_length, min(a.s0) as regime_start, max(a.s0) as regime_end, {r('avg(c.value)')} as regime_mean, {r('stddev_samp(c.value)')} as regime_std, min(c.value) as regime_min, max(c.value) as regime_max,
       {r('avg(c.d1)')} as regime_avg_velocity, {r('avg(c.kappa)')} as regime_avg_curvature
from @v_regime_assignment a join @calc c on a.cohort = c.cohort and a.signal_id = c.signal_id and a.s0 = c.s0 group by a.cohort, a.signal_id, a.regime_id""")
_nxt = lambda c: f"lead({c}) over ({K} order by regime_start)"
view("v_regime_transitions", f"""
select cohort, signal_id, regime_id as from_regime, to_regime, regime_end as transition_point, regime_mean, {r('next_mean - regime_mean')} as mean_jump, {r(div('next_std', 'regime_std'))} as volatility_ratio,
       {first_of(('next_std > regime_std * 1.5', 'volatility_increase'), ('next_std < regime_std * 0.67', 'volatility_decrease'), ('next_mean > regime_mean + regime_std', 'upward_shift'), ('next_mean < regime_mean - regime_std', 'downward_shift'), other='lateral')} as transition_type
from (select cohort, signal_id, regime_id, regime_end, regime_mean, regime_std, {_nxt('regime_id')} as to_regime, {_nxt('regime_mean')} as next_mean, {_nxt('regime_std')} as next_std from @v_regime_stats) x""")
view("v_stability", f"""
select {_at}, {r('d1')} as dvalue, {r('d2')} as d2value, {r('abs(d1)')} as local_expansion_rate, {first_of(('d1 > 0 and d2 < 0', 'converging_up'), ('d1 < 0 and d2 > 0', 'converging_down'), ('d1 > 0 and d2 > 0', 'diverging_up'), ('d1 < 0 and d2 < 0', 'diverging_down'), other='neutral')} as stability_state,
       d1 * d2 < 0 as is_locally_stable from @calc where d2 is not null""")
view("v_basins", """
-- points less than 50 places from a valley: blocks of 50 turn the band into an equality on neighbouring blocks
select n.cohort, n.signal_id, n.s0 as basin_center, n.value as basin_depth, o.s0, o.value, abs(o.s0 - n.s0) as distance_to_center
from (select cohort, signal_id, s0, value, home + step as block from (select cohort, signal_id, s0, value, cast(floor(s0 / 50) as bigint) as home, #each(-1, 0, 1) as step from @v_local_extrema where extrema_type = 'valley') v) n
join (select cohort, signal_id, s0, value, cast(floor(s0 / 50) as bigint) as block from @obs) o on n.cohort = o.cohort and n.signal_id = o.signal_id and n.block = o.block where abs(o.s0 - n.s0) < 50""")
oracle("v_basins", """
select e.cohort, e.signal_id, e.s0 as basin_center, e.value as basin_depth, b.s0, b.value, abs(b.s0 - e.s0) as distance_to_center
from @v_local_extrema e join @obs b on e.cohort = b.cohort and e.signal_id = b.signal_id and b.s0 > e.s0 - 50 and b.s0 < e.s0 + 50 where e.extrema_type = 'valley'""")
view("v_attractors_all", f"""
select cohort, signal_id, attractor_value, bin_center, visit_count, {r('1.0 * visit_count / sum(visit_count) over (' + K + ')')} as visit_frequency, row_number() over ({K} order by visit_count desc, attractor_value nulls last) as rank_by_visits
from (select cohort, signal_id, round(value, 1) as attractor_value, {r('avg(value)')} as bin_center, count(*) as visit_count from @obs group by cohort, signal_id, round(value, 1)) x""")
view("v_attractors", f"select cohort, signal_id, attractor_value, bin_center, visit_count, visit_frequency, {ladder('rank_by_visits', '<=', (1, 'primary'), (3, 'secondary'), other='minor')} as attractor_type from @v_attractors_all where visit_frequency > 0.05")
view("v_phase_velocity", f"select {_at}, {r('sqrt(1 + d1 * d1)')} as phase_velocity, {r('sqrt(d1 * d1 + d2 * d2)')} as tangent_magnitude from @calc where d2 is not null")
view("v_bifurcation_base", f"""
select cohort, signal_id, s0 as bifurcation_point, {r('kappa')} as kappa, {r('before')} as kappa_prev, {r('abs(kappa - before)')} as kappa_jump, case when kappa > 2 * before then 'complexity_increase' when kappa < 0.5 * before then 'complexity_decrease' end as bifurcation_type
from (select cohort, signal_id, s0, kappa, lag(kappa) {W} as before from @calc where kappa is not null) x""")
view("v_kappa_thresholds", f"select cohort, signal_id, {r(quantile(0.95, 'abs(kappa)'))} as kappa_p95 from @calc where kappa is not null group by cohort, signal_id")
view("v_bifurcation_candidates", """
select b.* from @v_bifurcation_base b join @v_kappa_thresholds t on b.cohort = t.cohort and b.signal_id = t.signal_id where b.kappa_prev is not null and b.kappa_jump > t.kappa_p95""")
view("v_dynamics_complete", """
select a.cohort, a.signal_id, a.s0, a.regime_id, g.regime_mean, g.regime_std, g.regime_length, s.stability_state, s.is_locally_stable, v.phase_velocity
from @v_regime_assignment a left join @v_regime_stats g on a.cohort = g.cohort and a.signal_id = g.signal_id and a.regime_id = g.regime_id left join @v_stability s on a.cohort = s.cohort and a.signal_id = s.signal_id and a.s0 = s.s0
left join @v_phase_velocity v on a.cohort = v.cohort and a.signal_id = v.signal_id and a.s0 = v.s0""")
view("v_system_regime", f"""
select c.cohort, c.s0 as system_regime_boundary, count(distinct c.signal_id) as n_signals_changing, {first_of(('count(distinct c.signal_id) > 0.5 * max(n.n_signals)', 'major_system_change'), ('count(distinct c.signal_id) > 2', 'moderate_system_change'), other='isolated_change')} as change_magnitude
from @v_regime_changes c join (select cohort, count(distinct signal_id) as n_signals from @obs group by cohort) n on c.cohort = n.cohort where c.is_regime_change group by c.cohort, c.s0 having count(distinct c.signal_id) > 1""")

# --- typology ----------------------------------------------------------------------------------------------------
view("v_trend_detection", f"""
select cohort, signal_id, {r('up')} as frac_positive_dvalue, {r('down')} as frac_negative_dvalue, {r('direction')} as trend_direction, {r(div('m', 's'))} as trend_strength, {r('abs(up - 0.5) * 2')} as monotonicity
from (select cohort, signal_id, avg(case when d1 > 0 then 1.0 else 0.0 end) as up, avg(case when d1 < 0 then 1.0 else 0.0 end) as down, avg(sign(d1)) as direction, avg(d1) as m, stddev_samp(d1) as s from @calc where d1 is not null group by cohort, signal_id) x""")
view("v_mean_reversion", f"""
select cohort, signal_id, n_mean_crossings, n_points, {r('1.0 * n_mean_crossings / n_points')} as crossing_rate, 1.0 * n_mean_crossings / n_points > 0.1 as is_mean_reverting
from (select cohort, signal_id, count(*) filter (where side <> before) as n_mean_crossings, count(*) as n_points from (select cohort, signal_id, side, lag(side) {W} as before from (select cohort, signal_id, s0, sign(round(value - avg(value) over ({K}), 6)) as side from @obs) c) y group by cohort, signal_id) z""")
view("v_stationarity", f"""
select cohort, signal_id, {r('m1')} as mean_q1, {r('m4')} as mean_q4, {r('s1')} as std_q1, {r('s4')} as std_q4, {r('mean_drift')} as mean_drift, {r('volatility_drift')} as volatility_drift, coalesce(mean_drift < 1.0 and volatility_drift < 0.5, false) as is_stationary
from (select cohort, signal_id, m1, m4, s1, s4, {div('abs(m4 - m1)', 'm_dev')} as mean_drift, {div('abs(s4 - s1)', 's_mean')} as volatility_drift
      from (select cohort, signal_id, max(m) filter (where q = 1) as m1, max(m) filter (where q = 4) as m4, max(s) filter (where q = 1) as s1, max(s) filter (where q = 4) as s4, stddev_samp(m) as m_dev, avg(s) as s_mean
            from (select cohort, signal_id, q, avg(value) as m, stddev_samp(value) as s from (select cohort, signal_id, value, ntile(4) {W} as q from @obs) a group by cohort, signal_id, q) b group by cohort, signal_id) c) d""")
view("v_volatility_clustering", f"""
select cohort, signal_id, {r(corr('a', 'b'))} as volatility_autocorr, coalesce({corr('a', 'b')} > 0.3, false) as has_volatility_clustering
from (select c.cohort, c.signal_id, abs(c.d1) as a, abs(p.d1) as b from @calc c join @calc p on c.cohort = p.cohort and c.signal_id = p.signal_id and c.s0 = p.s0 + 1 where c.d1 is not null and p.d1 is not null) x group by cohort, signal_id""")
view("v_burst_detection", f"""
select cohort, signal_id, s0, {r('rolling_std')} as rolling_std, {r('p')} as volatility_pctile, {first_of(('p > 0.95', 'burst'), ('p < 0.10', 'calm'), other='normal')} as volatility_state
from (select cohort, signal_id, s0, rolling_std, percent_rank() over ({K} order by round(rolling_std, 6) nulls last) as p
      from (select cohort, signal_id, s0, stddev_samp(value) over ({K} order by s0 rows between 25 preceding and current row) as rolling_std from @obs) x) y""")
view("v_autocorr_lag1", f"""
select a.cohort, a.signal_id, {r(corr('a.value', 'b.value'))} as autocorr_lag1 from @obs a join @obs b on a.cohort = b.cohort and a.signal_id = b.signal_id and a.s0 = b.s0 + 1 group by a.cohort, a.signal_id""")
view("v_persistence", f"select cohort, signal_id, autocorr_lag1, {first_of(('autocorr_lag1 > 0.5', 'trending'), ('autocorr_lag1 < -0.2', 'mean_reverting'), other='random')} as persistence_class, 'autocorr_proxy' as persistence_source from @v_autocorr_lag1")
_high, _low, _wild, _quiet = "m > gm + gs", "m < gm - gs", "s > gs * 1.5", "s < gs * 0.5"
view("v_regime_state", f"""
select cohort, signal_id, s0, {first_of((_high, 'elevated'), (_low, 'depressed'), other='normal')} as mean_state, {first_of((_wild, 'high_volatility'), (_quiet, 'low_volatility'), other='normal_volatility')} as volatility_state,
       {first_of((f'{_high} and {_wild}', 'crisis'), (_high, 'elevated_stable'), (_wild, 'volatile'), (_low, 'depressed'), other='stable')} as regime_state
from (select cohort, signal_id, s0, avg(value) over ({K} order by s0 rows between 50 preceding and current row) as m, stddev_samp(value) over ({K} order by s0 rows between 50 preceding and current row) as s,
             avg(value) over ({K}) as gm, stddev_samp(value) over ({K}) as gs from @obs) x""")
view("v_chaos_proxy", f"""
select cohort, signal_id, {r('ratio', 2)} as sensitivity_ratio, {r('spread')} as curvature_variability, coalesce(ratio > 2 and spread > 1.5, false) as chaos_suspected
from (select cohort, signal_id, avg({div('abs(d2)', 'abs(d1)')}) as ratio, {div('stddev_samp(kappa)', 'avg(kappa)')} as spread from @calc where d2 is not null group by cohort, signal_id) x""")

# --- classes of signals --------------------------------------------------------------------------------------------
#: Units by class, and those that must not be interpolated.
UNITS = {
    "analog": "PSI kPa bar Pa atm °C K °F C F V mV kV A mA μA m cm mm km ft in m/s km/h mph ft/s m/s² g kg lb oz N kN lbf W kW MW hp J kJ MJ cal BTU Hz kHz MHz GHz rad deg ° m³/s L/min gpm cfm kg/m³ g/cm³ lb/ft³ Pa·s cP cSt % ppm ppb pH dB dBA lux lm cd Ω kΩ MΩ μF nF pF H mH μH T G mT J/K kJ/K mm/s in/s ips",
    "digital": "state mode status bool boolean binary enum category class level grade rank",
    "event": "count events occurrences alarms alerts triggers clicks actions transactions",
}
NOT_INTERPOLATED = "state mode status bool boolean binary enum category class count events occurrences alarms alerts triggers"
_in = lambda names: ", ".join(f"'{u}'" for u in names.split())
view("v_class_from_units", f"""
select cohort, signal_id, value_unit, case {' '.join(f"when value_unit in ({_in(u)}) then '{c}'" for c, u in UNITS.items())} else 'unknown' end as unit_class, not coalesce(value_unit in ({_in(NOT_INTERPOLATED)}), false) as interpolation_valid_from_unit
from (select distinct cohort, signal_id, value_unit from @v_base) x""")
view("v_class_continuity", f"""
select cohort, signal_id, {r('1.0 * count(distinct round(value, 4)) / count(*)')} as unique_ratio, bool_and(value = round(value, 0)) as is_all_integer, count(distinct round(value, 2)) as n_distinct_values, {r('max(value) - min(value)')} as value_range,
       {r(div('count(distinct round(value, 2))', 'max(value) - min(value)'))} as values_per_range from @obs group by cohort, signal_id""")
view("v_class_smoothness", f"""
select cohort, signal_id, {r('avg(abs(d1))')} as mean_abs_dvalue, {r('stddev_samp(d1)')} as std_dvalue, {r('avg(kappa)')} as mean_kappa, {r('stddev_samp(kappa)')} as std_kappa, {r(div('stddev_samp(d1)', 'avg(abs(d1))'))} as roughness, {r('1 - ' + div('stddev_samp(kappa)', 'avg(kappa) + 0.001'))} as kappa_consistency
from @calc where d2 is not null group by cohort, signal_id""")
view("v_class_periodicity", f"""
-- distances between the places where the second difference changes its sign
select cohort, signal_id, n_half_periods, {r('mean_half * 2')} as estimated_period, {r('spread')} as period_variability, coalesce(spread < 0.2 and n_half_periods > 5, false) as is_periodic
from (select cohort, signal_id, count(half) as n_half_periods, avg(half) as mean_half, {div('stddev_samp(half)', 'avg(half)')} as spread
      from (select cohort, signal_id, s0 - lag(s0) {W} as half from (select cohort, signal_id, s0, sign(d2) as side, lag(sign(d2)) {W} as before from @calc where d2 is not null) a where side <> before) b where half is not null group by cohort, signal_id) c""")
oracle("v_class_periodicity", f"""
select cohort, signal_id, count(*) as n_half_periods, {r('avg(half) * 2')} as estimated_period, {r('stddev(half) / nullif(avg(half), 0)')} as period_variability, coalesce(stddev(half) / nullif(avg(half), 0) < 0.2 and count(*) > 5, false) as is_periodic
from (select a.cohort, a.signal_id, b.s0 - a.s0 as half from @sign_changes a join @sign_changes b on a.cohort = b.cohort and a.signal_id = b.signal_id and b.k = a.k + 1) x group by cohort, signal_id""")
oracle("sign_changes", f"""
select cohort, signal_id, s0, row_number() {W} as k from (select cohort, signal_id, s0, sign(d2) <> sign(lag(d2) {W}) as changes from @calc where d2 is not null) x where changes""")
view("sign_changes", f"select cohort, signal_id, s0, row_number() {W} as k from (select cohort, signal_id, s0, sign(d2) as side, lag(sign(d2)) {W} as before from @calc where d2 is not null) x where side <> before")
view("v_class_sparsity", f"""
select cohort, signal_id, n_total, n_zeros, n_total - n_zeros as n_nonzero, {r('1.0 * n_zeros / n_total')} as sparsity, 1.0 * n_zeros / n_total > 0.9 as is_sparse_event from (select cohort, signal_id, count(*) as n_total, count(*) filter (where value = 0 or value is null) as n_zeros from @obs group by cohort, signal_id) x""")
_digital = "c.is_all_integer and c.unique_ratio < 0.05"
_same = lambda t, *others: " ".join(f"left join @{v} {a} on {t}.cohort = {a}.cohort and {t}.signal_id = {a}.signal_id" for v, a in others)
view("v_signal_class", f"""
select u.cohort, u.signal_id, u.value_unit, case when u.unit_class <> 'unknown' then u.unit_class when sp.is_sparse_event then 'event' when p.is_periodic then 'periodic' when {_digital} or (c.n_distinct_values < 10 and c.is_all_integer) then 'digital' else 'analog' end as signal_class,
       {first_of(("u.unit_class <> 'unknown'", 'unit'), ('sp.is_sparse_event', 'sparsity'), ('p.is_periodic', 'periodicity'), (f'{_digital} or (c.n_distinct_values < 10 and c.is_all_integer)', 'continuity'), other='default')} as class_source,
       not coalesce(u.unit_class in ('digital', 'event') or sp.is_sparse_event or ({_digital}), false) as interpolation_valid, coalesce(p.is_periodic, false) as is_periodic, p.estimated_period,
       case when u.unit_class in ('analog', 'periodic') or p.is_periodic then 3 when c.is_all_integer then 0 else 2 end as max_derivative_order, c.unique_ratio, c.is_all_integer, c.n_distinct_values, sp.sparsity, sm.kappa_consistency, p.period_variability
from @v_class_from_units u {_same('u', ('v_class_continuity', 'c'), ('v_class_periodicity', 'p'), ('v_class_sparsity', 'sp'), ('v_class_smoothness', 'sm'))}""")
#: What derivatives along an axis mean, and how signals relate along it.
AXES = {"time": ("velocity/acceleration", "causal"), "space": ("gradient/laplacian", "coupling"), "frequency": ("spectral_slope", "harmonic"), "scale": ("scale_derivative", "hierarchical")}
view("v_index_properties", f"""
select cohort, signal_id, index_dimension, case index_dimension {' '.join(f"when '{k}' then '{v[0]}'" for k, v in AXES.items())} else 'unknown' end as derivative_meaning, case index_dimension {' '.join(f"when '{k}' then '{v[1]}'" for k, v in AXES.items())} else 'correlation' end as relationship_type,
       coalesce(index_dimension = 'time', false) as causality_directional from (select distinct cohort, signal_id, index_dimension from @v_base) x""")
view("v_classification_complete", f"""
select c.cohort, c.signal_id, c.value_unit, c.signal_class, c.class_source, c.interpolation_valid, c.is_periodic, c.estimated_period, c.max_derivative_order, i.index_dimension, i.derivative_meaning, i.relationship_type, i.causality_directional, c.unique_ratio, c.sparsity, c.kappa_consistency
from @v_signal_class c {_same('c', ('v_index_properties', 'i'))}""")
view("v_signal_typology", f"""
select k.cohort, k.signal_id, k.signal_class, {first_of(('k.is_periodic', 'periodic'), ("k.signal_class = 'digital'", 'discrete'), ("k.signal_class = 'event'", 'event'), ('c.chaos_suspected', 'chaotic'), ("p.persistence_class = 'trending' and t.monotonicity > 0.6", 'trending_strong'), ("p.persistence_class = 'trending'", 'trending_weak'),
       ("p.persistence_class = 'mean_reverting' and m.is_mean_reverting", 'mean_reverting'), ("p.persistence_class = 'random'", 'random_walk'), ('s.is_stationary', 'stationary'), other='unclassified')} as behavioral_type,
       k.is_periodic, k.estimated_period, t.trend_direction, t.trend_strength, t.monotonicity, m.crossing_rate as mean_crossing_rate, s.is_stationary, s.mean_drift, s.volatility_drift, v.has_volatility_clustering, p.persistence_class, p.persistence_source, c.chaos_suspected, cast(null as double) as hurst, cast(null as double) as lyapunov
from @v_signal_class k {_same('k', ('v_trend_detection', 't'), ('v_mean_reversion', 'm'), ('v_stationarity', 's'), ('v_volatility_clustering', 'v'), ('v_persistence', 'p'), ('v_chaos_proxy', 'c'))}""")
view("v_manifold_requests", f"""
select k.cohort, k.signal_id, k.signal_class, k.signal_class = 'analog' and not k.is_periodic as needs_hurst, coalesce(c.chaos_suspected, false) as needs_lyapunov, k.signal_class = 'periodic' or k.is_periodic as needs_fft, coalesce(v.has_volatility_clustering, false) as needs_garch,
       k.signal_class in ('analog', 'periodic') and not coalesce(s.is_stationary, true) as needs_wavelet, coalesce(c.chaos_suspected and g.n_points > 500, false) as needs_rqa, k.signal_class = 'analog' and not k.is_periodic as needs_sample_entropy
from @v_signal_class k {_same('k', ('v_chaos_proxy', 'c'), ('v_volatility_clustering', 'v'), ('v_stationarity', 's'), ('v_stats_global', 'g'))}""")
_needs = "needs_hurst needs_lyapunov needs_fft needs_garch needs_wavelet needs_rqa needs_sample_entropy".split()
view("v_typology_complete", f"""
select t.cohort, t.signal_id, t.signal_class, t.behavioral_type, t.is_periodic, t.estimated_period, t.trend_direction, t.trend_strength, t.monotonicity, t.mean_crossing_rate, t.is_stationary, t.has_volatility_clustering, t.persistence_class, t.chaos_suspected, t.hurst, t.lyapunov, {', '.join('q.' + n for n in _needs)}
from @v_signal_typology t {_same('t', ('v_manifold_requests', 'q'))}""")

# --- temporal shape ----------------------------------------------------------------------------------------------
view("signal_trend", f"""
select cohort, signal_id, {r('regr_slope(value, s0)', 8)} as slope, {r('regr_r2(value, s0)')} as r2, {r('regr_intercept(value, s0)')} as intercept,
       case when regr_r2(value, s0) > 0.7 then 'strong' when regr_r2(value, s0) > 0.3 then 'moderate' else 'weak' end as strength from @obs group by cohort, signal_id""")
view("signal_monotonicity", f"""
select cohort, signal_id, count(*) filter (where d > 0) as n_up, count(*) filter (where d < 0) as n_down, count(*) filter (where d * before < 0) as n_reversals,
       case when count(*) filter (where d > 0) > 0.9 * count(d) then 'increasing' when count(*) filter (where d < 0) > 0.9 * count(d) then 'decreasing' else 'mixed' end as direction
from (select cohort, signal_id, d, lag(d) {W} as before from (select cohort, signal_id, s0, value - lag(value) {W} as d from @obs) x) y group by cohort, signal_id""")
view("signal_zero_crossings", f"""
select cohort, signal_id, count(*) filter (where x * before < 0) as n_crossings, {r('1.0 * count(*) filter (where x * before < 0) / nullif(count(*) - 1, 0)')} as crossing_rate
from (select cohort, signal_id, x, lag(x) {W} as before from (select cohort, signal_id, s0, value - avg(value) over ({K}) as x from @obs where value is not null) c) y group by cohort, signal_id""")
view("signal_acf1", f"""
select cohort, signal_id, {r(corr('value', 'l1'))} as acf1, case when {corr('value', 'l1')} > 0.95 then 'long' when {corr('value', 'l1')} > 0.5 then 'short' else 'none' end as memory
from (select cohort, signal_id, value, lag(value) {W} as l1 from @obs) x where l1 is not null group by cohort, signal_id""")
view("signal_rolling_stability", f"""
select cohort, signal_id, {r(div('max(s)', 'min(s)'))} as std_ratio, {r('max(m) - min(m)')} as mean_drift
from (select cohort, signal_id, seg, avg(value) as m, stddev_samp(value) as s from (select cohort, signal_id, value, ntile(10) {W} as seg from @obs) x group by cohort, signal_id, seg) y group by cohort, signal_id""")
view("signal_temporal", """
select t.cohort, t.signal_id, t.slope, t.r2, t.strength, m.n_reversals, m.direction, z.n_crossings, a.acf1, a.memory, b.std_ratio, b.mean_drift
from @signal_trend t join @signal_monotonicity m on t.cohort = m.cohort and t.signal_id = m.signal_id join @signal_zero_crossings z on t.cohort = z.cohort and t.signal_id = z.signal_id
join @signal_acf1 a on t.cohort = a.cohort and t.signal_id = a.signal_id join @signal_rolling_stability b on t.cohort = b.cohort and t.signal_id = b.signal_id""")
view("derivative_raw", f"""
select cohort, signal_id, s0, value, d1, d2, avg(d1) over ({K} order by s0 rows between 5 preceding and 5 following) as d1s, avg(d2) over ({K} order by s0 rows between 5 preceding and 5 following) as d2s,
       {div(f's0 - min(s0) over ({K})', f'max(s0) over ({K}) - min(s0) over ({K})')} as life
from (select cohort, signal_id, s0, value, d1, d1 - lag(d1) {W} as d2 from (select cohort, signal_id, s0, value, value - lag(value) {W} as d1 from @obs) a) b""")
view("signal_noise", f"""
select cohort, signal_id, {r('1.4826 * ' + quantile(0.5, 'abs(value - m0)'))} as noise_value, {r('1.4826 * ' + quantile(0.5, 'abs(d1 - m1)'))} as noise_d1, {r('1.4826 * ' + quantile(0.5, 'abs(d2 - m2)'))} as noise_d2
from (select d.cohort, d.signal_id, d.value, d.d1, d.d2, m.m0, m.m1, m.m2 from @derivative_raw d join
        (select cohort, signal_id, {quantile(0.5, 'value')} as m0, {quantile(0.5, 'd1')} as m1, {quantile(0.5, 'd2')} as m2 from @derivative_raw group by cohort, signal_id) m
      on d.cohort = m.cohort and d.signal_id = m.signal_id) x group by cohort, signal_id""")
view("derivative_stats", f"""
select cohort, signal_id, {r('avg(abs(d1))')} as d1_abs, {r('stddev_samp(d1)')} as d1_std, {r('avg(abs(d2))')} as d2_abs, {r('stddev_samp(d2)')} as d2_std, {r(div('stddev_samp(d1s)', 'stddev_samp(d1)'))} as d1_snr, {r(div('stddev_samp(d2s)', 'stddev_samp(d2)'))} as d2_snr
from @derivative_raw group by cohort, signal_id""")
view("derivative_depth", "select cohort, signal_id, case when d2_snr > 0.5 then 2 when d1_snr > 0.5 then 1 else 0 end as depth from @derivative_stats")
view("derivative_ratios", f"""
select cohort, signal_id, {r(div('avg(abs(d1)) filter (where life >= 0.6)', 'avg(abs(d1)) filter (where life <= 0.4)'))} as d1_late_early, {r(div('avg(abs(d2s)) filter (where life >= 0.6)', 'avg(abs(d2s)) filter (where life <= 0.4)'))} as d2_late_early
from @derivative_raw group by cohort, signal_id""")
view("derivative_onset", f"""
select cohort, signal_id, s0 as onset, life_r as onset_life from (
  select d.cohort, d.signal_id, d.s0, {r('d.life')} as life_r, row_number() over (partition by d.cohort, d.signal_id order by d.s0) as k
  from @derivative_raw d join (select cohort, signal_id, avg(abs(d2s)) + 3 * stddev_samp(abs(d2s)) as lim from @derivative_raw where life <= 0.2 group by cohort, signal_id) b
  on d.cohort = b.cohort and d.signal_id = b.signal_id where d.life > 0.2 and abs(d.d2s) > b.lim) x where k = 1""")
view("derivative_regions", f"""
select cohort, signal_id, {r('a')} as early, {r('b')} as middle, {r('c')} as late, case when a >= b and a >= c then 'early' when b >= c then 'middle' else 'late' end as most_active
from (select cohort, signal_id, avg(abs(d2s)) filter (where life < 0.3333333333) as a, avg(abs(d2s)) filter (where life >= 0.3333333333 and life < 0.6666666667) as b, avg(abs(d2s)) filter (where life >= 0.6666666667) as c
      from @derivative_raw group by cohort, signal_id) x""")
view("signal_derivatives", """
select s.cohort, s.signal_id, s.d1_abs, s.d2_abs, p.depth, q.d1_late_early, q.d2_late_early, o.onset, g.most_active
from @derivative_stats s join @derivative_depth p on s.cohort = p.cohort and s.signal_id = p.signal_id join @derivative_ratios q on s.cohort = q.cohort and s.signal_id = q.signal_id
left join @derivative_onset o on s.cohort = o.cohort and s.signal_id = o.signal_id join @derivative_regions g on s.cohort = g.cohort and s.signal_id = g.signal_id""")
view("signal_windows", f"""
-- a row falls into the windows (of 50, every 25) whose numbers follow from its place: an explode, no range join
select cohort, signal_id, w as window_index, min(s0) as signal_0_start, max(s0) as signal_0_end, {r('(min(s0) + max(s0)) / 2')} as signal_0_center, count(value) as n, {r('avg(value)')} as mean, {r('stddev_samp(value)')} as std,
       min(value) as value_min, max(value) as value_max, {r(quantile(0.5, 'value'))} as median, {r('sqrt(avg(value * value))')} as rms, {r('regr_slope(value, s0)')} as slope, {r('avg(abs(d))')} as roughness
from (select cohort, signal_id, s0, value, d, cast(greatest(floor(s0 / 25) - back, 0) as bigint) as w, back, s0 / 25 as place
      from (select cohort, signal_id, s0, value, value - lag(value) {W} as d from @obs) o cross join (select 0 as back union all select 1 as back) k) x
where place >= back group by cohort, signal_id, w having count(*) >= 40""")
view("typology", """
select s.cohort, s.signal_id, s.continuity, t.strength as trend, t.direction, t.memory, case when t.std_ratio > 3 then 'heteroscedastic' else 'homoscedastic' end as variance_class,
       case when abs(s.skewness) > 1 then 'skewed' else 'symmetric' end as shape, case when s.kurtosis > 3 then 'heavy' when s.kurtosis < -1 then 'light' else 'normal' end as tails, d.depth as derivative_depth
from @signal_statistics s left join @signal_temporal t on s.cohort = t.cohort and s.signal_id = t.signal_id left join @signal_derivatives d on s.cohort = d.cohort and s.signal_id = d.signal_id""")
