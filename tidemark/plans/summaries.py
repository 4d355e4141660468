"""Work orders, charts, dashboards, summaries, exports and index detection, over the layers below."""

from __future__ import annotations

from .dag import corr, div, first_of, ladder, quantile, r, rank, share, view

K = "partition by cohort, signal_id"


def json(*pairs: tuple[str, str]) -> str:
    """A JSON object as a string expression, from (key, expression of the value as JSON text)."""
    inner = ", ', ', ".join(f"'\"{k}\": ', {v}" for k, v in pairs)
    return "concat('{', " + inner + ", '}')"


def text(x: str) -> str:
    return f"coalesce('\"' || replace({x}, '\"', '\\\\\"') || '\"', 'null')"


def plain(x: str) -> str:
    """Integers and booleans."""
    return f"coalesce(cast({x} as #string), 'null')"


# --- work orders -------------------------------------------------------------------------------------------------
_CALCULUS = "hurst stationarity dtw curvature lyapunov phase_space transfer_entropy".split()
_ALWAYS = "entropy correlation regime granger lead_lag".split()
view("v_manifold_work_orders", f"""
select signal_id, signal_class, quantity, calculus_valid, interpolation_valid, {', '.join(f'calculus_valid as compute_{c}' for c in _CALCULUS)}, {', '.join(f'true as compute_{c}' for c in _ALWAYS)}, true as include_in_umap, true as include_in_pca,
       case signal_class when 'analog' then 1 when 'periodic' then 2 when 'digital' then 3 when 'event' then 4 end as priority from @v_signal_class_unit""")
view("v_work_order_summary", f"""
select signal_class, count(*) as n_signals, {', '.join(f'count(*) filter (where compute_{c}) as needs_{c}' for c in ('hurst', 'entropy', 'correlation', 'dtw', 'regime', 'lyapunov', 'granger'))} from @v_manifold_work_orders group by signal_class""")
view("v_work_orders_json", f"""
select signal_id, {json(('signal_class', text('signal_class')), ('compute', json(*((c, plain(f'compute_{c}')) for c in _CALCULUS + _ALWAYS))), ('global', json(('include_umap', plain('include_in_umap')), ('include_pca', plain('include_in_pca')))), ('priority', plain('priority')))} as work_order from @v_manifold_work_orders""")

# --- one row a signal: what the layers say of it -------------------------------------------------------------------
view("signal_analysis", f"""
-- over all cohorts, as charts and dashboards show signals
select t.signal_id, {first_of(('avg(a.autocorr_lag1) > 0.5', 'persistent'), ('avg(a.autocorr_lag1) < -0.2', 'anti-persistent'), other='random-walk')} as persistence_class, min(e.entropy_category) as entropy_class, {first_of(('1.0 * count(*) filter (where t.is_stationary) / count(*) >= 0.5', 'stationary'), other='non-stationary')} as stationarity_class,
       {first_of(('avg(f.ftle) > 0.01', 'chaotic'), ('avg(f.ftle) > -0.01', 'edge-of-chaos'), other='stable')} as stability_class, {r('avg(f.ftle)', 13)} as lyapunov, {r('avg(t.mean_drift)', 13)} as mean_drift, {r('avg(e.normalized_entropy)', 13)} as entropy, {r('avg(h.hurst)', 13)} as hurst, max(g.n_regimes) as regime_id,
       {first_of(('sum(coalesce(c.out_degree, 0)) > 0 and sum(coalesce(c.in_degree, 0)) > 0', 'HUB'), ('sum(coalesce(c.out_degree, 0)) > 0', 'SOURCE'), ('sum(coalesce(c.in_degree, 0)) > 0', 'SINK'), other='ISOLATE')} as causal_role, sum(coalesce(c.out_degree, 0)) as n_drives, sum(coalesce(c.in_degree, 0)) as n_driven_by
from @v_signal_typology t left join @v_autocorr_lag1 a on t.cohort = a.cohort and t.signal_id = a.signal_id left join @v_shannon_entropy e on t.cohort = e.cohort and t.signal_id = e.signal_id left join @ftle_summary f on t.cohort = f.cohort and t.signal_id = f.signal_id
left join (select cohort, signal_id, avg(hurst) as hurst from @signal_features group by cohort, signal_id) h on t.cohort = h.cohort and t.signal_id = h.signal_id left join (select cohort, signal_id, count(*) as n_regimes from @v_regime_stats group by cohort, signal_id) g on t.cohort = g.cohort and t.signal_id = g.signal_id
left join @v_causal_roles c on t.cohort = c.cohort and t.signal_id = c.signal_id group by t.signal_id""")
view("signal_pairs", f"""
select signal_a, signal_b, {r('avg(instant_correlation)', 13)} as instant_correlation, min(optimal_lag) as optimal_lag, {ladder('abs(avg(instant_correlation))', '>', (0.7, 'strong'), (0.3, 'moderate'), other='weak')} as correlation_strength, case when avg(instant_correlation) >= 0 then 'positive' else 'negative' end as correlation_direction
from @v_geometry_complete where signal_a < signal_b and instant_correlation is not null group by signal_a, signal_b""")

# --- charts and graph ----------------------------------------------------------------------------------------------
view("v_chart_signals", "select o.cohort, o.signal_id, o.s0 as x, o.value, o.unit, c.signal_class from @observations o left join @v_signal_class_unit c on o.signal_id = c.signal_id")
view("v_chart_signals_regime", "select o.cohort, o.signal_id, o.s0 as x, o.value, a.regime_id, g.regime_start, g.regime_end from @obs o join @v_regime_assignment a on o.cohort = a.cohort and o.signal_id = a.signal_id and o.s0 = a.s0 left join @v_regime_stats g on a.cohort = g.cohort and a.signal_id = g.signal_id and a.regime_id = g.regime_id")
view("v_chart_correlation_matrix", "select signal_a, signal_b, instant_correlation as correlation, correlation_strength, correlation_direction from @signal_pairs")
view("v_chart_top_correlations", "select signal_a, signal_b, instant_correlation as correlation, optimal_lag from @signal_pairs where abs(instant_correlation) > 0.5 order by abs(instant_correlation) desc, signal_a, signal_b limit 20")
view("v_graph_nodes", """
select a.signal_id as id, concat(a.signal_id, coalesce(' [' || c.unit || ']', '')) as label, c.unit, c.quantity, a.causal_role, a.n_drives, a.n_driven_by, a.n_drives + a.n_driven_by as causal_weight,
       case a.causal_role when 'SOURCE' then '#ff6b6b' when 'SINK' then '#4ecdc4' when 'HUB' then '#ffe66d' when 'ISOLATE' then '#95a5a6' else '#7f8c8d' end as color from @signal_analysis a left join @v_signal_class_unit c on a.signal_id = c.signal_id""")
view("v_graph_edges", "select signal_a as source, signal_b as target, optimal_lag as weight, instant_correlation as strength from @signal_pairs where optimal_lag <> 0")
view("v_chart_regime_timeline", f"select g.cohort, g.signal_id, g.regime_id, g.regime_start, g.regime_end, g.regime_end - g.regime_start as regime_duration, a.stability_class, a.lyapunov from @v_regime_stats g join @signal_analysis a on g.signal_id = a.signal_id")
view("v_chart_regime_summary", f"select signal_id, count(distinct regime_id) as n_regimes, {r('avg(regime_end - regime_start)')} as avg_regime_duration, max(regime_end - regime_start) as max_regime_duration, min(regime_end - regime_start) as min_regime_duration from @v_regime_stats group by signal_id")

# --- dashboards ----------------------------------------------------------------------------------------------------
view("v_dashboard_signal_cards", f"""
select a.signal_id, c.signal_class, c.quantity, c.unit, a.persistence_class, a.entropy_class, a.stationarity_class, a.stability_class, a.regime_id, a.causal_role, a.n_drives, a.n_driven_by, abs(a.lyapunov) as lyapunov_magnitude, a.mean_drift, {rank('abs(a.lyapunov)')} as instability_rank, {rank('a.mean_drift')} as nonstationarity_rank,
       {first_of(("a.stability_class = 'chaotic' and a.stationarity_class = 'non-stationary'", 'critical'), ("a.stability_class = 'chaotic'", 'warning'), ("a.stationarity_class = 'non-stationary'", 'monitor'), other='healthy')} as health_status from @signal_analysis a left join @v_signal_class_unit c on a.signal_id = c.signal_id""")
_n = lambda c: f"count(*) filter (where {c})"
view("v_dashboard_system_health", f"""
select count(*) as total_signals, {_n("stability_class = 'chaotic'")} as chaotic_signals, {_n("stability_class = 'stable'")} as stable_signals, {_n("stationarity_class = 'non-stationary'")} as nonstationary_signals, {_n("causal_role = 'SOURCE'")} as source_signals, {_n("causal_role = 'SINK'")} as sink_signals,
       {_n("causal_role = 'HUB'")} as hub_signals, {r('100.0 * ' + _n("stability_class = 'stable'") + ' / nullif(count(*), 0)', 1)} as stability_score from @signal_analysis""")
view("v_dashboard_ranked", f"""
select signal_id, lyapunov, mean_drift, abs(lyapunov) as lyapunov_magnitude, {rank('abs(lyapunov)')} as instability_rank, {rank('mean_drift')} as nonstationarity_rank, {share('abs(lyapunov)')} as instability_percentile, {share('mean_drift')} as nonstationarity_percentile from @signal_analysis""")
view("v_dashboard_alerts", "select * from @v_dashboard_ranked order by instability_rank, signal_id")
view("v_dashboard_deviations", "select cohort, signal_0_center, severity from @v_deviation_flags where severity <> 'normal'")

# --- summaries and exports -----------------------------------------------------------------------------------------
view("v_summary_typology", f"""
select 'Signal Typology' as layer_name, 'WHAT type of signal is this?' as layer_question, count(*) as n_signals, {_n("persistence_class = 'persistent'")} as n_persistent, {_n("persistence_class = 'anti-persistent'")} as n_anti_persistent, {_n("persistence_class = 'random-walk'")} as n_random_walk,
       {_n("stationarity_class = 'stationary'")} as n_stationary, {r('avg(entropy)', 3)} as avg_entropy, {r('avg(hurst)', 3)} as avg_hurst from @signal_analysis""")
view("v_summary_geometry", f"""
select 'Behavioral Geometry' as layer_name, 'HOW do signals relate to each other?' as layer_question, count(*) as n_pairs, {', '.join(f"count(*) filter (where correlation_strength = '{v}') as n_{v}_correlations" for v in ('strong', 'moderate', 'weak'))}, {r('avg(abs(instant_correlation))', 3)} as avg_abs_correlation from @signal_pairs""")
view("v_summary_dynamics", f"""
select 'Dynamical Systems' as layer_name, 'WHEN and HOW does behavior change?' as layer_question, count(*) as n_signals, max(regime_id) as n_unique_regimes, {_n("stability_class = 'stable'")} as n_stable, {_n("stability_class = 'chaotic'")} as n_chaotic, {_n("stability_class = 'edge-of-chaos'")} as n_edge, {r('avg(lyapunov)', 4)} as avg_lyapunov from @signal_analysis""")
view("v_summary_causality", f"""
select 'Causal Mechanics' as layer_name, 'WHY do signals behave this way?' as layer_question, count(*) as n_signals, {_n("causal_role = 'SOURCE'")} as n_sources, {_n("causal_role = 'SINK'")} as n_sinks, {_n("causal_role = 'HUB'")} as n_hubs, {_n("causal_role = 'ISOLATE'")} as n_isolates, sum(n_drives) as total_causal_links from @signal_analysis""")
_layers = (("v_summary_typology", "n_signals n_persistent n_anti_persistent n_random_walk n_stationary avg_entropy avg_hurst"), ("v_summary_geometry", "n_pairs n_strong_correlations n_moderate_correlations n_weak_correlations avg_abs_correlation"),
           ("v_summary_dynamics", "n_signals n_unique_regimes n_stable n_chaotic n_edge avg_lyapunov"), ("v_summary_causality", "n_signals n_sources n_sinks n_hubs n_isolates total_causal_links"))
view("v_summary_all_layers", "-- the layers have unlike columns: a row for each layer and measure\n" + " union all ".join(f"select {i} as layer_order, layer_name, '{m}' as metric, cast({m} as double) as value from @{v}" for i, (v, ms) in enumerate(_layers, 1) for m in ms.split()))
view("v_export_signal_json", f"""
select signal_id, {json(('signal_id', text('signal_id')), ('classification', json(('class', text('signal_class')), ('quantity', text('quantity')), ('unit', text('unit')))), ('typology', json(('persistence', text('persistence_class')), ('entropy', text('entropy_class')), ('stationarity', text('stationarity_class')))),
       ('dynamics', json(('stability', text('stability_class')), ('regime_id', plain('regime_id')))), ('causality', json(('role', text('causal_role')), ('n_drives', plain('n_drives')), ('n_driven_by', plain('n_driven_by')))), ('health', text('health_status')))} as signal_json from @v_dashboard_signal_cards""")
view("v_export_system_json", f"""
select {json(('health', json(*((c, plain(f'h.{c}')) for c in ('total_signals', 'chaotic_signals', 'stable_signals', 'nonstationary_signals', 'source_signals', 'sink_signals', 'hub_signals')))), ('alerts', "concat('[', a.items, ']')"))} as system_json from @v_dashboard_system_health h
cross join (select #list(concat('"', signal_id, '"'); ', ') as items from @v_dashboard_alerts where instability_rank <= 10) a""")
view("v_signals_needing_attention", f"""
select signal_id, health_status, count(*) as n_reasons, #list(reason; ', ') as reasons from (
  select signal_id, health_status, 'Chaotic dynamics detected' as reason from @v_dashboard_signal_cards where stability_class = 'chaotic' union all select signal_id, health_status, 'Non-stationary behavior' from @v_dashboard_signal_cards where stationarity_class = 'non-stationary'
  union all select signal_id, health_status, 'Driving multiple downstream signals' from @v_dashboard_signal_cards where n_drives > 3 union all select signal_id, health_status, 'Anti-persistent (mean-reverting)' from @v_dashboard_signal_cards where persistence_class = 'anti-persistent') x group by signal_id, health_status""")
view("v_key_causal_chains", """
select s.cohort, s.source as source_signal, s.target as sink_signal, a.out_degree as source_influence, b.in_degree as sink_dependency from (select cohort, source, target from @v_causal_strength) s
join @v_causal_roles a on s.cohort = a.cohort and s.source = a.signal_id join @v_causal_roles b on s.cohort = b.cohort and s.target = b.signal_id where a.causal_role = 'SOURCE' and b.causal_role = 'SINK'
order by a.out_degree desc, b.in_degree desc, s.cohort, s.source, s.target limit 10""")

# --- general views ---------------------------------------------------------------------------------------------------
view("v_dataset_overview", f"""
select count(distinct cohort) as n_entities, count(distinct signal_id) as n_signals, count(*) as n_observations, min(s0) as index_start, max(s0) as index_end, max(s0) - min(s0) as index_span, {r(div('1.0 * count(*)', 'count(distinct signal_id)'))} as avg_points_per_signal, count(distinct concat(cohort, '|', signal_id)) as n_unique_series from @observations""")
view("common_values", "-- the most frequent value of a signal; of equally frequent ones the least\nselect signal_id, value as mode from (select signal_id, value, row_number() over (partition by signal_id order by count(*) desc, value) as k from @obs where value is not null group by signal_id, value) x where k = 1")
view("v_signal_profile", f"""
select p.*, m.mode from (select signal_id, count(*) as n_points, {r('avg(value)')} as mean, {r(quantile(0.5, 'value'))} as median, {r('stddev_samp(value)')} as std, min(value) as min_val, max(value) as max_val, {r('max(value) - min(value)')} as value_range, {r(quantile(0.25, 'value'))} as q1, {r(quantile(0.75, 'value'))} as q3,
       {r(quantile(0.75, 'value') + ' - ' + quantile(0.25, 'value'))} as iqr, {r(div('avg(value) - ' + quantile(0.5, 'value'), 'stddev_samp(value)'))} as skewness_proxy, count(distinct value) as n_unique_values, {r('1.0 * count(distinct value) / count(*)')} as unique_ratio, {r('avg(abs(d1))')} as avg_velocity, {r('max(abs(d1))')} as max_velocity, {r('avg(abs(d2))')} as avg_acceleration,
       {first_of(('count(distinct value) <= 10 or 1.0 * count(distinct value) / count(*) < 0.01', 'likely_digital'), other='likely_analog')} as inferred_class from @calc group by signal_id) p left join @common_values m on p.signal_id = m.signal_id""")
view("v_signal_departure", f"""
-- a gap is more than twice the mean step of its signal; ten gaps and more cost twenty points
select *, {r('greatest(0.0, 100 - null_rate * 100 - outlier_rate_p99 * 50 - case when n_gaps > 10 then 20 else n_gaps * 2 end)', 8)} as departure_score from (
  select signal_id, count(*) as n_points, count(*) - count(value) as n_nulls, {r('1.0 * (count(*) - count(value)) / count(*)')} as null_rate, {_n('value = 0')} as n_zeros, {r('1.0 * ' + _n('value = 0') + ' / count(*)')} as zero_rate, {_n('p > 0.99 or p < 0.01')} as n_outliers_p99, {r('1.0 * ' + _n('p > 0.99 or p < 0.01') + ' / count(*)')} as outlier_rate_p99,
         {_n('p > 0.999 or p < 0.001')} as n_outliers_p999, max(gap) as max_gap, {r('avg(gap)')} as avg_gap, {_n('gap > 2 * typical')} as n_gaps, min(s0) as first_index, max(s0) as last_index, max(s0) - min(s0) as coverage_span
  from (select *, avg(gap) over (partition by signal_id) as typical from (select signal_id, s0, value, percent_rank() over (partition by signal_id order by value nulls last) as p, s0 - lag(s0) over (partition by cohort, signal_id order by s0) as gap from @obs) a) b group by signal_id) c""")
view("v_index_coverage", f"""
select b.cohort, b.signal_id, b.start_index, b.end_index, b.end_index - b.start_index as span, b.n_points, {r(div('1.0 * b.n_points', 'b.end_index - b.start_index'))} as density, b.start_index - g.lo as start_offset, g.hi - b.end_index as end_offset, {r(div('b.end_index - b.start_index', 'g.hi - g.lo'))} as coverage_fraction
from (select cohort, signal_id, min(s0) as start_index, max(s0) as end_index, count(*) as n_points from @obs group by cohort, signal_id) b cross join (select min(s0) as lo, max(s0) as hi from @obs) g""")
_REL = (0.8, "strong_positive"), (0.5, "moderate_positive"), (0.2, "weak_positive"), (-0.2, "uncorrelated"), (-0.5, "weak_negative"), (-0.8, "moderate_negative")
view("v_signal_correlations", f"""
select signal_a, signal_b, correlation, abs(correlation) as abs_correlation, n_overlap, {ladder('correlation', '>', *_REL, other='strong_negative')} as relationship from (select signal_a, signal_b, {r(corr('va', 'vb'))} as correlation, count(*) as n_overlap from @pair_points group by signal_a, signal_b having count(*) > 30) x
where abs(correlation) > 0.3 order by abs(correlation) desc, signal_a, signal_b limit 50""")
view("primitives", """
-- a row a place with what is known of it and of its signal
select c.cohort, c.signal_id, c.s0, c.value, c.d1 as dvalue, c.d2 as d2value, a.regime_id, coalesce(r.out_degree, 0) as causal_out_degree, coalesce(r.in_degree, 0) as causal_in_degree, r.causal_role
from @calc c join @v_regime_assignment a on c.cohort = a.cohort and c.signal_id = a.signal_id and c.s0 = a.s0 left join @v_causal_roles r on c.cohort = r.cohort and c.signal_id = r.signal_id""")
view("v_regime_summary", f"""
select regime_id, count(distinct signal_id) as n_signals_affected, count(distinct cohort) as n_entities_affected, count(*) as n_points, min(s0) as regime_start, max(s0) as regime_end, max(s0) - min(s0) as duration, {r('avg(value)')} as mean_value, {r('stddev_samp(value)')} as volatility, {r('avg(abs(dvalue))', 9)} as avg_velocity,
       {r('1.0 * count(*) / max(total)', 9)} as fraction_of_data from @primitives cross join (select count(*) as total from @obs) t group by regime_id""")
view("v_regime_transitions_general", f"""
select transition_at, from_regime, to_regime, count(distinct signal_id) as n_signals_transitioning, {r('avg(abs(value_jump))')} as avg_value_jump, {r('avg(abs(velocity_jump))')} as avg_velocity_jump, {first_of(('round(avg(value_jump), 6) > 0', 'upward'), ('round(avg(value_jump), 6) < 0', 'downward'), other='lateral')} as direction
from (select signal_id, s0 as transition_at, lag(regime_id) over ({K} order by s0) as from_regime, regime_id as to_regime, value - lag(value) over ({K} order by s0) as value_jump, dvalue - lag(dvalue) over ({K} order by s0) as velocity_jump from @primitives) x where from_regime <> to_regime group by transition_at, from_regime, to_regime""")
view("v_causal_summary", f"""
select cohort, signal_id, causal_role, out_degree as drives_n_signals, in_degree as driven_by_n_signals, out_degree - in_degree as net_influence,
       {first_of(('out_degree > 0 and in_degree = 0', 'root_cause'), ('out_degree = 0 and in_degree > 0', 'effect'), ('out_degree > in_degree', 'driver'), ('out_degree < in_degree', 'follower'), ('out_degree > 0', 'mediator'), other='isolated')} as network_role
from (select s.cohort, s.signal_id, r.causal_role, coalesce(r.out_degree, 0) as out_degree, coalesce(r.in_degree, 0) as in_degree from (select distinct cohort, signal_id from @obs) s left join @v_causal_roles r on s.cohort = r.cohort and s.signal_id = r.signal_id) x""")
view("all_deviations", f"""
select 'outlier' as deviation_type, o.signal_id, o.cohort, o.s0 as index_at, o.value, {r(div('greatest(o.value - s.q3, s.q1 - o.value, 0)', 's.iqr'))} as severity from @obs o join @v_signal_profile s on o.signal_id = s.signal_id where o.value > s.q3 + 3.0 * s.iqr or o.value < s.q1 - 3.0 * s.iqr
union all select 'regime_change', signal_id, cohort, s0, value, 1.0 from (select signal_id, cohort, s0, value, regime_id, lag(regime_id) over ({K} order by s0) as before from @primitives) x where regime_id <> before
union all select 'velocity_spike', signal_id, cohort, s0, value, {r(div('abs(d1)', 'typical'))} from (select signal_id, cohort, s0, value, d1, avg(abs(d1)) over (partition by signal_id) as typical from @calc) y where abs(d1) > 5 * typical""")
view("v_deviations", "select * from @all_deviations order by severity desc, deviation_type, signal_id, cohort, index_at limit 100")
view("v_entity_comparison", f"""
select cohort, signal_id, mean_val, std_val, min_val, max_val, n_points, {r('p')} as entity_pctile, {first_of(('p > 0.975 or p < 0.025', 'unusual'), ('p > 0.85 or p < 0.15', 'different'), other='typical')} as entity_status
from (select *, {share('mean_val', 'signal_id')} as p from (select cohort, signal_id, {r('avg(value)')} as mean_val, {r('stddev_samp(value)')} as std_val, min(value) as min_val, max(value) as max_val, count(*) as n_points from @obs group by cohort, signal_id) a) b""")
view("v_signal_behavior", f"""
select a.signal_id, a.hurst, a.lyapunov, a.entropy, t.behavioral_type, {first_of(('a.hurst > 0.6', 'trending'), ('a.hurst < 0.4', 'mean_reverting'), other='random_walk')} as persistence_class, {ladder('a.lyapunov', '>', (0.1, 'chaotic'), (0, 'sensitive'), other='stable')} as stability_class,
       {ladder('a.entropy', '>', (0.8, 'high_complexity'), (0.4, 'moderate_complexity'), other='low_complexity')} as complexity_class, a.regime_id as n_regimes, a.causal_role from @signal_analysis a left join (select signal_id, max(behavioral_type) as behavioral_type from @v_signal_typology group by signal_id) t on a.signal_id = t.signal_id""")
view("v_system_dashboard", f"""
select o.n_entities, o.n_signals, o.n_observations, p.n_analog, p.n_digital, d.avg_departure_score, d.n_departed_signals, v.n_outliers, v.n_regime_changes, v.n_velocity_spikes, g.n_regimes, c.n_strong_correlations, n.n_root_causes, n.n_effects
from @v_dataset_overview o cross join (select {_n("inferred_class = 'likely_analog'")} as n_analog, {_n("inferred_class = 'likely_digital'")} as n_digital from @v_signal_profile) p cross join (select {r('avg(departure_score)', 4)} as avg_departure_score, {_n('departure_score < 70')} as n_departed_signals from @v_signal_departure) d
cross join (select {', '.join(f"count(*) filter (where deviation_type = '{k}') as n_{k}s" for k in ('outlier', 'regime_change', 'velocity_spike'))} from @v_deviations) v cross join (select count(distinct regime_id) as n_regimes from @v_regime_assignment) g
cross join (select {_n("relationship = 'strong_positive'")} as n_strong_correlations from @v_signal_correlations) c cross join (select {_n("network_role = 'root_cause'")} as n_root_causes, {_n("network_role = 'effect'")} as n_effects from @v_causal_summary) n""")
view("v_insight_cards", """
select insight_type, signal_id, title, metric from (
  select 'volatility' as insight_type, signal_id, 'Highest volatility' as title, std as metric, row_number() over (order by std desc nulls last, signal_id) as k from @v_signal_profile
  union all select 'correlation', concat(signal_a, ' <-> ', signal_b), 'Strongest relationship', abs_correlation, row_number() over (order by abs_correlation desc nulls last, signal_a, signal_b) from @v_signal_correlations
  union all select 'causality', signal_id, 'Primary driver', cast(drives_n_signals as double), row_number() over (order by drives_n_signals desc, cohort, signal_id) from @v_causal_summary where drives_n_signals > 0
  union all select 'regime', signal_id, 'Most dynamic', cast(n_regimes as double), row_number() over (order by n_regimes desc, signal_id) from @v_signal_behavior
  union all select 'departure', signal_id, 'Needs attention', 100 - departure_score, row_number() over (order by departure_score, signal_id) from @v_signal_departure) x where k = 1""")
view("v_sparkline_data", f"""
select cohort, signal_id, s0, value from (select cohort, signal_id, s0, value, row_number() over ({K} order by s0) as k, count(*) over ({K}) as n from @obs) x where k % greatest(1, cast(floor(n / 100.0) as bigint)) = 0""")
view("v_api_overview", f"""
select {json(('entities', plain('o.n_entities')), ('signals', plain('o.n_signals')), ('observations', plain('o.n_observations')), ('index_range', json(('start', plain('cast(o.index_start as bigint)')), ('end', plain('cast(o.index_end as bigint)')))), ('departure', json(('departed_count', plain('d.n')))), ('regimes', plain('g.n')), ('deviations', plain('v.n')))} as overview
from @v_dataset_overview o cross join (select count(*) as n from @v_signal_departure where departure_score < 70) d cross join (select count(distinct regime_id) as n from @v_regime_assignment) g cross join (select count(*) as n from @v_deviations) v""")

# --- index detection -------------------------------------------------------------------------------------------------
#: Column names by what they index.
INDEX_NAMES = {
    "time": "timestamp time datetime date t ts time_stamp sample_time record_time created_at measured_at observation_time recorded_at dt",
    "cycle": "cycle cycles sample index i n step iteration sequence row sample_id",
    "space": "x y z position distance depth height length radius r location station chainage",
    "frequency": "frequency freq f hz khz bin band",
}
view("column_catalog", """
-- the columns of the registered tables that may index observations, with their kinds
select * from (values ('events', 'ts', 'TIMESTAMP'), ('events', 'event_id', 'BIGINT'), ('events', 'value', 'DOUBLE'), ('orders', 'o_orderdate', 'TIMESTAMP'), ('lineitem', 'l_shipdate', 'TIMESTAMP'), ('observations', 'cohort', 'VARCHAR'), ('observations', 'signal_id', 'VARCHAR'), ('observations', 's0', 'DOUBLE'), ('observations', 'value', 'DOUBLE'), ('observations', 'unit', 'VARCHAR')) as t(table_name, column_name, data_type)""")
_named = lambda k: f"lower(column_name) in ({', '.join(repr(n) for n in INDEX_NAMES[k].split())})"
_clock = "data_type in ('TIMESTAMP', 'DATE', 'DATETIME')"
view("v_index_detection", f"""
select table_name, column_name, data_type, {first_of((f"{_named('time')} and ({_clock} or data_type = 'VARCHAR')", 'timestamp'), (_named('space'), 'spatial'), (_named('frequency'), 'frequency'), (_named('cycle'), 'cycle'), other='unknown')} as detected_type,
       {first_of((_named('time'), 'time'), (_named('space'), 'space'), (_named('frequency'), 'frequency'), (_named('cycle'), 'time'), other='unknown')} as dimension,
       {first_of((f"({_named('time')} and data_type in ('TIMESTAMP', 'DATE')) or {_named('cycle')}", 'high'), (f"{_named('time')} or {_named('space')} or {_named('frequency')}", 'medium'), other='low')} as confidence, not ({_named('time')} and {_clock}) as needs_user_input from @column_catalog""")
_UNITS = (1, "milliseconds", 0.001), (60, "seconds", 1), (3600, "minutes", 60), (86400, "hours", 3600), (604800, "days", 86400), (2592000, "weeks", 604800)
view("v_sampling_interval", f"""
-- steps of the first 10,000 places in order; the most frequent one names the interval, of equally frequent ones the least
select interval_value, {ladder('interval_value', '<', *((a, n) for a, n, _ in _UNITS), other='months')} as interval_unit, round(interval_value / case {' '.join(f'when interval_value < {a} then {d}' for a, _, d in _UNITS)} else 2592000 end, 2) as interval_in_unit,
       {ladder('std_dt / nullif(mean_dt, 0)', '<', (0.01, 'regular'), (0.1, 'mostly_regular'), other='irregular')} as regularity, max_dt > interval_value * 2 as has_gaps, round(max_dt / nullif(interval_value, 0), 1) as max_gap_ratio, n_intervals
from (select max(case when k = 1 then dt end) as interval_value, sum(n * dt) / sum(n) as mean_dt, sqrt(greatest(0.0, (sum(n * dt * dt) - sum(n * dt) * sum(n * dt) / sum(n)) / nullif(sum(n) - 1, 0))) as std_dt, max(dt) as max_dt, sum(n) as n_intervals
      from (select dt, n, row_number() over (order by n desc, dt) as k from (select dt, count(*) as n from (select s0 - lag(s0) over (order by s0) as dt from (select distinct s0 from @obs order by s0 limit 10000) a) b where dt > 0 group by dt) c) d) e""")
_like = (("____-__-__T__:__:__Z", "ISO 8601 (Z)"), ("____-__-__T__:__:__.___Z", "ISO 8601 with ms (Z)"), ("____-__-__T__:__:__", "ISO 8601"), ("____-__-__T__:__:__.___", "ISO 8601 with ms"), ("____-__-__ __:__:__", "YYYY-MM-DD HH:MM:SS"), ("____-__-__ __:__:__.___", "YYYY-MM-DD HH:MM:SS.fff"),
         ("____-__-__", "YYYY-MM-DD"), ("__/__/____", "MM/DD/YYYY or DD/MM/YYYY"))
_whole = "case when value like '%-%' or value like '%/%' or value like '%.%' then null else try_cast(value as bigint) end"
view("v_timestamp_format", f"""
select value, {first_of(*((f"value like '{p}'", n) for p, n in _like), (f'{_whole} between 1000000000 and 4100000000', 'Unix seconds'), (f'{_whole} between 1000000000000 and 4100000000000', 'Unix milliseconds'), ('try_cast(value as double) between 1 and 72000', 'Excel serial (possible)'), other='Unknown format')} as detected_format
from (select cast(cast(s0 as bigint) as #string) as value from (select distinct s0 from @obs order by s0 limit 10) x union all select * from (values ('2024-01-31T10:00:00Z'), ('2024-01-31 10:00:00'), ('2024-01-31'), ('01/31/2024'), ('1706695200'), ('1706695200000'), ('n/a')) as t(value)) y""")
view("v_index_result", f"""
select c.table_name, c.column_name, c.detected_type as index_type, c.dimension, c.confidence, c.needs_user_input, s.interval_value as sampling_interval_seconds, s.interval_unit as sampling_unit, s.interval_in_unit as sampling_value, s.regularity, s.has_gaps,
       case when not c.needs_user_input then null when c.detected_type = 'cycle' then concat('Column "', c.column_name, '" is a cycle counter. What is the duration per cycle?') when c.detected_type = 'spatial' then concat('Column "', c.column_name, '" is spatial. What is the unit? (m, ft, km)')
            when c.detected_type = 'frequency' then concat('Column "', c.column_name, '" is frequency bins. What is the unit? (Hz, kHz)') else concat('Column "', c.column_name, '" type is unclear. What does it represent?') end as user_prompt
from (select *, row_number() over (order by case confidence when 'high' then 1 when 'medium' then 2 else 3 end, table_name, column_name) as k from @v_index_detection where detected_type <> 'unknown') c cross join @v_sampling_interval s where c.k = 1""")

# --- typology overlay ------------------------------------------------------------------------------------------------
view("typology_enriched", f"""
-- the classes by cheap measures, overlaid by those of the costlier ones where these are known
select t.cohort, t.signal_id, t.continuity, t.trend, t.direction, t.memory, t.variance_class, t.shape, t.tails, t.derivative_depth, f.hurst, f.spectral_entropy, f.permutation_entropy, f.sample_entropy,
       case when f.hurst is null then t.memory else {ladder('f.hurst', '>', (0.8, 'long_memory'), (0.6, 'persistent'), (0.4, 'short_memory'), other='anti_persistent')} end as memory_class, case when f.spectral_entropy is null then 'unknown' else {ladder('f.spectral_entropy', '<', (0.3, 'narrowband'), (0.7, 'mixed'), other='broadband')} end as spectral_class,
       case when f.permutation_entropy is null then 'unknown' else {ladder('f.permutation_entropy', '>', (0.6, 'random'), (0.3, 'mixed'), other='structured')} end as complexity_class
from @typology t left join (select cohort, signal_id, {', '.join(f'{r(f"avg({c})", 10)} as {c}' for c in ('hurst', 'spectral_entropy', 'permutation_entropy', 'sample_entropy'))} from @signal_features group by cohort, signal_id) f on t.cohort = f.cohort and t.signal_id = f.signal_id""")
