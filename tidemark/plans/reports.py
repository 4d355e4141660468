"""Baseline deviation, drift, rankings, ground truth, thresholds, feature relevance, classification and summaries."""

from __future__ import annotations

from .dag import corr, div, first_of, quantile, r, rank, share, view

K = "partition by cohort, signal_id"

# --- baseline deviation ------------------------------------------------------------------------------------------
_METRICS = "energy_proxy energy_velocity dissipation_rate coherence coherence_velocity effective_dim eigenvalue_entropy state_distance state_velocity state_acceleration".split()
_SCORED = "energy_proxy coherence state_distance effective_dim".split()
view("v_baseline_windows", """
-- the first tenth of a cohort's windows, as places of the axis, and a hundred places at least
select cohort, min(signal_0_center) as i_min, max(signal_0_center) as i_max, count(*) as n_total, greatest(cast(floor(count(*) * 0.10) as bigint), 100) as n_baseline, min(signal_0_center) + greatest(cast(floor(count(*) * 0.10) as bigint), 100) as baseline_end_i from @physics group by cohort""")
view("baselines", f"""
select p.cohort, {', '.join(f"{r(f'avg(p.{m})')} as {m}_mean, {r(quantile(0.05, f'p.{m}'))} as {m}_p05, {r(quantile(0.95, f'p.{m}'))} as {m}_p95" for m in _METRICS)}, count(*) as n_baseline_points, min(p.signal_0_center) as baseline_start, max(p.signal_0_center) as baseline_end
from @physics p join @v_baseline_windows w on p.cohort = w.cohort where p.signal_0_center <= w.baseline_end_i group by p.cohort""")
_over = lambda m: div(f'greatest(p.{m} - b.{m}_p95, b.{m}_p05 - p.{m}, 0)', f'b.{m}_p95 - b.{m}_p05')
view("v_deviation_scores", f"""
select *, {share('deviation_score')} as deviation_pctile from (
  select *, greatest({', '.join(f'coalesce({m}_exceedance, 0)' for m in _SCORED)}) as deviation_score from (
    select p.cohort, p.signal_0_center, {', '.join(f"{r(div(f'p.{m}', f'b.{m}_mean'), 4)} as {m}_ratio" for m in ('energy_proxy', 'dissipation_rate', 'state_distance'))}, {', '.join(f"{r(f'p.{m} - b.{m}_mean')} as {m}_shift" for m in ('energy_velocity', 'coherence', 'coherence_velocity', 'effective_dim', 'eigenvalue_entropy', 'state_velocity', 'state_acceleration'))},
           {', '.join(f"{r(_over(m), 4)} as {m}_exceedance" for m in _SCORED)}, {', '.join(f"p.{m} < b.{m}_p05 or p.{m} > b.{m}_p95 as flag_{m}" for m in _METRICS)}, p.energy_proxy, p.coherence, p.state_distance, p.signal_0_center <= b.baseline_end as in_baseline
    from @physics p join @baselines b on p.cohort = b.cohort) x) y""")
_few = " + ".join(f"case when flag_{m} then 1 else 0 end" for m in ("energy_proxy", "coherence", "state_distance"))
view("v_deviation_flags", f"""
select cohort, signal_0_center, in_baseline, {', '.join(f'flag_{m}' for m in _METRICS)}, {' + '.join(f'case when flag_{m} then 1 else 0 end' for m in _METRICS)} as n_deviating_metrics, deviation_score, deviation_pctile,
       {first_of(*((f'coalesce({m}_exceedance, 0) = deviation_score', m) for m in _SCORED), other='unknown')} as max_deviation_metric, {first_of((f'deviation_pctile > 0.99 or {_few} >= 3', 'critical'), (f'deviation_pctile > 0.95 or {_few} >= 1', 'warning'), other='normal')} as severity,
       energy_proxy_ratio, coherence_shift, state_distance_ratio, effective_dim_shift from @v_deviation_scores""")
view("v_deviation_events", f"""
select * from (select cohort, signal_0_center as event_time, severity, n_deviating_metrics, max_deviation_metric, deviation_score, before as prev_severity,
       case when before = 'normal' and severity <> 'normal' then 'deviation_onset' when before <> 'normal' and severity = 'normal' then 'return_to_normal' when before = 'warning' and severity = 'critical' then 'escalation' when before = 'critical' and severity = 'warning' then 'de_escalation' end as event_type
from (select *, lag(severity) over (partition by cohort order by signal_0_center) as before from @v_deviation_flags where not in_baseline) x) y where event_type is not null""")
view("v_deviation_entity_summary", f"""
select cohort, n_baseline_points, n_monitored_points, n_warning, n_critical, n_normal, {r(div('100.0 * (n_warning + n_critical)', 'n_monitored_points'), 4)} as pct_abnormal, current_severity, max_simultaneous_deviations, max_deviation_score, most_common_deviation_source,
       {first_of(('n_baseline_points < 20', 'insufficient_baseline'), ('n_critical > n_monitored_points * 0.1', 'departed'), ('n_warning + n_critical > n_monitored_points * 0.2', 'unstable'), ('n_warning + n_critical > n_monitored_points * 0.05', 'noisy'), other='stable')} as departure_assessment
from (select f.cohort, max(b.n_baseline_points) as n_baseline_points, count(*) filter (where not f.in_baseline) as n_monitored_points, {', '.join(f"count(*) filter (where not f.in_baseline and f.severity = '{v}') as n_{v}" for v in ('warning', 'critical', 'normal'))},
             max(case when f.last_one = 1 then f.severity end) as current_severity, max(f.n_deviating_metrics) as max_simultaneous_deviations, max(f.deviation_score) as max_deviation_score, max(m.metric) as most_common_deviation_source
      from (select *, row_number() over (partition by cohort order by signal_0_center desc) as last_one from @v_deviation_flags) f join @baselines b on f.cohort = b.cohort left join @common_sources m on f.cohort = m.cohort group by f.cohort) x""")
view("common_sources", """
-- the most frequent of each cohort; of equally frequent ones the first by name
select cohort, max_deviation_metric as metric from (select cohort, max_deviation_metric, row_number() over (partition by cohort order by count(*) desc, max_deviation_metric) as k from @v_deviation_flags where severity <> 'normal' group by cohort, max_deviation_metric) x where k = 1""")
view("v_deviation_fleet_summary", f"""
select count(*) as n_entities, {', '.join(f"count(*) filter (where departure_assessment = '{v}') as n_{v}" for v in ('stable', 'noisy', 'unstable', 'departed'))}, {', '.join(f"count(*) filter (where current_severity = '{v}') as n_currently_{v}" for v in ('normal', 'warning', 'critical'))},
       {r("100.0 * count(*) filter (where departure_assessment = 'stable') / nullif(count(*), 0)", 4)} as pct_stable, {r('avg(pct_abnormal)', 4)} as avg_pct_abnormal, max(fleet) as fleet_common_deviation_source
from @v_deviation_entity_summary cross join (select max(metric) as fleet from (select metric, row_number() over (order by count(*) desc, metric) as k from @common_sources group by metric) x where k = 1) y""")
_pct = lambda c: r(f"100.0 * count(*) filter (where {c}) / count(*)", 4)
view("v_sensitivity_analysis", f"""
select cohort, {_pct('deviation_pctile > 0.90')} as pct_flagged_p90, {_pct('deviation_pctile > 0.95')} as pct_flagged_p95, {_pct('deviation_pctile > 0.99')} as pct_flagged_p99, {_pct('n_deviating_metrics >= 1')} as pct_any_metric_oor, {_pct('n_deviating_metrics >= 3')} as pct_3plus_metrics_oor,
       {first_of((f"{_pct('n_deviating_metrics >= 1')} > 50", 'High OOR rate: tighten baseline or increase min_deviations'), (f"{_pct('n_deviating_metrics >= 1')} < 1", 'Very low OOR rate: may be missing deviations'), other='Detection rate within expected range')} as recommendation
from @v_deviation_flags where not in_baseline group by cohort""")
view("baseline_deviation", "select cohort, signal_0_center, deviation_score, deviation_pctile, n_deviating_metrics, max_deviation_metric, severity, energy_proxy_ratio, coherence_shift, state_distance_ratio, effective_dim_shift, in_baseline from @v_deviation_flags where not in_baseline")
# the same by signal, over observations
view("signal_baselines", f"""
select o.cohort, o.signal_id, count(*) as n_baseline, {r('avg(o.value)')} as mean, {r('stddev_samp(o.value)')} as std, {r(quantile(0.05, 'o.value'))} as p05, {r(quantile(0.95, 'o.value'))} as p95
from @obs o join (select cohort, min(s0) + 0.1 * (max(s0) - min(s0)) as stop from @obs group by cohort) w on o.cohort = w.cohort where o.s0 <= w.stop group by o.cohort, o.signal_id""")
view("signal_deviations", f"""
select o.cohort, o.signal_id, o.s0, o.value, {first_of(('o.value < b.p05', 'low'), ('o.value > b.p95', 'high'), other='in')} as side, {r(div('greatest(b.p05 - o.value, o.value - b.p95, 0)', 'b.p95 - b.p05'))} as exceedance, o.s0 <= w.stop as in_baseline
from @obs o join @signal_baselines b on o.cohort = b.cohort and o.signal_id = b.signal_id join (select cohort, min(s0) + 0.1 * (max(s0) - min(s0)) as stop from @obs group by cohort) w on o.cohort = w.cohort""")

# --- drift -------------------------------------------------------------------------------------------------------
view("drift_segments", f"""
select cohort, signal_id, {r('avg(value) filter (where life <= 0.25)')} as early_mean, {r('avg(value) filter (where life >= 0.75)')} as late_mean, {r('avg(value) filter (where life >= 0.75) - avg(value) filter (where life <= 0.25)')} as mean_delta,
       {r(div('avg(value) filter (where life >= 0.75) - avg(value) filter (where life <= 0.25)', 'stddev_samp(value)'))} as effect_size
from (select cohort, signal_id, value, {div(f's0 - min(s0) over ({K})', f'max(s0) over ({K}) - min(s0) over ({K})')} as life from @obs) x group by cohort, signal_id""")
view("drift_report", f"""
select d.cohort, d.signal_id, d.early_mean, d.late_mean, d.mean_delta, d.effect_size, t.slope, t.r2, case when abs(d.effect_size) > 0.8 then 'strong' when abs(d.effect_size) > 0.2 then 'mild' else 'none' end as drift,
       {r('repeat_len')} as bar_length
from (select cohort, signal_id, early_mean, late_mean, mean_delta, effect_size, least(20, round(20 * abs(effect_size), 0)) as repeat_len from @drift_segments) d join @signal_trend t on d.cohort = t.cohort and d.signal_id = t.signal_id""")
view("outlier_report", f"""
select o.cohort, o.signal_id, count(*) as n, count(*) filter (where o.value < s.q1 - 1.5 * (s.q3 - s.q1) or o.value > s.q3 + 1.5 * (s.q3 - s.q1)) as n_iqr, count(*) filter (where abs(o.value - s.mean) > 3 * s.std) as n_z3
from @obs o join @signal_statistics s on o.cohort = s.cohort and o.signal_id = s.signal_id group by o.cohort, o.signal_id""")
view("periodicity_report", f"""
select cohort, signal_id, n_peaks, {r('mean_gap')} as mean_gap, {r(div('std_gap', 'mean_gap'))} as gap_cv, case when {div('std_gap', 'mean_gap')} < 0.3 then 'regular' else 'irregular' end as rhythm
from (select cohort, signal_id, count(*) as n_peaks, avg(gap) as mean_gap, stddev_samp(gap) as std_gap from (select cohort, signal_id, s0 - lag(s0) over ({K} order by s0) as gap from @v_local_extrema where extrema_type = 'peak') x group by cohort, signal_id) y""")
view("correlation_changes", f"""
select cohort, signal_a, signal_b, {r('avg(correlation) filter (where tile < half)', 9)} as early, {r('avg(correlation) filter (where tile >= half)', 9)} as late, {r('avg(correlation) filter (where tile >= half) - avg(correlation) filter (where tile < half)', 9)} as change
from (select cohort, signal_a, signal_b, tile, correlation, max(tile) over (partition by cohort) / 2.0 as half from @pairwise_windowed) x group by cohort, signal_a, signal_b""")

# --- rankings, canaries, trajectories ----------------------------------------------------------------------------
view("v_signal_trajectory", f"""
-- the mean of the last four places less that of the four before; its departure from what the first fifth of the cohort's life has, after that fifth
select cohort, signal_id, s0, {r('delta')} as trajectory_delta, {r('base')} as baseline_slope, {r('abs(delta - base)')} as slope_departure_abs, {share('abs(delta - base)', 'cohort, signal_id')} as slope_departure_pctile
from (select d.cohort, d.signal_id, d.s0, d.delta, d.stop, avg(case when d.s0 < d.stop then d.delta end) over (partition by d.cohort, d.signal_id) as base
      from (select t.cohort, t.signal_id, t.s0, t.recent - t.earlier as delta, l.lo + (l.hi - l.lo) * 0.2 as stop
            from (select cohort, signal_id, s0, avg(value) over ({K} order by s0 rows between 3 preceding and current row) as recent, avg(value) over ({K} order by s0 rows between 7 preceding and 4 preceding) as earlier from @obs) t
            join (select cohort, min(s0) as lo, max(s0) as hi from @obs group by cohort) l on t.cohort = l.cohort where t.earlier is not null) d) x where s0 > stop and base is not null""")
view("v_canary_sequence", """
select cohort, signal_id, first_departure_i, departure_magnitude, row_number() over (partition by cohort order by first_departure_i, departure_magnitude desc, signal_id) as canary_rank, count(*) over (partition by signal_id) as times_canary_across_fleet
from (select cohort, signal_id, s0 as first_departure_i, slope_departure_abs as departure_magnitude, row_number() over (partition by cohort, signal_id order by s0) as k from @v_signal_trajectory where slope_departure_pctile > 0.99) x where k = 1""")

# --- ground truth ------------------------------------------------------------------------------------------------
view("v_label_summary", "select label_name, count(*) as n_labels, count(*) filter (where label_value = '1') as n_positive, #list(label_value; ',') as label_values from @labels group by label_name")
view("v_fault_times", "select cohort, min(signal_0_center) as fault_time, count(*) as n_fault_places from @labels where label_value = '1' group by cohort")
view("v_deviation_ranked", f"""
select cohort, signal_0_center, deviation_score, {share('deviation_score', 'cohort')} as cohort_pctile, {share('deviation_score')} as fleet_pctile, {rank('deviation_score', 'cohort')} as cohort_rank, {rank('deviation_score')} as fleet_rank from @baseline_deviation""")
view("v_first_deviation", "select cohort, min(signal_0_center) filter (where cohort_pctile > 0.90) as first_p90, min(signal_0_center) filter (where cohort_pctile > 0.95) as first_p95, min(signal_0_center) filter (where cohort_pctile > 0.99) as first_p99 from @v_deviation_ranked group by cohort")
view("v_detection_vs_truth", """
select f.cohort, f.fault_time, d.first_p90, d.first_p95, d.first_p99, f.fault_time - d.first_p95 as lead_time,
       case when d.first_p95 is null then 'missed' when d.first_p95 < f.fault_time then 'early' when d.first_p95 = f.fault_time then 'on_time' else 'late' end as outcome
from @v_fault_times f left join @v_first_deviation d on f.cohort = d.cohort""")
view("v_detection_outcome_summary", f"""
select count(*) as n_faults, {r('1.0 * count(*) filter (where lead_time > 0) / nullif(count(*), 0)')} as early_rate, {r('avg(lead_time)', 9)} as mean_lead, {r(quantile(0.5, 'lead_time'))} as median_lead from @v_detection_vs_truth""")
view("v_metric_aligned_to_fault", " union all ".join(f"select p.cohort, '{m}' as metric, p.signal_0_center - f.fault_time as t, p.{m} as score from @physics p join @v_fault_times f on p.cohort = f.cohort where p.{m} is not null" for m in ("energy_proxy", "coherence", "state_distance", "effective_dim", "eigenvalue_entropy", "condition_number")))
view("v_metric_baseline", f"select metric, {r(quantile(0.05, 'score'))} as p05, {r(quantile(0.95, 'score'))} as p95, count(*) as n from @v_metric_aligned_to_fault where t between -200 and -100 group by metric having count(*) > 10")
view("v_metric_first_deviation", """
select a.cohort, a.metric, min(a.t) as first_t from @v_metric_aligned_to_fault a join @v_metric_baseline b on a.metric = b.metric where a.t > -100 and a.score > b.p95 group by a.cohort, a.metric""")
view("v_metric_lead_times", "select cohort, metric, -first_t as lead_time, case when first_t < 0 then 'before' else 'after' end as outcome from @v_metric_first_deviation")
view("v_metric_performance", f"""
select l.metric, count(*) as n_detected, {r('1.0 * count(*) / max(f.n)')} as detection_rate, {r('avg(l.lead_time)', 9)} as mean_lead, {r('stddev_samp(l.lead_time)')} as std_lead
from @v_metric_lead_times l cross join (select count(*) as n from @v_fault_times) f where l.outcome = 'before' group by l.metric""")
view("v_threshold_candidates", f"""
select metric, k.step * 5 as pct, min(score) as threshold from (select metric, score, ntile(20) over (partition by metric order by score, cohort, t) as bin from @v_metric_aligned_to_fault) x
join (select #each(10, 12, 14, 16, 18, 19) as step) k on x.bin = k.step + 1 group by metric, k.step * 5""")
view("v_threshold_detection", """
select c.metric, c.pct, c.threshold, a.cohort, min(a.t) as first_t from @v_threshold_candidates c join @v_metric_aligned_to_fault a on c.metric = a.metric where a.score > c.threshold and a.t > -100 group by c.metric, c.pct, c.threshold, a.cohort""")
view("v_threshold_performance", f"""
select metric, pct, threshold, count(*) as n_fired, count(*) filter (where first_t < 0) as tp, {r('1.0 * count(*) filter (where first_t < 0) / max(n)')} as tp_rate, rank() over (partition by metric order by count(*) filter (where first_t < 0) desc, pct desc) as performance_rank
from @v_threshold_detection cross join (select count(*) as n from @v_fault_times) f group by metric, pct, threshold""")
view("v_optimal_threshold", "select metric, pct, threshold, tp_rate from @v_threshold_performance where performance_rank = 1")
view("v_threshold_curve", """
select metric, pct, tp, sum(tp) over (partition by metric order by pct desc rows between unbounded preceding and current row) as cumulative_tp from @v_threshold_performance""")
view("v_fault_type_labels", "select distinct cohort, case when label_name like '%life%' then 'wear' when label_name like '%leak%' then 'leak' else 'other' end as fault_type from @labels where label_value = '1'")
view("v_fault_type_signatures", f"""
select t.fault_type, l.metric, count(*) as n, {r('avg(l.lead_time)', 9)} as mean_lead, {r('count(*) * avg(l.lead_time)', 4)} as score from @v_metric_lead_times l join @v_fault_type_labels t on l.cohort = t.cohort where l.outcome = 'before' group by t.fault_type, l.metric having count(*) >= 3""")
view("v_best_detectors", "select fault_type, metric, score from (select fault_type, metric, score, row_number() over (partition by fault_type order by score desc, metric) as k from @v_fault_type_signatures) x where k <= 3")
view("v_fault_signature_matrix", f"select fault_type, metric, {r(div('score', 'max(score) over (partition by fault_type)'))} as normalized from @v_fault_type_signatures")
view("v_recommended_metrics", """
select category, #list(metric; ',') as metrics from (select 'best_detector' as category, metric from @v_best_detectors union all select 'high_detection', metric from @v_metric_performance where detection_rate >= 0.5
union all select 'long_lead', metric from @v_metric_performance where mean_lead > 50) x group by category""")

# --- feature relevance over windows ------------------------------------------------------------------------------
view("window_features", """
select cohort, signal_id, window_index, 'mean' as feature, mean as x from @signal_windows union all select cohort, signal_id, window_index, 'std', std from @signal_windows
union all select cohort, signal_id, window_index, 'rms', rms from @signal_windows union all select cohort, signal_id, window_index, 'slope', slope from @signal_windows
union all select cohort, signal_id, window_index, 'roughness', roughness from @signal_windows""")
view("v_feature_variance", f"select feature, {r(div('stddev_samp(x)', 'abs(avg(x))'), 4)} as cv, row_number() over (order by {r(div('stddev_samp(x)', 'abs(avg(x))'), 4)} desc nulls last, feature) as variance_rank from @window_features group by feature")
view("v_feature_temporal", f"""
select feature, {r('abs(avg(case when q = 5 then x end) - avg(case when q = 1 then x end))', 4)} as shift, row_number() over (order by {r('abs(avg(case when q = 5 then x end) - avg(case when q = 1 then x end))', 4)} desc, feature) as temporal_rank
from (select feature, x, ntile(5) over (partition by feature, cohort, signal_id order by window_index) as q from @window_features) y group by feature""")
view("v_feature_significance", f"""
select v.feature, v.variance_rank, t.temporal_rank, {r('(v.variance_rank + t.temporal_rank) / 2.0')} as mean_rank, case when (v.variance_rank + t.temporal_rank) / 2.0 <= 2 then 'high' else 'low' end as relevance from @v_feature_variance v join @v_feature_temporal t on v.feature = t.feature""")

# --- units, work orders, visualisation, summaries ----------------------------------------------------------------
view("fleet_zscores", f"""
-- fleet statistics by axis place, then z-scores against them
select o.cohort, o.signal_id, o.s0, {r(div('o.value - f.m', 'f.s'))} as z from @obs o join (select signal_id, s0, avg(value) as m, stddev_samp(value) as s from @obs group by signal_id, s0) f on o.signal_id = f.signal_id and o.s0 = f.s0""")
view("rolling_features", "select cohort, signal_id, s0, " + ", ".join(
    f"{r(f'{fn}(value) over ({K} order by s0 rows between {w - 1} preceding and current row)')} as {short}_{w}" for w in (5, 10, 20) for fn, short in (("avg", "mean"), ("stddev_samp", "std"), ("min", "min"), ("max", "max"))) + " from @obs")
view("remaining_life", f"""
-- remaining useful life, capped, and the first and second differences that models take beside it
select cohort, signal_id, s0, least(125, max(s0) over (partition by cohort) - s0) as rul, value, {r(f'value - lag(value) over ({K} order by s0)')} as delta, {r(f'value - 2 * lag(value) over ({K} order by s0) + lag(value, 2) over ({K} order by s0)')} as delta2 from @obs""")
view("checksums", "select cohort, signal_id, count(*) as n, cast(sum(cast(round(coalesce(value, 0) * 100, 0) as bigint) * (cast(s0 as bigint) % 1009 + 1)) as bigint) as checksum from @obs group by cohort, signal_id")
