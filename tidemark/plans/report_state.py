"""Reports 12 to 25 and the stage selects: brittleness, canaries, derivatives, ranks, trajectories, divergence, energy, topology, flow, summaries, incidents."""

from __future__ import annotations

from .dag import div, first_of, ladder, r, rank, view

K = "partition by cohort, signal_id"
C = "partition by cohort order by signal_0_center"


def trend(y: str, x: str = "signal_0_center") -> str:
    return div(f"covar_pop({y}, {x})", f"var_pop(case when {y} is not null then {x} end)")


def or_default(select: str, columns: str, default: str) -> str:
    """The rows of a select, or one row of `default` where there are none."""
    return f"with found as ({select}) select {columns} from found union all select {default} from (select count(*) as n from found) x where n = 0"


# --- 12, 13 ------------------------------------------------------------------------------------------------------
view("coupling_levels", f"select cohort, {r('avg(abs(correlation))', 6)} as avg_abs_corr, {ladder('avg(abs(correlation))', '>', (0.4, 'HIGHLY_COUPLED'), (0.25, 'MODERATELY_COUPLED'), other='LOOSELY_COUPLED')} as coupling_level from @signal_pairwise where correlation is not null group by cohort")
view("report_12_brittleness", f"""
select b.cohort, avg_brittleness, max_brittleness, avg_condition_number, avg_eigenvalue_gap, avg_temperature, avg_effective_dim, c.avg_abs_corr, c.coupling_level,
       {first_of(('avg_brittleness is null', 'NO_DATA'), ('c.avg_abs_corr < 0.05 and avg_brittleness > 50', 'DECOUPLED_SYSTEM'), ('avg_brittleness > 100', 'CRITICALLY_BRITTLE'), ('avg_brittleness > 30', 'ELEVATED'), other='HEALTHY')} as brittleness_interpretation
from (select cohort, {r('avg(brittleness_score)', 4)} as avg_brittleness, {r('max(brittleness_score)', 4)} as max_brittleness, {r('avg(condition_number)', 4)} as avg_condition_number, {r('avg(eigenvalue_gap)', 6)} as avg_eigenvalue_gap, {r('avg(temperature)', 6)} as avg_temperature, {r('avg(effective_dim)', 4)} as avg_effective_dim from @v_brittleness_gap group by cohort) b
left join @coupling_levels c on b.cohort = c.cohort""")
view("report_12_fleet_brittleness", f"select signal_0_center, {r('avg(brittleness_score)', 4)} as fleet_avg_brittleness, {r('max(brittleness_score)', 4)} as fleet_max_brittleness, count(*) as n_cohorts from @v_brittleness_gap group by signal_0_center")
view("report_13_frequent_canaries", f"select signal_id, count(*) as times_first_3_canary, {r('avg(first_departure_i)', 4)} as avg_onset, min(first_departure_i) as earliest_onset, max(first_departure_i) as latest_onset from @v_canary_sequence where canary_rank <= 3 group by signal_id")
view("report_13_canaries", "select cohort, signal_id, first_departure_i, departure_magnitude, canary_rank from @v_canary_sequence where canary_rank <= 5")
view("report_13_sole_leaders", f"""
select signal_id, count(*) as times_sole_leader, {r('avg(first_departure_i)', 4)} as avg_onset, min(first_departure_i) as earliest_onset, max(first_departure_i) as latest_onset from (select cohort, signal_id, first_departure_i, canary_rank, count(*) over (partition by cohort, first_departure_i) as n_there from @v_canary_sequence) x where canary_rank = 1 and n_there = 1 group by signal_id""")
_nth = lambda k, c="first_departure_i": f"min(case when canary_rank = {k} then {c} end)"
view("report_13_propagation", f"select cohort, {_nth(1)} as first_signal_i, {_nth(2)} as second_signal_i, {_nth(2)} - {_nth(1)} as propagation_delay from @v_canary_sequence group by cohort having {_nth(2)} > {_nth(1)}")

# --- 14 derivatives ----------------------------------------------------------------------------------------------
_dd = "from @derivative_stats s join @derivative_depth p on s.cohort = p.cohort and s.signal_id = p.signal_id join @derivative_ratios q on s.cohort = q.cohort and s.signal_id = q.signal_id left join @derivative_onset o on s.cohort = o.cohort and s.signal_id = o.signal_id left join @derivative_regions g on s.cohort = g.cohort and s.signal_id = g.signal_id"
view("report_14_depth_profile", f"select s.cohort, s.signal_id, p.depth, s.d1_snr, s.d2_snr, {first_of(('p.depth >= 4', 'DEEP'), ('p.depth = 3', 'MODERATE'), ('p.depth = 2', 'SHALLOW'), ('p.depth = 1', 'MINIMAL'), other='FLAT')} as depth_visual {_dd}")
view("report_14_velocity", f"select s.cohort, s.signal_id, s.d1_abs, s.d1_std, s.d1_snr, q.d1_late_early, {first_of(('q.d1_late_early > 2.0', 'ACCELERATING (late > 2x early)'), ('q.d1_late_early > 1.3', 'SPEEDING_UP'), ('q.d1_late_early >= 0.7', 'STEADY_RATE'), ('q.d1_late_early < 0.5', 'DECELERATING (late < 0.5x early)'), other='SLOWING_DOWN')} as velocity_trend {_dd}")
view("report_14_acceleration", f"select s.cohort, s.signal_id, s.d2_abs, s.d2_std, s.d2_snr, q.d2_late_early, o.onset_life, g.most_active, {first_of(('s.d2_snr < 1.0', 'D2_IS_NOISE (no curvature signal)'), ('s.d2_snr <= 3.0', 'WEAK_CURVATURE'), ('s.d2_snr <= 10.0', 'MODERATE_CURVATURE'), ('s.d2_snr > 10.0', 'STRONG_CURVATURE'), other='UNKNOWN')} as curvature_class {_dd}")
view("report_14_onset_detail", f"""
select s.cohort, s.signal_id, o.onset_life, g.most_active, q.d2_late_early, {first_of(('o.onset_life is null', 'STATIONARY (no onset)'), ('o.onset_life < 0.2', 'EARLY_ONSET'), ('o.onset_life < 0.4', 'EARLY_MID_ONSET'), ('o.onset_life < 0.6', 'MID_LIFE_ONSET'), ('o.onset_life < 0.8', 'LATE_ONSET'), other='VERY_LATE_ONSET')} as onset_interpretation,
       {first_of(("g.most_active = 'early'", 'Most curvature early (settling?)'), ("g.most_active = 'late'", 'Most curvature late (degradation?)'), other='Most curvature in the middle')} as region_reading {_dd}""")
_steady = lambda c: f"{c} between 0.8 and 1.2"
view("report_14_late_early_ratios", f"""
select s.cohort, s.signal_id, q.d1_late_early, q.d2_late_early, {first_of((f"{_steady('q.d1_late_early')} and {_steady('q.d2_late_early')}", 'STATIONARY'), ('q.d1_late_early > 1.5 and q.d2_late_early > 1.5', 'RUNAWAY'), ('q.d1_late_early > 1.5 and q.d2_late_early < 0.8', 'PLATEAUING'), ('q.d1_late_early < 0.5', 'STABILIZING'), other='MIXED')} as trajectory_assessment {_dd}""")
view("report_14_snr_hierarchy", f"select s.cohort, s.signal_id, s.d1_snr, s.d2_snr, repeat('|', cast(least(greatest(round(s.d1_snr * 10, 0), 0), 20) as integer)) as d1_bar, repeat('|', cast(least(greatest(round(s.d2_snr * 10, 0), 0), 20) as integer)) as d2_bar {_dd}")
view("report_14_similar_dynamics", f"""
select a.cohort, a.signal_id as signal_a, b.signal_id as signal_b, abs(a.depth - b.depth) as depth_diff, {r('abs(a.d1_snr - b.d1_snr)')} as d1_snr_diff, {r('abs(a.d2_snr - b.d2_snr)')} as d2_snr_diff, {first_of(('a.depth = b.depth and abs(a.d1_snr - b.d1_snr) < 2.0 and abs(a.d2_snr - b.d2_snr) < 2.0', 'SIMILAR_DYNAMICS'), ('abs(a.depth - b.depth) >= 3', 'VERY_DIFFERENT_DYNAMICS'), other='MODERATE_DIFFERENCE')} as dynamics_similarity
from @report_14_depth_profile a join @report_14_depth_profile b on a.cohort = b.cohort and a.signal_id < b.signal_id""")
_av = lambda c: f"{r(f'avg({c})', 6)} as avg_{c}"
view("report_14_geometry_derivatives", f"""
select cohort, {', '.join(_av(f'{m}_{d}') for m in ('effective_dim', 'eigenvalue_1', 'condition_number') for d in ('velocity', 'acceleration'))}, {first_of(('avg(eigenvalue_1_acceleration) > 0 and avg(condition_number_acceleration) > 0', 'RUNAWAY'), ('avg(eigenvalue_1_acceleration) > 0', 'CONCENTRATING'), ('avg(condition_number_acceleration) > 0', 'ILL_CONDITIONING'), other='STABLE_GEOMETRY')} as geometry_trajectory
from @v_geometry_dynamics where eigenvalue_1_velocity is not null group by cohort""")
view("report_14_windowing", f"""
select p.cohort, p.signal_id, p.depth, o.onset_life, t.memory, {first_of(('o.onset_life is null and p.depth >= 3', 'GLOBAL_CACHE'), ('o.onset_life >= 0.4', 'SPLIT_CACHE'), ('o.onset_life < 0.4', 'PERIODIC_CACHE'), ('p.depth <= 1', 'MINIMAL_COMPUTE'), other='DEFAULT')} as cache_recommendation,
       {first_of(('p.depth >= 4', 'Full FTLE + Lyapunov'), ('p.depth = 3', 'FTLE sufficient, skip Lyapunov spectrum'), ('p.depth = 2', 'Trend analysis + basic FTLE'), other='Trend analysis only')} as compute_recommendation
from @derivative_depth p left join @derivative_onset o on p.cohort = o.cohort and p.signal_id = o.signal_id left join @typology t on p.cohort = t.cohort and p.signal_id = t.signal_id""")
for _name, _v, _short, _m in (("report_14_top_curvature", "v_geometry_curvature", "", "effective_dim"), ("report_14_top_eig1_curvature", "v_eigenvalue_1_curvature", "eig1_", "eigenvalue_1"), ("report_14_top_cond_curvature", "v_condition_number_curvature", "cond_", "condition_number")):
    view(_name, f"select cohort, signal_0_center, {_m}, {_m}_velocity, {_m}_acceleration, {_short}curvature_magnitude, {_short}curvature_rank from @{_v} where {_short}curvature_rank <= 3 order by {_short}curvature_magnitude desc, cohort, signal_0_center limit 30")

# --- 15, 16, 17 --------------------------------------------------------------------------------------------------
view("report_15_fast_geometry", "select cohort, signal_0_center, effective_dim, effective_dim_velocity, effective_dim_acceleration, condition_number, condition_number_velocity, condition_number_acceleration, velocity_rank, fleet_velocity_rank from @v_geometry_ranked where fleet_velocity_rank <= 5 order by velocity_magnitude desc nulls last, cohort, signal_0_center limit 30")
view("report_15_eigenvalue_velocity", "select cohort, signal_0_center, eigenvalue_1, eigenvalue_1_velocity, eigenvalue_1_acceleration, eig1_velocity_rank, eig1_fleet_velocity_rank from @v_geometry_ranked where eigenvalue_1_velocity is not null and (eig1_velocity_rank <= 2 or eig1_fleet_velocity_rank <= 5) order by eig1_fleet_velocity_rank, eig1_velocity_rank, cohort, signal_0_center limit 30")
view("report_16_coupling_changes", "select cohort, signal_a, signal_b, signal_0_end, correlation, coupling_delta, coupling_rank from @v_coupling_ranked where coupling_delta is not null and not is_sign_flip order by abs(coupling_delta) desc, cohort, signal_a, signal_b, signal_0_end limit 30")
view("report_16_sign_flips", "select signal_a, signal_b, count(*) as n_sign_flips, count(distinct cohort) as n_cohorts_affected from @v_coupling_ranked where is_sign_flip group by signal_a, signal_b order by n_sign_flips desc, signal_a, signal_b limit 20")
_pct = r("100.0 * count(*) / sum(count(*)) over ()", 1)
view("report_17_trajectory_counts", f"select trajectory_type, count(*) as n_cohorts, {_pct} as pct, {r('avg(dim_delta)', 6)} as avg_delta, min(dim_delta) as min_delta, max(dim_delta) as max_delta, {r('avg(early_dim)', 6)} as avg_early_dim, {r('avg(late_dim)', 6)} as avg_late_dim from @v_dimension_trajectory group by trajectory_type")
view("report_17_trajectories", "select cohort, n_windows, early_dim, late_dim, dim_delta, trajectory_type, change_rank from @v_dimension_trajectory")
view("report_17_canaries", f"select t.trajectory_type, c.signal_id, count(*) as times_canary, {r('avg(c.first_departure_i)', 4)} as avg_onset from @v_dimension_trajectory t join @v_canary_sequence c on t.cohort = c.cohort where c.canary_rank = 1 group by t.trajectory_type, c.signal_id")
view("report_17_brittleness", f"select t.trajectory_type, count(distinct t.cohort) as n_cohorts, {r('avg(b.avg_brittleness)', 6)} as avg_brittleness, {r('avg(b.avg_condition_number)', 6)} as avg_cond_number, {r('avg(b.avg_eigenvalue_gap)', 8)} as avg_eig_gap, {r('avg(b.avg_temperature)', 8)} as avg_temperature from @v_dimension_trajectory t left join @report_12_brittleness b on t.cohort = b.cohort group by t.trajectory_type")
for _name, _v, _label, _d, _e in (("eigenvalue", "v_eigenvalue_1_trajectory", "eigenvalue_trajectory", "eigenvalue_delta", "eigenvalue"), ("condition", "v_condition_number_trajectory", "condition_trajectory", "cond_delta", "cond")):
    view(f"report_17_{_name}_counts", f"select {_label}, count(*) as n_cohorts, {_pct} as pct, {r(f'avg({_d})', 6)} as avg_delta, {r(f'avg(early_{_e})', 6)} as avg_early, {r(f'avg(late_{_e})', 6)} as avg_late from @{_v} group by {_label}")
    view(f"report_17_{_name}_trajectories", f"select cohort, n_windows, early_{_e}, late_{_e}, {_d}, {_label} from @{_v}")

# --- 18, 19 ------------------------------------------------------------------------------------------------------
_CHAOS = (0.05, "CHAOTIC"), (0.01, "WEAKLY_CHAOTIC"), (-0.01, "MARGINAL")
view("ftle_both_ways", f"""
-- growth of successive differences taken backward in time is the inverse of that forward, so its exponent is the negative
select cohort, signal_id, ftle, -ftle as ftle_backward, ftle_std, n_samples from @ftle_summary""")
view("report_18_global", f"""
select cohort, signal_id, ftle as ftle_forward, ftle_backward, n_samples, case when n_samples < 1000 then 'INSUFFICIENT_DATA' else {ladder('ftle', '>', *_CHAOS, other='STABLE')} end as dynamics_class,
       {first_of(('n_samples < 1000', 'UNKNOWN'), ('ftle > 0 and ftle_backward < 0', 'ATTRACTOR_WITH_SENSITIVITY'), ('ftle > 0 and ftle_backward > 0', 'FULLY_UNSTABLE'), ('ftle < 0 and ftle_backward < 0', 'STRONGLY_STABLE'), other='MIXED')} as stability_type from @ftle_both_ways""")
view("report_18_exponents", f"select cohort, signal_id, ftle as lyapunov_exponent, n_samples, {first_of(('n_samples < 1000', 'INSUFFICIENT_DATA'), ('ftle > 0.05', 'POSITIVE: chaotic'), ('ftle > 0', 'WEAKLY_POSITIVE: edge of chaos'), ('ftle > -0.05', 'NEAR_ZERO: marginal stability'), other='NEGATIVE: stable')} as interpretation from @ftle_summary")
view("report_18_rolling", f"select cohort, signal_id, {r('avg(ftle)')} as mean_ftle, max(ftle) as max_ftle, min(ftle) as min_ftle, {r('stddev_pop(ftle)')} as ftle_std, {r(trend('ftle'), 8)} as ftle_trend_slope, count(*) as n_windows, {first_of((f'{trend("ftle")} > 0.0001', 'DESTABILIZING'), (f'{trend("ftle")} < -0.0001', 'STABILIZING'), other='STATIONARY')} as ftle_trend from @ftle_rolling group by cohort, signal_id")
view("report_18_ridge", f"select cohort, signal_id, ftle_current, ftle_gradient, speed as state_speed, urgency, time_to_ridge, {first_of(('time_to_ridge < 50', 'IMMINENT'), ('time_to_ridge < 200', 'APPROACHING'), ('ftle_gradient > 0', 'DIVERGING_SLOWLY'), other='DISTANT')} as ridge_status from (select *, row_number() over ({K} order by signal_0_center desc) as k from @ridge_proximity) x where k = 1")
view("report_18_early_late", f"""
select cohort, signal_id, {r('early')} as early_ftle, {r('late')} as late_ftle, {r('late - early')} as ftle_shift, {first_of(('late - early > 0.02', 'DESTABILIZED'), ('late - early < -0.02', 'STABILIZED'), other='UNCHANGED')} as ftle_evolution
from (select cohort, signal_id, avg(ftle) filter (where signal_0_center <= lo + (hi - lo) * 0.3) as early, avg(ftle) filter (where signal_0_center >= hi - (hi - lo) * 0.3) as late from (select *, min(signal_0_center) over ({K}) as lo, max(signal_0_center) over ({K}) as hi from @ftle_rolling) x group by cohort, signal_id) y where early is not null and late is not null""")
view("report_19_thermal_state", f"select cohort, entropy, energy, temperature, free_energy, heat_capacity, n_windows, {ladder('temperature', '<', (0.01, 'FROZEN'), (0.1, 'COLD'), (1.0, 'WARM'), other='HOT')} as thermal_state, {ladder(div('free_energy', 'energy'), '>', (0.9, 'HIGH_ORDER'), (0.5, 'MODERATE_ORDER'), other='DISORDERED')} as order_level from @thermodynamics")
view("report_19_energy_trajectory", f"select cohort, {r('avg(total_variance)')} as avg_energy, {r('stddev_pop(total_variance)')} as energy_std, {r('avg(variance_velocity)')} as avg_energy_velocity, {r('avg(total_variance / nullif(effective_dim, 0))')} as avg_temperature, {r(trend('total_variance'), 8)} as energy_trend, count(*) as n_windows, {first_of((f'{trend("total_variance")} > 0.001', 'HEATING'), (f'{trend("total_variance")} < -0.001', 'COOLING'), other='THERMAL_EQUILIBRIUM')} as thermal_trend from @v_geometry_dynamics group by cohort")
_en = "eigenvalue_entropy_normalized"
view("report_19_entropy", f"select cohort, {r(f'avg({_en})')} as avg_entropy_norm, min({_en}) as min_entropy, max({_en}) as max_entropy, {r(f'stddev_pop({_en})')} as entropy_std, {r(trend(_en), 8)} as entropy_trend, count(*) as n_windows, {first_of((f'{trend(_en)} > 0.0001', 'INCREASING_DISORDER'), (f'{trend(_en)} < -0.0001', 'INCREASING_ORDER'), other='ENTROPY_STABLE')} as entropy_trend_label from @state_geometry group by cohort")
view("report_19_phase_transitions", "select cohort, signal_0_center, effective_dim, effective_dim_velocity, effective_dim_acceleration from (select *, stddev_pop(effective_dim_acceleration) over (partition by cohort) as spread from @v_geometry_dynamics where effective_dim_velocity is not null) x where abs(effective_dim_acceleration) > 3 * spread order by cohort, signal_0_center limit 30")

# --- 20, 21 ------------------------------------------------------------------------------------------------------
view("reach_1", "select cohort, window_index, signal_a as x, signal_b as y from @network_edges union all select cohort, window_index, signal_b, signal_a from @network_edges union all select distinct cohort, window_index, s, s from (select cohort, window_index, signal_a as s from @signal_pairwise union all select cohort, window_index, signal_b from @signal_pairwise) z")
for _k in (2, 4, 8):
    view(f"reach_{_k}", f"select distinct a.cohort, a.window_index, a.x, b.y from @reach_{_k // 2} a join @reach_{_k // 2} b on a.cohort = b.cohort and a.window_index = b.window_index and a.y = b.x")
view("loops", """
-- components and independent loops of each window's network; reachability over up to eight edges, by doubling
select t.cohort, t.signal_0_end, t.n_signals, t.n_edges, c.betti_0, t.n_edges - t.n_signals + c.betti_0 as betti_1 from @v_topology t
join (select cohort, window_index, count(distinct root) as betti_0 from (select cohort, window_index, x, min(y) as root from @reach_8 group by cohort, window_index, x) m group by cohort, window_index) c on t.cohort = c.cohort and cast(floor(t.signal_0_end / 25) as bigint) = c.window_index""")
view("report_20_features", f"select cohort, {r('avg(betti_0)', 4)} as avg_betti_0, {r('avg(betti_1)', 4)} as avg_betti_1, max(betti_0) as max_betti_0, max(betti_1) as max_betti_1, {r('avg(n_signals)', 4)} as avg_n_points, count(*) as n_windows, {ladder('avg(betti_1)', '>', (1.0, 'MULTI_LOOP'), (0.5, 'LOOP_PRESENT'), (0.1, 'OCCASIONAL_LOOP'), other='NO_LOOPS')} as topology_class from @loops group by cohort")
_bt = trend("betti_1", "signal_0_end")
view("report_20_evolution", f"select cohort, {r(trend('betti_0', 'signal_0_end'), 8)} as betti_0_trend, {r(_bt, 8)} as betti_1_trend, count(*) filter (where d > 0) as windows_gaining_loops, count(*) filter (where d < 0) as windows_losing_loops, count(*) as n_windows, {first_of((f'{_bt} > 0.0001', 'GAINING_COMPLEXITY'), (f'{_bt} < -0.0001', 'LOSING_COMPLEXITY'), other='STABLE_TOPOLOGY')} as topology_trend from (select *, betti_1 - lag(betti_1) over (partition by cohort order by signal_0_end) as d from @loops) x group by cohort")
view("report_20_loops", "select cohort, signal_0_end, betti_0, betti_1, case when betti_1 > 1 then 'ROBUST_LOOP' else 'WEAK_LOOP' end as loop_quality from @loops where betti_1 > 0 order by betti_1 desc, cohort, signal_0_end limit 30")
_half = lambda c, part, where: f"avg({c}) filter (where signal_0_end {where}) as {part}_{c}"
view("report_20_early_late", f"""
select cohort, {', '.join(f'{r(f"{p}_{c}", 4)} as {p}_{c}' for p in ('early', 'late') for c in ('betti_0', 'betti_1'))}, {first_of(('late_betti_1 - early_betti_1 > 0.5', 'TOPOLOGY_COMPLEXIFIED'), ('late_betti_1 - early_betti_1 < -0.5', 'TOPOLOGY_SIMPLIFIED'), other='TOPOLOGY_UNCHANGED')} as topology_change
from (select cohort, {', '.join(_half(c, p, w) for c in ('betti_0', 'betti_1') for p, w in (('early', '<= lo + (hi - lo) * 0.3'), ('late', '>= hi - (hi - lo) * 0.3')))} from (select *, min(signal_0_end) over (partition by cohort) as lo, max(signal_0_end) over (partition by cohort) as hi from @loops) x group by cohort) y""")
_ab, _ba = "granger_p_a_to_b < 0.05", "granger_p_b_to_a < 0.05"
_net = "(transfer_entropy_a_to_b - transfer_entropy_b_to_a)"
view("report_21_pairwise_flow", f"""
select cohort, signal_a, signal_b, granger_f_a_to_b, granger_f_b_to_a, granger_p_a_to_b, granger_p_b_to_a, transfer_entropy_a_to_b, transfer_entropy_b_to_a, {r(_net)} as net_te, {first_of((f'{_ab} and {_ba}', 'BIDIRECTIONAL'), (_ab, 'A_DRIVES_B'), (_ba, 'B_DRIVES_A'), other='INDEPENDENT')} as causal_direction,
       case when {_ab} and {_ba} and abs({_net}) < 0.005 then 'SYMMETRIC_FEEDBACK' when {_ab} and {_ba} then 'ASYMMETRIC_FEEDBACK' end as feedback_type from @information_flow""")
view("flow_edges", f"select cohort, signal_a as source, signal_b as target, granger_f_a_to_b as f, transfer_entropy_a_to_b as te from @information_flow where {_ab} union all select cohort, signal_b, signal_a, granger_f_b_to_a, transfer_entropy_b_to_a from @information_flow where {_ba}")
view("report_21_drivers", f"select cohort, source as signal_id, count(*) as n_targets_driven, {r('avg(f)', 6)} as avg_granger_f, {r('avg(te)', 8)} as avg_transfer_entropy, #list(target; ', ') as driven_signals from @flow_edges group by cohort, source")
view("report_21_chains", f"select a.cohort, a.source as origin, a.target as intermediate, b.target as endpoint, a.f as f_step1, b.f as f_step2, {r('least(a.te, b.te)')} as bottleneck_te from @flow_edges a join @flow_edges b on a.cohort = b.cohort and a.target = b.source and a.source <> b.target order by least(a.f, b.f) desc, a.cohort, a.source, a.target, b.target limit 20")
view("report_21_distances", f"select cohort, signal_a, signal_b, kl_a_b, kl_b_a, js, {ladder('js', '<', (0.01, 'NEAR_IDENTICAL'), (0.1, 'SIMILAR'), (0.5, 'DIFFERENT'), other='HIGHLY_DIVERGENT')} as distributional_similarity, {r('abs(kl_a_b - kl_b_a)')} as kl_asymmetry from @signal_divergence")

# --- 22 executive summary ------------------------------------------------------------------------------------------
view("report_22_overview", "select o.n_signals, o.n_entities as n_cohorts, o.n_observations, o.index_start, o.index_end, o.index_span, g.n_geometry_windows from @v_dataset_overview o cross join (select count(*) as n_geometry_windows from @state_geometry) g")
view("report_22_health_scorecard", f"""
select g.cohort, g.avg_eff_dim, g.avg_cond_num, g.avg_energy, g.n_windows, b.avg_brittleness, b.coupling_level, d.departure_assessment, d.current_severity, d.pct_abnormal, d.most_common_deviation_source, t.trajectory_type, h.thermal_trend,
       {first_of(("b.avg_brittleness > 100 or d.departure_assessment = 'departed'", 'CRITICAL'), ("b.avg_brittleness > 30 or d.departure_assessment = 'unstable'", 'WARNING'), ("t.trajectory_type = 'COLLAPSING'", 'WATCH'), other='HEALTHY')} as health_status
from (select cohort, {r('avg(effective_dim)', 6)} as avg_eff_dim, {r('avg(condition_number)', 6)} as avg_cond_num, {r('avg(total_variance)', 6)} as avg_energy, count(*) as n_windows from @state_geometry group by cohort) g left join @report_12_brittleness b on g.cohort = b.cohort left join @v_deviation_entity_summary d on g.cohort = d.cohort
left join @v_dimension_trajectory t on g.cohort = t.cohort left join @report_19_energy_trajectory h on g.cohort = h.cohort""")
view("report_22_top_alerts", """
select cohort, alert_type, priority, detail from (
  select cohort, 'BRITTLENESS' as alert_type, case when avg_brittleness > 100 then 1 else 2 end as priority, brittleness_interpretation as detail from @report_12_brittleness where avg_brittleness > 30
  union all select cohort, 'DEPARTURE', case departure_assessment when 'departed' then 1 when 'unstable' then 2 else 3 end, departure_assessment from @v_deviation_entity_summary where departure_assessment in ('departed', 'unstable')
  union all select cohort, concat('DIM_', trajectory_type), 2, trajectory_type from @v_dimension_trajectory where trajectory_type <> 'STABLE'
  union all select cohort, 'ENERGY', 3, thermal_trend from @report_19_energy_trajectory where thermal_trend <> 'THERMAL_EQUILIBRIUM') x order by priority, cohort, alert_type limit 30""")
view("report_22_derivative_coverage", " union all ".join(f"select '{m}' as metric, count(distinct cohort) as n_cohorts, count({m}_velocity) as n_d1, count({m}_acceleration) as n_d2 from @v_geometry_dynamics" for m in ("effective_dim", "eigenvalue_1", "condition_number")))
view("report_22_signal_dynamics", f"select cohort, signal_id, ftle, n_samples, {ladder('ftle', '>', *_CHAOS, other='STABLE')} as dynamics_class from @ftle_summary")
view("report_22_canaries", "select cohort, signal_id, canary_rank, first_departure_i as onset, first_departure_i - min(first_departure_i) over (partition by cohort) as delay_from_first, departure_magnitude from @v_canary_sequence where canary_rank <= 3 order by cohort, canary_rank limit 20")

# --- 24 incidents --------------------------------------------------------------------------------------------------
view("report_24_snapshot", "select n_signals, n_cohorts, n_observations, index_span as signal_0_range, n_geometry_windows from @report_22_overview")
view("report_24_typology_card", "select cohort, signal_id, continuity, memory_class, trend, complexity_class from @typology_enriched")
_as = lambda *v: " + ".join(f"count(*) filter (where departure_assessment = '{x}')" for x in v)
view("report_24_system_status", f"""
select {first_of((f"{_as('departed')} > 0", 'DEPARTED'), (f"{_as('unstable')} > 0", 'SHIFTED'), ("count(*) filter (where departure_assessment = 'insufficient_baseline' and pct_abnormal > 50) > 0", 'DEPARTED (insufficient baseline)'), (f"{_as('insufficient_baseline')} > 0", 'INSUFFICIENT_BASELINE'), other='STABLE')} as system_status,
       {_as('stable')} as cohorts_stable, {_as('noisy', 'unstable')} as cohorts_watch, {_as('departed', 'insufficient_baseline')} as cohorts_departed from @v_deviation_entity_summary""")
view("report_24_dynamics", "select g.cohort, g.signal_id, g.ftle_forward, g.dynamics_class, g.stability_type, w.ftle_trend from @report_18_global g left join @report_18_rolling w on g.cohort = w.cohort and g.signal_id = w.signal_id")
view("report_24_drift_incidents", or_default(f"""select cohort, signal_id, {first_of(('up = n_windows', 'PERSISTENT_ACCELERATION'), ('down = n_windows', 'PERSISTENT_DECELERATION'), other='PERSISTENT_DRIFT')} as drift_status, {r('mean_slope', 9)} as avg_slope from @persistence where greatest(up, down) >= n_windows - 1""", "cohort, signal_id, drift_status, avg_slope", "null, null, 'NO_DRIFT_DETECTED', null"))
view("report_24_first_movers", or_default("select cohort, signal_id, canary_rank, first_departure_i as onset, first_departure_i - min(first_departure_i) over (partition by cohort) as delay_from_first, departure_magnitude from @v_canary_sequence where canary_rank <= 5", "cohort, signal_id, canary_rank, onset, delay_from_first, departure_magnitude", "null, 'NONE_DEPARTED', null, null, null, null"))
view("report_24_propagation_speed", f"select cohort, {_nth(1, 'signal_id')} as first_signal, {_nth(2, 'signal_id')} as second_signal, {_nth(1)} as first_signal_i, {_nth(2)} as second_signal_i, {_nth(2)} - {_nth(1)} as propagation_delay from @v_canary_sequence where canary_rank <= 2 group by cohort having {_nth(2)} is not null")
view("report_24_brittleness", f"select cohort, avg_brittleness, max_brittleness, avg_effective_dim, avg_condition_number, avg_temperature, {ladder('avg_brittleness', '>', (100, 'CRITICALLY_BRITTLE'), (30, 'ELEVATED'), (10, 'MODERATE'), other='HEALTHY')} as brittleness_status from @report_12_brittleness")
view("report_24_dimension", "select cohort, early_dim, late_dim, dim_delta, trajectory_type from @v_dimension_trajectory")
view("report_24_coupling_events", or_default("select cohort, signal_a, signal_b, signal_0_end, correlation, coupling_delta, case when abs(coupling_delta) > 0.5 then 'MAJOR_DECOUPLING' else 'MODERATE_SHIFT' end as event_severity from @v_coupling_ranked where not is_sign_flip and abs(coupling_delta) > 0.3 order by abs(coupling_delta) desc, cohort, signal_a, signal_b, signal_0_end limit 10",
     "cohort, signal_a, signal_b, signal_0_end, correlation, coupling_delta, event_severity", "null, null, null, null, null, null, 'NONE_DETECTED'"))
view("report_24_hunting", or_default("select cohort, signal_id, reversal_rate, avg_excursion, hunting_severity from @report_05_hunting", "cohort, signal_id, reversal_rate, avg_excursion, hunting_severity", "null, null, null, null, 'NONE_DETECTED'"))
view("report_24_energy", f"""
select cohort, {r('gain', 6)} as energy_injected, {r('loss', 6)} as energy_dissipated, {r('gain - loss', 6)} as net_energy_change, {r('loss - gain', 6)} as energy_gap, {first_of(('abs(loss - gain) < 0.1 * (loss + gain)', 'BALANCED'), ('loss > gain', 'DISSIPATING'), other='ACCUMULATING')} as energy_status
from (select cohort, sum(greatest(energy_velocity, 0)) as gain, sum(greatest(-energy_velocity, 0)) as loss from @physics where energy_velocity is not null group by cohort) x""")
view("report_24_thermal", "select e.cohort, e.avg_temperature, e.thermal_trend, s.entropy_trend_label from @report_19_energy_trajectory e left join @report_19_entropy s on e.cohort = s.cohort")
view("report_24_topology", "select cohort, early_betti_0, late_betti_0, early_betti_1, late_betti_1, topology_change from @report_20_early_late")
view("report_24_baseline_quality", f"select count(*) as total_cohorts, count(*) filter (where n_baseline_points >= 50) as valid_baselines, {r('100.0 * count(*) filter (where n_baseline_points >= 50) / nullif(count(*), 0)', 1)} as pct_valid, {first_of(('min(n_baseline_points) >= 50', 'GOOD'), ('min(n_baseline_points) >= 20', 'ADEQUATE'), other='POOR')} as baseline_quality from @baselines")
view("report_24_fleet", f"select n as fleet_size, {first_of(('n >= 10', 'LARGE'), ('n >= 3', 'MODERATE'), ('n > 1', 'SMALL'), other='MINIMAL')} as fleet_validity, {first_of(('n >= 10', 'Fleet-relative percentiles are reliable'), ('n >= 3', 'Fleet percentiles should be interpreted with caution'), ('n > 1', 'Limited fleet comparison available'), other='No fleet comparison: self-referential baselines only')} as recommendation from (select count(distinct cohort) as n from @obs) x")
view("report_24_information_flow", f"select * from (select cohort, signal_a, signal_b, transfer_entropy_a_to_b, transfer_entropy_b_to_a, net_te, causal_direction, feedback_type, {rank('abs(net_te)', 'cohort')} as flow_rank from @report_21_pairwise_flow) x where flow_rank <= 3")

# --- 25 feature relevance ------------------------------------------------------------------------------------------
view("report_25_variance", "select variance_rank, feature, cv from @v_feature_variance order by variance_rank limit 50")
view("report_25_temporal", "select temporal_rank, feature, shift from @v_feature_temporal order by temporal_rank limit 50")
view("report_25_dominant_modes", f"""
-- the three features of the geometry: how much of their variance each mode has, over all windows
select mode, {r('100.0 * avg(part)', 4)} as pct_variance, count(*) as n_windows from (select 'PC1' as mode, eigenvalue_0 / total_variance as part from @state_geometry union all select 'PC2', eigenvalue_1 / total_variance from @state_geometry union all select 'PC3', eigenvalue_2 / total_variance from @state_geometry) x group by mode""")
view("report_25_significance", "select feature, variance_rank, temporal_rank, mean_rank, relevance, row_number() over (order by mean_rank, feature) as overall_rank from @v_feature_significance")
view("report_25_pointers", "select s.feature, s.overall_rank, s.relevance, m.detailed_in from @report_25_significance s join (select * from (values ('mean', 'reports 02 and 03'), ('std', 'reports 02 and 12'), ('rms', 'report 05'), ('slope', 'reports 03 and 17'), ('roughness', 'reports 14 and 18')) as t(feature, detailed_in)) m on s.feature = m.feature")

# --- stages --------------------------------------------------------------------------------------------------------
for _n, _c in (("temporal", "trend"), ("spectral", "spectral_class"), ("memory", "memory_class")):
    view(f"stage_01_{_n}_counts", f"select {_c}, count(*) as n, {_pct} as pct from @typology_enriched group by {_c}")
view("stage_01_typology", "select cohort, signal_id, trend, spectral_class, memory_class, complexity_class, continuity, variance_class, shape, tails from @typology_enriched")
view("stage_01_temporal_by_spectral", "select trend, spectral_class, count(*) as n from @typology_enriched group by trend, spectral_class order by n desc, trend, spectral_class limit 20")
view("stage_01_dual_classes", "select trend, direction, memory_class, count(*) as n from @typology_enriched where direction is not null group by trend, direction, memory_class")
view("stage_02_summary", "select signal_id, count(*) as n_windows, min(signal_0_center) as first_window, max(signal_0_center) as last_window from @signal_features group by signal_id")
view("stage_02_feature_means", f"select signal_id, {r('avg(kurtosis)', 9)} as avg_kurtosis, {r('avg(skewness)', 9)} as avg_skewness, {r('avg(crest_factor)', 9)} as avg_crest_factor from @signal_features group by signal_id")
view("stage_02_recent", f"select cohort, signal_id, signal_0_center, kurtosis, skewness, crest_factor, hurst from (select *, row_number() over ({K} order by signal_0_center desc) as k from @signal_features) x where k <= 10")
view("stage_02_high_kurtosis", "select cohort, signal_id, signal_0_center, kurtosis, skewness, crest_factor from @signal_features where kurtosis > 10 order by kurtosis desc, cohort, signal_id, signal_0_center limit 50")
view("stage_02_sample", "select * from @signal_features order by cohort, signal_id, window_index limit 100")
view("stage_03_summary", "select cohort, count(*) as n_windows, min(signal_0_center) as first_window, max(signal_0_center) as last_window from @state_vector group by cohort")
for _n, _o, _k in (("overview", "", 5), ("recent", "desc", 10)):
    view(f"stage_03_{_n}", f"select cohort, signal_0_center, dispersion_mean, dispersion_max, dispersion_std from (select *, row_number() over (partition by cohort order by signal_0_center {_o}) as k from @state_vector) x where k <= {_k}")
view("stage_04_summary", f"select cohort, count(*) as n_windows, {r('avg(effective_dim)')} as avg_eff_dim, min(effective_dim) as min_eff_dim, max(effective_dim) as max_eff_dim, {r('stddev_samp(effective_dim)')} as std_eff_dim from @state_geometry group by cohort")
view("stage_04_trajectory", f"select cohort, signal_0_center, effective_dim, lag(effective_dim) over ({C}) as prev_eff_dim, {r(f'effective_dim - lag(effective_dim) over ({C})', 9)} as eff_dim_change from @state_geometry")
view("stage_04_collapses", "select cohort, signal_0_center, effective_dim, prev_eff_dim, eff_dim_change from @stage_04_trajectory where effective_dim < prev_eff_dim * 0.8 order by eff_dim_change, cohort, signal_0_center limit 50")
view("stage_04_recent", f"select cohort, signal_0_center, effective_dim, condition_number, total_variance from (select *, row_number() over (partition by cohort order by signal_0_center desc) as k from @state_geometry) x where k <= 20")
view("stage_04_eigenvalues", "select cohort, signal_0_center, effective_dim, eigenvalue_0, eigenvalue_1, eigenvalue_2 from @state_geometry order by cohort, signal_0_center limit 100")
view("dynamics", f"""
-- of a cohort's windows of 50 places: the fastest growth over its signals, the share of steps that recur within a tenth of the signal's deviation, and of those that do so twice in a row
select f.cohort, f.window_index, f.signal_0_center, f.lyapunov_max, q.recurrence_rate, q.determinism from (select cohort, cast(floor(signal_0_center / 50) as bigint) as window_index, {r('avg(signal_0_center)')} as signal_0_center, max(ftle) as lyapunov_max from @ftle_rolling group by cohort, cast(floor(signal_0_center / 50) as bigint)) f
left join (select cohort, cast(floor(s0 / 50) as bigint) as window_index, {r('avg(case when near then 1.0 else 0.0 end)')} as recurrence_rate, {r(div('1.0 * count(*) filter (where near and before)', 'count(*) filter (where near)'))} as determinism
           from (select cohort, s0, near, lag(near) over ({K} order by s0) as before from (select cohort, signal_id, s0, coalesce(abs(x - prv) <= 0.1 * dev, false) as near from @centred) a) b group by cohort, cast(floor(s0 / 50) as bigint)) q on f.cohort = q.cohort and f.window_index = q.window_index""")
view("stage_05_summary", f"select cohort, count(*) as n_windows, {r('avg(lyapunov_max)', 9)} as avg_lyapunov, {r('avg(determinism)', 9)} as avg_determinism, {r('avg(recurrence_rate)', 9)} as avg_recurrence from @dynamics group by cohort")
view("stage_05_chaos", f"select cohort, signal_0_center, lyapunov_max, determinism, recurrence_rate, {ladder('lyapunov_max', '>', (0.1, 'CHAOTIC'), (0.01, 'QUASI_PERIODIC'), (-0.01, 'OSCILLATING'), (-0.1, 'CONVERGING'), other='STABLE')} as trajectory_type from @dynamics order by lyapunov_max desc, cohort, signal_0_center limit 100")
view("stage_05_stability", f"select cohort, signal_0_center, lyapunov_max, determinism, {r('coalesce(determinism, 0) - coalesce(lyapunov_max, 0)')} as stability_score from @dynamics order by stability_score desc, cohort, signal_0_center limit 100")
view("stage_05_recurrence", "select cohort, signal_0_center, recurrence_rate, determinism from @dynamics where recurrence_rate is not null")
view("stage_05_transitions", f"select cohort, signal_0_center, lyapunov_max, prev_lyapunov, {r('lyapunov_max - prev_lyapunov', 9)} as lyapunov_change from (select *, lag(lyapunov_max) over ({C}) as prev_lyapunov from @dynamics) x where abs(lyapunov_max - prev_lyapunov) > 0.1 order by abs(lyapunov_max - prev_lyapunov) desc, cohort, signal_0_center limit 50")
view("stage_05_recent", f"select cohort, signal_0_center, lyapunov_max, recurrence_rate, determinism from (select *, row_number() over (partition by cohort order by signal_0_center desc) as k from @dynamics) x where k <= 20")
