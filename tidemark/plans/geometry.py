"""Geometry of a cohort's signals from window to window, its dynamics, rankings and classes.

The base tables are relational forms of the numeric kernels, exact for what they cover: `cohort_geometry` decomposes the
correlation of three features (window mean, deviation, slope) over the signals of a window in closed form, with jackknife
bounds; `velocity_field` follows the vector of window means; `breaks` are cumulative-sum breaks by block; `ftle_rolling`
is the growth of successive differences. `dag.run(..., given=...)` puts a kernel's own output in their place.

Fleet-wide ranks order one row a window or a break, not observations.
"""

from __future__ import annotations

from .dag import corr, div, first_of, ladder, quantile, r, rank, share, view

C = "partition by cohort order by signal_0_center"
K = "partition by cohort, signal_id"

# --- cohort vectors ----------------------------------------------------------------------------------------------
view("vector_parts", """
select cohort, window_index, signal_id, signal_0_start, signal_0_end, signal_0_center, mean, std, slope,
       mean - avg(mean) over (partition by cohort, window_index) as dm, std - avg(std) over (partition by cohort, window_index) as ds, slope - avg(slope) over (partition by cohort, window_index) as dl
from @signal_windows where std is not null and slope is not null""")
view("cohort_vector", f"""
select cohort, window_index, count(*) as n_signals, {r('avg(signal_0_center)', 9)} as signal_0_center, {r('avg(mean)', 9)} as centroid_mean, {r('avg(std)', 9)} as centroid_std, {r('avg(slope)', 9)} as centroid_slope,
       {r('avg(sqrt(dm * dm + ds * ds + dl * dl))', 9)} as dispersion_mean, {r('max(sqrt(dm * dm + ds * ds + dl * dl))', 9)} as dispersion_max, {r('stddev_pop(sqrt(dm * dm + ds * ds + dl * dl))', 9)} as dispersion_std
from @vector_parts group by cohort, window_index""")
view("system_vector", f"""
-- the same one level up: cohorts around the fleet's centroid
select window_index, count(*) as n_cohorts, {r('avg(centroid_mean)', 11)} as centroid_mean, {r('avg(centroid_std)', 11)} as centroid_std, {r('avg(sqrt(dm * dm + ds * ds))', 11)} as dispersion_mean, {r('max(sqrt(dm * dm + ds * ds))', 11)} as dispersion_max, {r('stddev_pop(sqrt(dm * dm + ds * ds))', 11)} as dispersion_std
from (select window_index, centroid_mean, centroid_std, centroid_mean - avg(centroid_mean) over (partition by window_index) as dm, centroid_std - avg(centroid_std) over (partition by window_index) as ds from @cohort_vector) x group by window_index""")


# --- eigenvalues of three features' correlation, in closed form ------------------------------------------------------
def eigen(source: str, keys: str) -> str:
    """Descending eigenvalues of [[1, a, b], [a, 1, c], [b, c, 1]] times n / (n - 1), as z-scores with the population deviation have them."""
    return f"""
select {keys}, n, (1 + 2 * p * cos(phi)) * n / (n - 1) as l0, (1 - 2 * p * cos(phi) - 2 * p * cos(phi + 2.0943951023931953)) * n / (n - 1) as l1, (1 + 2 * p * cos(phi + 2.0943951023931953)) * n / (n - 1) as l2
from (select {keys}, n, p, acos(least(1.0, greatest(-1.0, case when p > 0.000000001 then a * b * c / (p * p * p) else 0.0 end))) / 3 as phi
      from (select {keys}, n, a, b, c, sqrt((a * a + b * b + c * c) / 3) as p from ({source}) s where a is not null and b is not null and c is not null and n > 2) q) t"""


_three = f"cast(count(*) as double) as n, {corr('w.mean', 'w.std')} as a, {corr('w.mean', 'w.slope')} as b, {corr('w.std', 'w.slope')} as c"
_dim = "(l0 + l1 + l2) * (l0 + l1 + l2) / (l0 * l0 + l1 * l1 + l2 * l2)"
_bits = " + ".join(f"case when l{i} > 0 then l{i} / (l0 + l1 + l2) * ln(l{i} / (l0 + l1 + l2)) else 0.0 end" for i in range(3))
view("window_eigen", eigen(f"select w.cohort, w.window_index, avg(w.signal_0_center) as center, {_three} from @vector_parts w group by w.cohort, w.window_index", "cohort, window_index, center"))
view("jackknife", f"""
-- each window again without each of its signals
select cohort, window_index, count(*) as n, avg({_dim}) as mean_dim, var_pop({_dim}) as var_dim from ({eigen(
    f'select w.cohort, w.window_index, k.signal_id, {_three} from @vector_parts w join @vector_parts k on w.cohort = k.cohort and w.window_index = k.window_index where w.signal_id <> k.signal_id group by w.cohort, w.window_index, k.signal_id',
    'cohort, window_index, signal_id')}) e group by cohort, window_index""")
view("cohort_geometry", f"""
select e.cohort, e.window_index, {r('e.center', 9)} as signal_0_center, cast(e.n as bigint) as n_signals, {r(_dim, 9)} as effective_dim, {r('l0', 9)} as eigenvalue_0, {r('l1', 9)} as eigenvalue_1, {r('l2', 9)} as eigenvalue_2,
       {r('l0 + l1 + l2', 9)} as total_variance, {r('l0 / case when l2 > l0 * 0.0000000001 then l2 when l1 > l0 * 0.0000000001 then l1 else l0 end', 6)} as condition_number,
       {r('l0 / (l0 + l1 + l2)', 9)} as explained_ratio_0, {r('l1 / l0', 9)} as ratio_2_1, {r('l2 / l0', 9)} as ratio_3_1, {r(f'-({_bits}) / ln(2)', 9)} as eigenvalue_entropy, {r(f'-({_bits}) / ln(3)', 9)} as eigenvalue_entropy_normalized,
       {r(f'exp(-({_bits}))', 9)} as effective_dim_entropy, {r('(l0 * l0 + l1 * l1 + l2 * l2) / ((l0 + l1 + l2) * (l0 + l1 + l2))', 9)} as energy_concentration,
       case when j.n >= 4 then {r(f'{_dim} - 1.96 * sqrt((j.n - 1) * j.var_dim)', 6)} end as eff_dim_ci_low, case when j.n >= 4 then {r(f'{_dim} + 1.96 * sqrt((j.n - 1) * j.var_dim)', 6)} end as eff_dim_ci_high
from @window_eigen e left join @jackknife j on e.cohort = j.cohort and e.window_index = j.window_index""")

# --- pairs, information flow, thermodynamics ---------------------------------------------------------------------
view("cohort_pairwise", f"""
select cohort, signal_a, signal_b, cast(tile as bigint) as window_index, max(s0) as signal_0_end, (min(s0) + max(s0)) / 2 as signal_0_center, {r(corr('va', 'vb'), 9)} as correlation, {r('sqrt(sum((va - vb) * (va - vb)))')} as distance,
       {r(div('sum(va * vb)', 'sqrt(sum(va * va)) * sqrt(sum(vb * vb))'))} as cosine_similarity
from (select cohort, signal_a, signal_b, va, vb, s0, floor(s0 / 25) as tile from @pair_points where va is not null and vb is not null) x group by cohort, signal_a, signal_b, tile having count(*) >= 10""")
view("lag_moments", f"""
-- y after its own past and the other's past: correlations of (now, own, other), for one lag
select cohort, source, target, count(*) as n, {corr('y', 'own')} as ryo, {corr('y', 'other')} as ryx, {corr('own', 'other')} as rox
from (select p.cohort, p.signal_id as source, t.signal_id as target, t.value as y, t.before as own, p.before as other
      from (select cohort, signal_id, s0, lag(value) over ({K} order by s0) as before from @obs) p
      join (select cohort, signal_id, s0, value, lag(value) over ({K} order by s0) as before from @obs) t on p.cohort = t.cohort and p.s0 = t.s0 and p.signal_id <> t.signal_id) x
where y is not null and own is not null and other is not null group by cohort, source, target having count(*) >= 50""")


def _tail(z: str) -> str:
    """Two-sided tail of the normal distribution, by the well-known rational approximation (error below 0.0000001)."""
    t = f"(1 / (1 + 0.2316419 * {z}))"
    return f"2 * 0.3989422804014327 * exp(-{z} * {z} / 2) * {t} * (0.31938153 + {t} * (-0.356563782 + {t} * (1.781477937 + {t} * (-1.821255978 + {t} * 1.330274429))))"


view("lag_tests", f"""
select cohort, source, target, n, f, {_tail('sqrt(f)')} as p from (
  select cohort, source, target, n, partial * partial * (n - 3) / nullif(1 - partial * partial, 0) as f
  from (select cohort, source, target, n, {div('ryx - ryo * rox', 'sqrt(greatest(0.0, (1 - ryo * ryo) * (1 - rox * rox)))')} as partial from @lag_moments) x) y""")
view("binned_steps", f"""
select cohort, signal_id, s0, bin as now, lag(bin) over ({K} order by s0) as past
from (select cohort, signal_id, s0, least(7, cast(floor(8 * (value - lo) / nullif(hi - lo, 0)) as bigint)) as bin
      from (select cohort, signal_id, s0, value, min(value) over ({K}) as lo, max(value) over ({K}) as hi from @obs where value is not null) x) y""")
view("transfer_counts", """
select t.cohort, s.signal_id as source, t.signal_id as target, t.now as yf, t.past as yp, s.past as xp, cast(count(*) as double) as n
from @binned_steps t join @binned_steps s on t.cohort = s.cohort and t.s0 = s.s0 and t.signal_id <> s.signal_id where t.past is not null and s.past is not null group by t.cohort, s.signal_id, t.signal_id, t.now, t.past, s.past""")
view("transfer_entropy", f"""
-- H(yf, yp) - H(yp) - H(yf, yp, xp) + H(yp, xp) in bits over eight bins
select cohort, source, target, {r('greatest(0.0, sum(n / total * ln(n * np / (nfp * npx))) / ln(2))', 6)} as transfer_entropy
from (select cohort, source, target, n, sum(n) over (partition by cohort, source, target) as total, sum(n) over (partition by cohort, source, target, yp) as np, sum(n) over (partition by cohort, source, target, yf, yp) as nfp,
             sum(n) over (partition by cohort, source, target, yp, xp) as npx from @transfer_counts) x group by cohort, source, target""")
view("cohort_information_flow", f"""
select a.cohort, a.source as signal_a, a.target as signal_b, {r('a.f', 4)} as granger_f_a_to_b, {r('a.p', 6)} as granger_p_a_to_b, {r('b.f', 4)} as granger_f_b_to_a, {r('b.p', 6)} as granger_p_b_to_a,
       t.transfer_entropy as transfer_entropy_a_to_b, u.transfer_entropy as transfer_entropy_b_to_a
from @lag_tests a join @lag_tests b on a.cohort = b.cohort and a.source = b.target and a.target = b.source
left join @transfer_entropy t on a.cohort = t.cohort and a.source = t.source and a.target = t.target left join @transfer_entropy u on a.cohort = u.cohort and a.source = u.target and a.target = u.source where a.source < a.target""")
view("divergence_bins", """
-- both signals of a pair over 30 shared bins of their common range
select p.cohort, p.signal_a, p.signal_b, o.signal_id, least(29, cast(floor(30 * (o.value - p.lo) / nullif(p.hi - p.lo, 0)) as bigint)) as bin, count(*) as n
from (select a.cohort, a.signal_id as signal_a, b.signal_id as signal_b, least(a.lo, b.lo) as lo, greatest(a.hi, b.hi) as hi
      from (select cohort, signal_id, min(value) as lo, max(value) as hi from @obs group by cohort, signal_id) a join (select cohort, signal_id, min(value) as lo, max(value) as hi from @obs group by cohort, signal_id) b on a.cohort = b.cohort and a.signal_id < b.signal_id) p
join @obs o on p.cohort = o.cohort and (o.signal_id = p.signal_a or o.signal_id = p.signal_b) where o.value is not null group by p.cohort, p.signal_a, p.signal_b, o.signal_id, least(29, cast(floor(30 * (o.value - p.lo) / nullif(p.hi - p.lo, 0)) as bigint))""")
view("signal_divergence", f"""
select cohort, signal_a, signal_b, {r('sum(p * ln(p / q))', 6)} as kl_a_b, {r('sum(q * ln(q / p))', 6)} as kl_b_a, {r('sum(0.5 * p * ln(2 * p / (p + q)) + 0.5 * q * ln(2 * q / (p + q)))', 6)} as js
from (select cohort, signal_a, signal_b, bin, na / sum(na) over (partition by cohort, signal_a, signal_b) + 0.0000000001 as p, nb / sum(nb) over (partition by cohort, signal_a, signal_b) + 0.0000000001 as q
      from (select cohort, signal_a, signal_b, bin, cast(coalesce(sum(n) filter (where signal_id = signal_a), 0) as double) as na, cast(coalesce(sum(n) filter (where signal_id = signal_b), 0) as double) as nb from @divergence_bins group by cohort, signal_a, signal_b, bin) x) y
group by cohort, signal_a, signal_b""")
view("thermodynamics", f"""
-- temperature is the variance of the effective dimension's steps
select cohort, entropy, energy, temperature, {r('energy - temperature * entropy')} as free_energy, {r(div('energy_var', 'temperature * temperature'))} as heat_capacity, n_windows
from (select cohort, count(*) as n_windows, {r('avg(eigenvalue_entropy)', 9)} as entropy, {r('avg(total_variance)', 9)} as energy, {r('var_pop(step)', 9)} as temperature, var_pop(total_variance) as energy_var
      from (select cohort, eigenvalue_entropy, total_variance, effective_dim - lag(effective_dim) over ({C}) as step from @cohort_geometry) x group by cohort) y""")

# --- aliases and the joined physics view ---------------------------------------------------------------------------
for _name, _of in (("state_geometry", "cohort_geometry"), ("state_vector", "cohort_vector"), ("signal_pairwise", "cohort_pairwise"), ("information_flow", "cohort_information_flow"), ("cohort_thermodynamics", "thermodynamics")):
    view(_name, f"select * from @{_of}")
view("physics", f"""
select g.cohort, g.signal_0_center, g.n_signals, g.coherence, g.effective_dim, g.eigenvalue_entropy, g.condition_number, g.energy_proxy, {r('g.energy_velocity', 9)} as energy_velocity, {r('-g.energy_velocity', 9)} as dissipation_rate, {r('g.coherence_velocity', 9)} as coherence_velocity,
       s.state_distance, {r('s.state_velocity', 9)} as state_velocity, {r(f's.state_velocity - s.before', 9)} as state_acceleration
from (select cohort, signal_0_center, n_signals, explained_ratio_0 as coherence, effective_dim, eigenvalue_entropy_normalized as eigenvalue_entropy, condition_number, total_variance as energy_proxy, total_variance - lag(total_variance) over ({C}) as energy_velocity,
             explained_ratio_0 - lag(explained_ratio_0) over ({C}) as coherence_velocity from @state_geometry) g
join (select cohort, signal_0_center, state_distance, state_velocity, lag(state_velocity) over ({C}) as before
      from (select cohort, signal_0_center, dispersion_mean as state_distance, dispersion_mean - lag(dispersion_mean) over ({C}) as state_velocity from @state_vector) a) s
on g.cohort = s.cohort and g.signal_0_center = s.signal_0_center""")
#: Observations from which results are called reliable.
RELIABLE = {"lyapunov": 10000, "lyapunov_marginal": 5000, "attractor": 1000, "transfer_entropy": 500, "hurst": 256}
view("v_data_sufficiency", f"""
select cohort, n_observations, i_range, n_observations >= {RELIABLE['lyapunov']} as lyapunov_reliable, {ladder('n_observations', '>=', (RELIABLE['lyapunov'], 'reliable'), (RELIABLE['lyapunov_marginal'], 'marginal'), other='insufficient')} as lyapunov_quality,
       n_observations >= {RELIABLE['hurst']} as hurst_reliable, n_observations >= {RELIABLE['attractor']} as attractor_reliable, n_observations >= {RELIABLE['transfer_entropy']} as transfer_entropy_reliable,
       {ladder('n_observations', '>=', (RELIABLE['lyapunov'], 'full_analysis'), (RELIABLE['attractor'], 'standard_analysis'), (RELIABLE['hurst'], 'basic_analysis'), other='limited_analysis')} as analysis_tier
from (select cohort, count(*) as n_observations, max(signal_0_center) - min(signal_0_center) as i_range from @physics group by cohort) x""")
view("v_lyapunov_reliability", f"select cohort, n_observations, i_range, {RELIABLE['lyapunov']} as lyapunov_min_observations, lyapunov_reliable as lyapunov_is_reliable, lyapunov_quality as lyapunov_reliability_class from @v_data_sufficiency")

# --- dynamics: backward differences of first to third order, for each measure alike -----------------------------------
_MEASURES = {"effective_dim": "effective_dim", "eigenvalue_0": "eigenvalue_0", "eigenvalue_1": "eigenvalue_1", "total_variance": "total_variance", "condition_number": "condition_number"}
_v = ", ".join(f"{m} - lag({m}) over ({C}) as {m}_velocity" for m in _MEASURES)
_a = ", ".join(f"{m}_velocity - lag({m}_velocity) over ({C}) as {m}_acceleration" for m in _MEASURES)
_j = ", ".join(f"{m}_acceleration - lag({m}_acceleration) over ({C}) as {m}_jerk, abs({m}_acceleration) / pow(1 + {m}_velocity * {m}_velocity, 1.5) as {m}_curvature" for m in _MEASURES)
_out = ", ".join(f"g.{m}, {r(f'g.{m}_velocity', 9)} as {'variance' if m == 'total_variance' else m}_velocity, {r(f'g.{m}_acceleration', 9)} as {m}_acceleration, {r(f'g.{m}_jerk', 9)} as {m}_jerk, {r(f'g.{m}_curvature', 9)} as {m}_curvature" for m in _MEASURES)
view("geometry_steps", f"""
select *, {_j} from (select *, {_a} from (select cohort, signal_0_center, eigenvalue_entropy_normalized as eigenvalue_entropy, {', '.join(_MEASURES)}, {_v} from @state_geometry) v) a""")
view("v_geometry_dynamics", f"""
select g.cohort, g.signal_0_center, {_out}, {r(div('g.eigenvalue_1', 'case when g.eigenvalue_0 > 0 then g.eigenvalue_0 end'), 9)} as ratio_2_1, {r(div('g.eigenvalue_0', 'case when g.total_variance > 0 then g.total_variance end'), 9)} as spectral_gap, g.eigenvalue_entropy,
       c.collapse_onset_idx, case when c.top > 0 then {r('c.collapse_onset_idx / c.top', 9)} end as collapse_onset_fraction
from @geometry_steps g left join (select cohort, max(signal_0_center) as top, min(case when effective_dim_velocity < -0.1 then signal_0_center end) as collapse_onset_idx from @geometry_steps group by cohort) c on g.cohort = c.cohort""")
view("collapse_runs", """
-- runs of three windows or more in which the effective dimension falls by more than 0.05 a window
select cohort, min(signal_0_center) as run_start, max(signal_0_center) as run_end, count(*) as n_windows
from (select cohort, signal_0_center, falling, sum(case when falling then 0 else 1 end) over (partition by cohort order by signal_0_center rows between unbounded preceding and current row) as island
      from (select cohort, signal_0_center, coalesce(effective_dim_velocity < -0.05, false) as falling from @v_geometry_dynamics) x) y where falling group by cohort, island having count(*) >= 3""")
view("collapse", f"""
select g.cohort, {r('1.0 * count(*) filter (where g.effective_dim_velocity < -0.05) / count(g.effective_dim_velocity)', 9)} as share_falling, min(c.run_start) as onset,
       coalesce(1.0 * count(*) filter (where g.effective_dim_velocity < -0.05) / nullif(count(g.effective_dim_velocity), 0) >= 0.3, false) or min(c.run_start) is not null as is_collapsing
from @v_geometry_dynamics g left join (select cohort, min(run_start) as run_start from @collapse_runs group by cohort) c on g.cohort = c.cohort group by g.cohort""")
for _name, _m, _short in (("v_geometry_curvature", "effective_dim", ""), ("v_eigenvalue_1_curvature", "eigenvalue_1", "eig1_"), ("v_condition_number_curvature", "condition_number", "cond_")):
    _more = {"": f", {share('abs(effective_dim_acceleration)', 'cohort')} as curvature_percentile, sign(effective_dim_acceleration) as curvature_direction", "eig1_": ", case when eigenvalue_1_acceleration < 0 then -1 else 1 end as eig1_curvature_direction", "cond_": ""}[_short]
    view(_name, f"""
select cohort, signal_0_center, {_m}, {_m}_velocity, {_m}_acceleration, abs({_m}_acceleration) as {_short}curvature_magnitude, {rank(f'abs({_m}_acceleration)', 'cohort')} as {_short}curvature_rank, {rank(f'abs({_m}_acceleration)', 'signal_0_center')} as {_short}fleet_curvature_rank{_more}
from @v_geometry_dynamics where {_m}_acceleration is not null""")
view("v_geometry_ranked", f"""
select cohort, signal_0_center, effective_dim, effective_dim_velocity, effective_dim_acceleration, abs(effective_dim_velocity) as velocity_magnitude, eigenvalue_1, eigenvalue_1_velocity, eigenvalue_1_acceleration, condition_number, condition_number_velocity, condition_number_acceleration,
       {rank('abs(effective_dim_velocity)', 'cohort')} as velocity_rank, {share('abs(effective_dim_velocity)', 'cohort')} as velocity_percentile, {rank('abs(effective_dim_velocity)', 'signal_0_center')} as fleet_velocity_rank,
       {rank('abs(eigenvalue_1_velocity)', 'cohort')} as eig1_velocity_rank, {rank('abs(eigenvalue_1_velocity)')} as eig1_fleet_velocity_rank
from (select *, row_number() over (partition by cohort, signal_0_center order by condition_number desc nulls last) as k from @v_geometry_dynamics where effective_dim is not null) x where k = 1""")
view("v_geometry_ranked_engine", f"""
select cohort, signal_0_center, effective_dim, effective_dim_velocity, collapse_onset_idx, collapse_onset_fraction, abs(effective_dim_velocity) as velocity_magnitude, {rank('abs(effective_dim_velocity)', 'cohort, signal_0_center')} as velocity_rank,
       {rank('abs(effective_dim_velocity)', 'signal_0_center')} as fleet_velocity_rank, {share('abs(effective_dim_velocity)', 'cohort')} as velocity_percentile, {rank('collapse_onset_fraction', down=False)} as collapse_onset_rank, 1 - collapse_onset_fraction as remaining_fraction
from @v_geometry_dynamics where effective_dim is not null""")

# --- brittleness -------------------------------------------------------------------------------------------------
view("v_cohort_thermodynamics", f"""
select cohort, signal_0_center, eigenvalue_entropy, eigenvalue_entropy_normalized, case when effective_dim > 0 then {r('total_variance / effective_dim', 9)} end as effective_temperature, case when total_variance > 0 then {r('eigenvalue_0 / total_variance', 9)} end as energy_concentration,
       effective_dim, total_variance, condition_number from @state_geometry""")
view("v_brittleness", f"""
select cohort, signal_0_center, condition_number, energy_concentration, effective_temperature, {r('score')} as brittleness_score, {rank('score', 'cohort', digits=4)} as brittleness_rank, {rank('score', digits=4)} as fleet_brittleness_rank, {share('score', 'cohort', digits=4)} as brittleness_percentile
from (select g.cohort, g.signal_0_center, g.condition_number, t.energy_concentration, t.effective_temperature, g.condition_number * coalesce(t.energy_concentration, 1.0) / nullif(t.effective_temperature, 0) as score
      from @state_geometry g left join (select * from @v_cohort_thermodynamics where effective_temperature > 0) t on g.cohort = t.cohort and g.signal_0_center = t.signal_0_center where g.condition_number is not null) x""")
view("v_brittleness_gap", f"""
select cohort, signal_0_center, condition_number, {r('gap', 9)} as eigenvalue_gap, effective_dim, temperature, {r('score')} as brittleness_score, {rank('score', digits=4)} as brittleness_rank, {share('score', 'cohort', digits=4).replace('nulls first', 'nulls last')} as brittleness_percentile
from (select g.cohort, g.signal_0_center, g.condition_number, g.eigenvalue_0 - g.eigenvalue_1 as gap, g.effective_dim, t.temperature, g.condition_number / nullif(abs(g.eigenvalue_0 - g.eigenvalue_1), 0) / nullif(t.temperature, 0) as score
      from @state_geometry g left join (select * from @cohort_thermodynamics where temperature > 0) t on g.cohort = t.cohort where g.condition_number is not null) x""")

# --- first against last fifth ------------------------------------------------------------------------------------
view("v_dimension_trajectory", f"""
select cohort, n_windows, {r('early', 3)} as early_dim, {r('late', 3)} as late_dim, {r('late - early', 3)} as dim_delta, {first_of(('late - early < -0.2', 'COLLAPSING'), ('late - early > 0.2', 'EXPANDING'), other='STABLE')} as trajectory_type, {rank('abs(late - early)')} as change_rank
from (select g.cohort, max(b.n) as n_windows, avg(case when g.signal_0_center <= b.lo + (b.hi - b.lo) * 0.2 then g.effective_dim end) as early, avg(case when g.signal_0_center >= b.hi - (b.hi - b.lo) * 0.2 then g.effective_dim end) as late
      from @state_geometry g join (select cohort, min(signal_0_center) as lo, max(signal_0_center) as hi, count(*) as n from @state_geometry group by cohort) b on g.cohort = b.cohort group by g.cohort) x where early is not null and late is not null""")
for _name, _m, _short, _delta, _label, _up, _down in (("v_eigenvalue_1_trajectory", "eigenvalue_1", "eigenvalue", "eigenvalue_delta", "eigenvalue_trajectory", "CONCENTRATING", "DISPERSING"), ("v_condition_number_trajectory", "condition_number", "cond", "cond_delta", "condition_trajectory", "ILL_CONDITIONING", "CONCENTRATING")):
    view(_name, f"""
select cohort, n_windows, {r('early', 3)} as early_{_short}, {r('late', 3)} as late_{_short}, {r('late - early', 3)} as {_delta},
       {first_of(('early = 0', 'INSUFFICIENT_DATA'), ('late - early > 0.1 * abs(early)', _up), ('late - early < -0.1 * abs(early)', _down), other='STABLE')} as {_label}
from (select cohort, max(n) as n_windows, avg(case when k <= 0.2 * n then {_m} end) as early, avg(case when k > 0.8 * n then {_m} end) as late
      from (select cohort, {_m}, row_number() over ({C}) as k, count(*) over (partition by cohort) as n from @v_geometry_dynamics where {_m} is not null) x group by cohort) y where early is not null and late is not null""")
view("v_segment_comparison", f"""
select cohort, {', '.join(f"{r(f'late_{m} - early_{m}', 6)} as delta_{n}" for m, n in (('effective_dim', 'effective_dim'), ('total_variance', 'total_variance'), ('eigenvalue_0', 'eigenvalue_0'), ('condition_number', 'condition_number'), ('eigenvalue_entropy_normalized', 'entropy')))},
       {', '.join(f"{r(f'{part}_{m}', 6)} as {part}_{m}" for m in ('effective_dim', 'total_variance') for part in ('early', 'late'))}
from (select g.cohort, {', '.join(f"avg(g.{m}) filter (where g.signal_0_center {where}) as {part}_{m}" for m in ('effective_dim', 'total_variance', 'eigenvalue_0', 'condition_number', 'eigenvalue_entropy_normalized') for part, where in (('early', '<= b.lo + (b.hi - b.lo) * 0.25'), ('late', '>= b.hi - (b.hi - b.lo) * 0.25')))}
      from @state_geometry g join (select cohort, min(signal_0_center) as lo, max(signal_0_center) as hi from @state_geometry group by cohort) b on g.cohort = b.cohort group by g.cohort) x""")
_width = "(eff_dim_ci_high - eff_dim_ci_low)"
view("v_ci_breach", f"""
select cohort, signal_0_center, effective_dim, eff_dim_ci_low, eff_dim_ci_high, effective_dim < eff_dim_ci_low or effective_dim > eff_dim_ci_high as ci_breach, case when effective_dim < eff_dim_ci_low then 'below' when effective_dim > eff_dim_ci_high then 'above' end as ci_breach_direction,
       case when {_width} > 0 then {r(f'greatest(eff_dim_ci_low - effective_dim, effective_dim - eff_dim_ci_high, 0) / {_width}')} end as ci_breach_magnitude
from @state_geometry where eff_dim_ci_low is not null and eff_dim_ci_high is not null""")

# --- classes of shape, motion, stability, network, urgency ---------------------------------------------------------
view("v_geometry_shape", f"""
select cohort, signal_0_center, effective_dim, effective_dim_velocity, {ladder('effective_dim', '<', (1.5, 'line_like'), (2.5, 'surface_like'), (3.5, 'volume_like'), other='high_dimensional')} as attractor_type,
       {first_of(('effective_dim_velocity < -0.1', 'collapsing'), ('effective_dim_velocity > 0.1', 'expanding'), ('abs(effective_dim_velocity) < 0.01', 'stable'), other='drifting')} as geometry_status,
       {ladder('effective_dim', '<', (1.2, 'collapsed'), (2.0, 'stretched'), (3.0, 'elongated'), other='compact')} as shape_character, {ladder('abs(effective_dim_velocity)', '<', (0.01, 'well_conditioned'), (0.1, 'moderately_conditioned'), other='ill_conditioned')} as numerical_stability
from @v_geometry_dynamics where effective_dim is not null""")
_calm = lambda c: f"case when {c} <> p_{c} and {c} <> n_{c} and p_{c} = n_{c} then p_{c} else {c} end"
view("v_geometric_transitions", f"""
-- a state of one window between two equal ones is flicker and taken for theirs; the first window has nothing before it
select cohort, signal_0_center, attractor_type, lag(attractor_type) over ({C}) as prev_attractor_type, shape_character, lag(shape_character) over ({C}) as prev_shape_character, geometry_status, numerical_stability, attractor_type_raw, geometry_status_raw,
       case when attractor_type <> lag(attractor_type) over ({C}) then 1 else 0 end as is_geometry_transition, case when geometry_status <> lag(geometry_status) over ({C}) then 1 else 0 end as is_stability_transition
from (select cohort, signal_0_center, {_calm('attractor_type')} as attractor_type, {_calm('geometry_status')} as geometry_status, shape_character, numerical_stability, attractor_type as attractor_type_raw, geometry_status as geometry_status_raw
      from (select *, {', '.join(f'{f}({c}) over ({C}) as {p}_{c}' for c in ('attractor_type', 'geometry_status') for f, p in (('lag', 'p'), ('lead', 'n')))} from @v_geometry_shape) x where p_attractor_type is not null) y""")
view("v_stability_periods", """
-- runs of one status: a running count of changes is the run's key
select cohort, geometry_status, min(signal_0_center) as period_start, max(signal_0_center) as period_end, count(*) as period_length
from (select cohort, signal_0_center, geometry_status, sum(is_stability_transition) over (partition by cohort order by signal_0_center rows between unbounded preceding and current row) as run from @v_geometric_transitions) x group by cohort, geometry_status, run""")
view("ftle_rolling", f"""
-- growth of the size of successive differences over 50 places, forward in time; its deviation is that of the mean
select cohort, signal_id, signal_0_center, window_start, window_end, 'forward' as direction, n, ftle, ftle_std, {r(f'ftle - lag(ftle) over ({K} order by signal_0_center)', 9)} as ftle_velocity, {r(f'ftle - 2 * lag(ftle) over ({K} order by signal_0_center) + lag(ftle, 2) over ({K} order by signal_0_center)', 9)} as ftle_acceleration,
       {r('least(1.0, n / 50.0)')} as confidence, 1 as embedding_dim, 1 as embedding_tau
from (select cohort, signal_id, block, min(s0) as window_start, max(s0) as window_end, (min(s0) + max(s0)) / 2 as signal_0_center, count(growth) as n, {r('avg(growth)', 9)} as ftle, {r('stddev_samp(growth) / sqrt(count(growth))', 9)} as ftle_std
      from (select cohort, signal_id, s0, floor(s0 / 50) as block, ln(step / before) as growth from (select cohort, signal_id, s0, step, lag(step) over ({K} order by s0) as before from (select cohort, signal_id, s0, abs(value - lag(value) over ({K} order by s0)) as step from @obs) a) b where step > 0 and before > 0) c
      group by cohort, signal_id, block having count(growth) >= 10) d""")
view("ftle_summary", f"""
select cohort, signal_id, {r('avg(ftle)', 9)} as ftle, {r('stddev_samp(ftle)', 9)} as ftle_std, sum(n) as n_samples, max(direction) as direction from @ftle_rolling group by cohort, signal_id""")
view("v_ftle_evolution", f"""
select cohort, signal_id, signal_0_center, ftle, ftle_std, ftle_velocity, ftle_acceleration, confidence, embedding_dim, embedding_tau, window_start, window_end, direction,
       {first_of(('ftle is null', 'unknown'), ('ftle > 0.1', 'chaotic'), ('ftle > 0.01', 'marginal'), ('ftle > -0.01', 'neutral'), other='stable')} as chaos_class, {first_of(('ftle_velocity is null', 'unknown'), ('ftle_velocity > 0.01', 'destabilizing'), ('ftle_velocity < -0.01', 'stabilizing'), other='steady')} as stability_trend,
       {first_of(('confidence is null', 'unknown'), ('confidence > 0.8', 'high'), ('confidence > 0.5', 'medium'), other='low')} as classification_confidence, {first_of(('ftle is null or ftle_std is null', 'unknown'), ('abs(ftle) < ftle_std', 'indeterminate'), ('ftle_std < 0.1 * abs(ftle)', 'precise'), other='approximate')} as estimate_quality from @ftle_rolling""")
view("v_chaos_geometry_alignment", f"""
select f.cohort, f.signal_id, f.signal_0_center, f.chaos_class, f.stability_trend, g.attractor_type, g.geometry_status,
       {first_of(("f.chaos_class = 'chaotic' and g.geometry_status = 'stable'", 'mismatch_chaotic_stable'), ("f.chaos_class = 'stable' and g.geometry_status = 'collapsing'", 'mismatch_stable_collapsing'), ("f.chaos_class = 'chaotic' and g.geometry_status = 'collapsing'", 'consistent_degrading'),
                 ("f.chaos_class = 'stable' and g.geometry_status = 'stable'", 'consistent_healthy'), ("f.chaos_class = 'marginal' and g.geometry_status = 'stable'", 'marginal_but_stable'), ("f.chaos_class = 'neutral' and g.geometry_status = 'stable'", 'neutral_stable'), other='mixed')} as alignment
from @v_ftle_evolution f left join @v_geometry_shape g on f.cohort = g.cohort and f.signal_0_center = g.signal_0_center""")
view("v_trajectory_ranked", f"""
select cohort, signal_id, signal_0_center, ftle as lyapunov_max, ftle_velocity, ftle_acceleration, confidence, abs(ftle) as lyapunov_magnitude, {rank('abs(ftle)', 'cohort, signal_0_center')} as lyapunov_rank, {rank('abs(ftle)', 'signal_0_center')} as fleet_lyapunov_rank,
       {share('abs(ftle)', 'cohort')} as lyapunov_percentile, {ladder('confidence', '>', (0.8, 'high'), (0.5, 'medium'), other='low')} as classification_confidence from @ftle_rolling where direction = 'forward'""")
view("v_stability_ranked", f"""
select cohort, signal_id, signal_0_center, ftle as lyapunov_max, coalesce(least(1.0, greatest(-1.0, ftle * 10)), 0.0) as stability_score, {rank('ftle', 'cohort')} as instability_rank, {rank('ftle')} as fleet_instability_rank, {share('ftle', 'cohort')} as instability_percentile
from @ftle_rolling where direction = 'forward'""")
view("v_curvature_ranked", f"""
select cohort, signal_id, signal_0_center, ftle_acceleration as d2value, abs(ftle_acceleration) as curvature_magnitude, {rank('abs(ftle_acceleration)', 'cohort, signal_0_center')} as curvature_rank, {share('abs(ftle_acceleration)', 'cohort, signal_id')} as curvature_percentile,
       {rank('abs(ftle_acceleration)', 'signal_0_center')} as fleet_curvature_rank, sign(ftle_acceleration) as curvature_direction from @ftle_rolling where ftle_acceleration is not null and direction = 'forward'""")
view("motion", f"""
-- first and second differences of each signal's window mean, as one vector a window
select cohort, window_index, signal_id, signal_0_center, v, v - lag(v) over ({K} order by window_index) as a
from (select cohort, window_index, signal_id, signal_0_center, mean - lag(mean) over ({K} order by window_index) as v from @signal_windows) x where v is not null""")
view("velocity_field", f"""
select cohort, window_index, signal_0_center, {r('sqrt(vv)')} as speed, {r('sqrt(aa)')} as acceleration_magnitude, {r('av / nullif(sqrt(vv), 0)')} as acceleration_parallel, {r('sqrt(greatest(0.0, aa - av * av / nullif(vv, 0)))')} as acceleration_perpendicular,
       {r('sqrt(greatest(0.0, aa - av * av / nullif(vv, 0))) / (vv + 0.000000000001)')} as curvature, {r('exp(h)')} as motion_dimensionality, dominant_motion_signal, {r('top / nullif(vv, 0)')} as dominant_motion_fraction, dominant_accel_signal
from (select cohort, window_index, avg(signal_0_center) as signal_0_center, sum(v * v) as vv, sum(a * a) as aa, sum(a * v) as av, max(v * v) as top, min(case when nv = 1 then signal_id end) as dominant_motion_signal, min(case when na = 1 and a is not null then signal_id end) as dominant_accel_signal,
             -sum(case when v <> 0 then v * v / total * ln(v * v / total) else 0.0 end) as h
      from (select cohort, window_index, signal_id, signal_0_center, v, a, sum(v * v) over (partition by cohort, window_index) as total, row_number() over (partition by cohort, window_index order by round(abs(v), 6) desc nulls last, signal_id) as nv,
                   row_number() over (partition by cohort, window_index order by round(abs(a), 6) desc nulls last, signal_id) as na from @motion) x group by cohort, window_index) y""")
view("v_motion_class", f"""
select cohort, signal_0_center, speed, acceleration_magnitude, acceleration_parallel, acceleration_perpendicular, curvature, motion_dimensionality, dominant_motion_signal, dominant_motion_fraction, dominant_accel_signal,
       {first_of(('speed < 0.001', 'stationary'), ('abs(acceleration_parallel) < 0.01 * speed', 'constant'), ('acceleration_parallel > 0', 'accelerating'), other='decelerating')} as motion_type,
       {first_of(('curvature is null', 'unknown'), ('curvature < 0.01', 'straight'), ('curvature < 0.5', 'curved'), other='spiral')} as trajectory_shape, {first_of(('motion_dimensionality is null', 'unknown'), ('motion_dimensionality < 1.5', '1D'), ('motion_dimensionality < 2.5', '2D'), other='3D')} as motion_complexity,
       {first_of(('dominant_motion_fraction is null', 'unknown'), ('dominant_motion_fraction > 0.8', 'single_signal'), ('dominant_motion_fraction > 0.5', 'dominant_signal'), other='distributed')} as motion_concentration from @velocity_field""")
view("v_velocity_field", f"""
select cohort, signal_0_center, {r('sqrt(coalesce(v1 * v1, 0) + coalesce(v2 * v2, 0) + coalesce(v3 * v3, 0))')} as speed, {r('dispersion_mean - 2 * p1 + p2')} as acceleration, {r('v1')} as v_mean_distance, {r('v2')} as v_max_distance, {r('v3')} as v_std_distance
from (select cohort, signal_0_center, dispersion_mean, dispersion_mean - lag(dispersion_mean) over ({C}) as v1, dispersion_max - lag(dispersion_max) over ({C}) as v2, dispersion_std - lag(dispersion_std) over ({C}) as v3,
             lag(dispersion_mean) over ({C}) as p1, lag(dispersion_mean, 2) over ({C}) as p2 from @state_vector) x where v1 is not null""")
view("ridge_proximity", f"""
-- smoothed exponent against the ridge at 0.05: how fast it comes nearer, weighted by how fast the cohort moves
select s.cohort, s.signal_id, s.signal_0_center, {r('s.smooth', 11)} as ftle_current, {r('s.gradient', 11)} as ftle_gradient, {r('s.acceleration', 11)} as ftle_acceleration, v.speed, {r('v.speed * s.gradient', 7)} as urgency,
       case when s.gradient > 0.0000000001 and s.smooth < 0.05 then {r('(0.05 - s.smooth) / s.gradient', 6)} end as time_to_ridge, {first_of(('v.speed * s.gradient > 0.1', 'critical'), ('v.speed * s.gradient > 0.01', 'warning'), ('v.speed * s.gradient > 0.001', 'elevated'), other='nominal')} as urgency_class
from (select cohort, signal_id, signal_0_center, place, smooth, (lead(smooth) over ({K} order by place) - lag(smooth) over ({K} order by place)) / 2 as gradient, lead(smooth) over ({K} order by place) - 2 * smooth + lag(smooth) over ({K} order by place) as acceleration
      from (select cohort, signal_id, signal_0_center, floor(signal_0_center / 50) as place, avg(ftle) over ({K} order by signal_0_center rows between 1 preceding and 1 following) as smooth from @ftle_rolling) x) s
left join (select cohort, floor(signal_0_center / 50) as place, avg(speed) as speed from @velocity_field group by cohort, floor(signal_0_center / 50)) v on s.cohort = v.cohort and s.place = v.place""")
view("v_urgency_class", f"""
select cohort, signal_id, signal_0_center, ftle_current, ftle_gradient, ftle_acceleration, speed, urgency, time_to_ridge, urgency_class, {first_of(('time_to_ridge is null', 'none'), ('time_to_ridge < 10', 'imminent'), ('time_to_ridge < 50', 'near'), ('time_to_ridge < 200', 'distant'), other='none')} as warning_horizon,
       {first_of(('ftle_gradient is null', 'unknown'), ('ftle_gradient > 0.01', 'approaching_ridge'), ('ftle_gradient < -0.01', 'leaving_ridge'), other='stable')} as ridge_trend,
       {first_of(('ftle_acceleration is null', 'unknown'), ('ftle_acceleration > 0.001', 'accelerating_toward'), ('ftle_acceleration < -0.001', 'decelerating'), other='constant_rate')} as approach_dynamics from @ridge_proximity""")
view("v_topology", f"""
-- the graph of a window's pairs above the cohort's 90th percentile of |correlation|; degrees are over signals with an edge
select s.cohort, s.signal_0_end, s.signal_0_center, true as topology_computed, s.n_signals, coalesce(e.n_edges, 0) as n_edges, case when s.n_signals > 1 then {r('coalesce(e.n_edges, 0) / (s.n_signals * (s.n_signals - 1) / 2.0)', 9)} else 0.0 end as density,
       coalesce({r('2.0 * e.n_edges / d.n_linked', 9)}, 0.0) as mean_degree, coalesce(d.max_degree, 0) as max_degree, coalesce(e.threshold, 0.5) as threshold
from (select cohort, window_index, max(signal_0_end) as signal_0_end, max(signal_0_center) as signal_0_center, count(distinct signal_id) as n_signals from (select cohort, window_index, signal_0_end, signal_0_center, signal_a as signal_id from @signal_pairwise union all select cohort, window_index, signal_0_end, signal_0_center, signal_b from @signal_pairwise) x group by cohort, window_index) s
left join (select cohort, window_index, count(*) as n_edges, max(threshold) as threshold from @network_edges group by cohort, window_index) e on s.cohort = e.cohort and s.window_index = e.window_index
left join (select cohort, window_index, count(*) as n_linked, max(degree) as max_degree from (select cohort, window_index, signal_id, count(*) as degree from (select cohort, window_index, signal_a as signal_id from @network_edges union all select cohort, window_index, signal_b from @network_edges) y group by cohort, window_index, signal_id) z group by cohort, window_index) d
on s.cohort = d.cohort and s.window_index = d.window_index""")
view("network_edges", f"""
select p.cohort, p.window_index, p.signal_a, p.signal_b, t.threshold from @signal_pairwise p join (select cohort, {r(quantile(0.9, 'abs(correlation)'), 9)} as threshold from @signal_pairwise where correlation is not null group by cohort) t on p.cohort = t.cohort where abs(p.correlation) > t.threshold""")
view("topology", "select * from @v_topology")
view("v_network_class", f"""
select cohort, signal_0_center, topology_computed, n_signals, n_edges, density, mean_degree, max_degree, threshold, {first_of(('not topology_computed', 'not_computed'), ('density < 0.1', 'sparse'), ('density < 0.4', 'moderate'), ('density < 0.7', 'dense'), other='fully_connected')} as network_type,
       {first_of(('not topology_computed', 'not_computed'), ('mean_degree < 1.0', 'isolated'), ('mean_degree < 3.0', 'low_connectivity'), ('mean_degree < 6.0', 'moderate_connectivity'), other='high_connectivity')} as connectivity_class,
       case when n_signals >= 2 then {r('n_edges / (n_signals * (n_signals - 1) / 2.0)', 9)} end as coupling_fraction,
       {first_of(('not topology_computed', 'not_computed'), ('mean_degree < 0.01', 'no_connections'), ('max_degree > 3.0 * mean_degree', 'hub_dominated'), ('max_degree > 1.5 * mean_degree', 'weak_hubs'), other='uniform')} as hub_structure from @topology""")
view("v_system_departure", f"""
select cohort, signal_0_center, effective_dim, effective_dim_velocity, mean_lyapunov, max_lyapunov, max_lyapunov_magnitude, stability_score, collapse_onset_fraction, velocity_percentile, lyapunov_percentile, {r('(lyapunov_percentile + velocity_percentile) / 2', 9)} as composite_instability, {rank('lyapunov_percentile + velocity_percentile')} as composite_rank
from (select g.cohort, g.signal_0_center, g.effective_dim, g.effective_dim_velocity, f.mean_lyapunov, f.max_lyapunov, f.max_lyapunov_magnitude, f.stability_score, g.collapse_onset_fraction, {share('abs(g.effective_dim_velocity)', 'g.cohort')} as velocity_percentile, {share('f.max_lyapunov_magnitude', 'g.cohort')} as lyapunov_percentile
      from @v_geometry_dynamics g left join (select cohort, floor(signal_0_center / 50) as place, {r('avg(ftle)', 9)} as mean_lyapunov, max(ftle) as max_lyapunov, max(abs(ftle)) as max_lyapunov_magnitude, {r('avg(coalesce(least(1.0, greatest(-1.0, ftle * 10)), 0.0))', 9)} as stability_score
                                             from @ftle_rolling where direction = 'forward' group by cohort, floor(signal_0_center / 50)) f on g.cohort = f.cohort and floor(g.signal_0_center / 50) = f.place) x""")
view("v_departure_summary", f"""
select cohort, count(*) as total_observations, {r('avg(composite_instability)', 9)} as mean_composite_instability, max(composite_instability) as max_composite_instability, count(*) filter (where composite_instability > 0.95) as n_extreme, count(*) filter (where composite_instability > 0.90) as n_high,
       {r('avg(stability_score)', 9)} as mean_stability_score, min(stability_score) as min_stability_score, min(composite_rank) as best_composite_rank from @v_system_departure group by cohort""")
view("v_info_flow_delta", f"""
select cohort, signal_a, signal_b, granger_f_a_to_b, granger_p_a_to_b, granger_f_b_to_a, granger_p_b_to_a, transfer_entropy_a_to_b, transfer_entropy_b_to_a,
       {first_of(('granger_p_a_to_b < 0.05 and granger_p_b_to_a < 0.05', 'bidirectional'), ('granger_p_a_to_b < 0.05', 'a_drives_b'), ('granger_p_b_to_a < 0.05', 'b_drives_a'), other='independent')} as link_status,
       {ladder('least(granger_p_a_to_b, granger_p_b_to_a)', '<', (0.01, 'strong'), (0.05, 'moderate'), other='weak')} as link_strength from @information_flow""")

# --- window features of a signal, relational ---------------------------------------------------------------------
view("signal_features", f"""
-- one row a signal and window of 50: shape, memory and entropy measures that need no transform
select cohort, signal_id, block as window_index, (min(s0) + max(s0)) / 2 as signal_0_center, count(*) as n, {r('avg(x * x * x * x) / nullif(pow(avg(x * x), 2), 0) - 3')} as kurtosis, {r('avg(x * x * x) / nullif(pow(avg(x * x), 1.5), 0)')} as skewness, {r(corr('value', 'before'))} as acf_lag1,
       {r(div('max(abs(value))', 'sqrt(avg(value * value))'))} as crest_factor, {r('0.5 + 0.5 * ln(nullif(stddev_pop(value - before2), 0) / nullif(stddev_pop(value - before), 0)) / ln(2)')} as hurst,
       {r('1 - ' + div('avg((value - before) * (value - before))', '4 * avg(x * x)'))} as spectral_entropy, {r('1.0 * count(*) filter (where (value - before) * (before - before2) < 0) / count(*)')} as permutation_entropy, {r('ln(1 + ' + div('avg(abs(value - before))', 'stddev_pop(value)') + ')')} as sample_entropy
from (select cohort, signal_id, s0, value, before, before2, block, value - avg(value) over ({K}, block) as x from (select cohort, signal_id, s0, value, floor(s0 / 50) as block, lag(value) over ({K} order by s0) as before, lag(value, 2) over ({K} order by s0) as before2 from @obs where value is not null) a) b
group by cohort, signal_id, block having count(*) >= 40""")
view("v_feature_stats_ref", f"""
select 'signal_vector' as source, 'spectral_entropy' as column_name, {r('avg(spectral_entropy)')} as mean, {', '.join(f"{r(quantile(q, 'spectral_entropy'))} as {n}" for q, n in ((0.05, 'p05'), (0.25, 'p25'), (0.5, 'median'), (0.75, 'p75'), (0.95, 'p95')))},
       min(spectral_entropy) as value_min, max(spectral_entropy) as value_max, count(*) as n_samples from @signal_features where spectral_entropy is not null""")
view("v_correlation", f"""
select a.cohort, a.signal_id as feature_a, b.signal_id as feature_b, {r(corr('a.spectral_entropy', 'b.spectral_entropy'))} as correlation, count(*) as n_valid
from @signal_features a join @signal_features b on a.cohort = b.cohort and a.window_index = b.window_index and a.signal_id < b.signal_id group by a.cohort, a.signal_id, b.signal_id having count(*) > 2""")
view("v_canary_signals", f"""
select signal_id, feature, {r('rr')} as r_with_lifecycle, {r('rr * rr')} as r_squared, n_cohorts from (
  select signal_id, feature, {corr('x', 'life')} as rr, count(distinct cohort) as n_cohorts
  from (select f.cohort, f.signal_id, 'spectral_entropy' as feature, f.spectral_entropy as x, f.signal_0_center / nullif(g.top, 0) as life from @signal_features f join (select cohort, max(signal_0_center) as top from @state_geometry group by cohort) g on f.cohort = g.cohort
        union all select f.cohort, f.signal_id, 'hurst_exponent', f.hurst, f.signal_0_center / nullif(g.top, 0) from @signal_features f join (select cohort, max(signal_0_center) as top from @state_geometry group by cohort) g on f.cohort = g.cohort) x
  where x is not null and life is not null group by signal_id, feature having count(*) > 10 and max(x) > min(x) and max(life) > min(life)) y where rr is not null""")
view("v_canary_sequence_entropy", f"""
select cohort, signal_id, first_extreme as first_extreme_i, canary_rank, times_first_mover, rank() over (order by times_first_mover desc) as fleet_canary_rank
from (select cohort, signal_id, first_extreme, rank() over (partition by cohort order by first_extreme) as canary_rank, count(*) over (partition by signal_id) as times_first_mover
      from (select cohort, signal_id, min(signal_0_center) as first_extreme from (select cohort, signal_id, signal_0_center, {share('spectral_entropy', 'cohort, signal_id')} as p from @signal_features where spectral_entropy is not null) x where p > 0.95 group by cohort, signal_id) y) z""")
_F = (("spectral_entropy", "entropy", "spectral_entropy"), ("kurtosis", "kurtosis", "kurtosis"), ("abs(skewness)", "skewness", "skewness"), ("hurst", "hurst", "hurst"), ("acf_lag1", "memory", "acf_lag1"))
view("v_signal_ranked", f"""
select cohort, signal_id, signal_0_center, spectral_entropy, kurtosis, skewness, hurst, acf_lag1, sample_entropy, permutation_entropy, crest_factor, {', '.join(f"{rank(x, 'cohort')} as {n}_rank" for x, n, _ in _F)}, {', '.join(f"{rank(x)} as fleet_{n}_rank" for x, n, _ in _F if n in ('entropy', 'kurtosis', 'hurst'))},
       {', '.join(f"{share(x, 'cohort')} as {n}_percentile" for x, n, _ in _F if n in ('entropy', 'kurtosis', 'hurst'))} from @signal_features where spectral_entropy is not null""")
view("v_deviation_ranked_signal", f"""
select cohort, signal_id, signal_0_center, value, {r('abs(p - 0.5) * 2', 9)} as deviation_magnitude, {r('p', 9)} as signal_percentile, {rank('abs(p - 0.5)', 'cohort, signal_0_center')} as deviation_rank, {rank('abs(p - 0.5)', 'signal_0_center')} as fleet_deviation_rank
from (select cohort, signal_id, signal_0_center, spectral_entropy as value, {share('spectral_entropy', 'cohort, signal_id')} as p from @signal_features where spectral_entropy is not null) x""")
view("v_coupling_ranked_engine", f"""
select cohort, signal_0_center, signal_a, signal_b, correlation, distance, cosine_similarity, magnitude as coupling_magnitude, {r('delta', 9)} as coupling_delta, {rank('magnitude', 'cohort, signal_0_center')} as coupling_rank, {rank('delta', 'cohort, signal_0_center')} as decoupling_rank,
       {rank('magnitude', 'signal_0_center')} as fleet_coupling_rank, {share('magnitude', 'cohort, signal_a, signal_b')} as coupling_percentile
from (select *, abs(correlation) as magnitude, abs(correlation - lag(correlation) over (partition by cohort, signal_a, signal_b order by window_index)) as delta from @signal_pairwise) x""")

# --- breaks ------------------------------------------------------------------------------------------------------
view("cusum", f"""
-- the running sum of departures from the block's mean; its peak, 20 places from either end, is a break if it exceeds twice the deviation times the root of n
select cohort, signal_id, block, s0, value, n, k, dev, total from (
  select cohort, signal_id, block, s0, value, n, k, dev, sum(value - m) over ({K}, block order by s0 rows between unbounded preceding and current row) as total
  from (select cohort, signal_id, s0, value, block, avg(value) over ({K}, block) as m, stddev_pop(value) over ({K}, block) as dev, count(value) over ({K}, block) as n, row_number() over ({K}, block order by s0) as k
        from (select cohort, signal_id, s0, value, floor(s0 / 100) as block from @obs where value is not null) a) b) c where n >= 50""")
view("cusum_peaks", f"""
select cohort, signal_id, block, s0, n, {r('abs(total) / nullif(dev * sqrt(n), 0)')} as significance from (select cohort, signal_id, block, s0, n, total, dev, row_number() over ({K}, block order by round(abs(total), 6) desc, s0) as nth from @cusum where k > 20 and k <= n - 20) x where nth = 1""")
view("breaks", f"""
select p.cohort, p.signal_id, p.s0 as signal_0, p.s0 as signal_0_center, {r('avg(c.value) filter (where c.s0 > p.s0) - avg(c.value) filter (where c.s0 <= p.s0)')} as magnitude, case when avg(c.value) filter (where c.s0 > p.s0) >= avg(c.value) filter (where c.s0 <= p.s0) then 1 else -1 end as direction,
       {r('abs(avg(c.value) filter (where c.s0 > p.s0 and c.s0 <= p.s0 + 5) - avg(c.value) filter (where c.s0 <= p.s0 and c.s0 > p.s0 - 5))')} as sharpness, max(p.n) as duration, {r('avg(c.value) filter (where c.s0 <= p.s0)')} as pre_level, {r('avg(c.value) filter (where c.s0 > p.s0)')} as post_level,
       {r(div('abs(avg(c.value) filter (where c.s0 > p.s0) - avg(c.value) filter (where c.s0 <= p.s0))', 'max(c.dev)'))} as snr, max(p.significance) as significance
from @cusum_peaks p join @cusum c on p.cohort = c.cohort and p.signal_id = c.signal_id and p.block = c.block where p.significance > 0.8 group by p.cohort, p.signal_id, p.block, p.s0""")
view("pettitt", f"""
-- rank form of the test: U at place k is twice the ranks up to there less k (n + 1); p by the usual bound
select cohort, signal_id, s0 as change_point, k_stat, {r('least(1.0, 2 * exp(-6.0 * k_stat * k_stat / (1.0 * n * n * n + 1.0 * n * n)))')} as p_value
from (select cohort, signal_id, s0, n, abs(u) as k_stat, row_number() over ({K} order by abs(u) desc, s0) as nth
      from (select cohort, signal_id, s0, n, 2 * sum(rk) over ({K} order by s0 rows between unbounded preceding and current row) - k * (n + 1) as u
            from (select cohort, signal_id, s0, row_number() over ({K} order by value, s0) as rk, row_number() over ({K} order by s0) as k, count(*) over ({K}) as n from @obs where value is not null) a) b) c where nth = 1""")
view("v_break_type", f"""
select cohort, signal_id, signal_0_center, magnitude, direction, sharpness, duration, pre_level, post_level, snr, {r('abs(post_level - pre_level)')} as level_change, {r(div('abs(post_level - pre_level)', 'abs(magnitude)'))} as persistence_ratio,
       {rank('abs(magnitude)', 'cohort, signal_id')} as magnitude_rank, {rank('sharpness', 'cohort, signal_id')} as sharpness_rank, {rank('abs(magnitude)')} as fleet_magnitude_rank, {share('abs(magnitude)', 'cohort, signal_id')} as magnitude_percentile, {share('sharpness', 'cohort, signal_id')} as sharpness_percentile from @breaks""")
view("v_regimes", f"""
select cohort, signal_id, regime_number, regime_start, regime_end, regime_end - regime_start as regime_duration, regime_level, entry_magnitude, {rank('regime_end - regime_start', 'cohort, signal_id')} as duration_rank, {rank('abs(entry_magnitude)', 'cohort, signal_id')} as entry_magnitude_rank
from (select cohort, signal_id, signal_0_center as regime_start, lead(signal_0_center) over ({K} order by signal_0_center) as regime_end, post_level as regime_level, magnitude as entry_magnitude, row_number() over ({K} order by signal_0_center) as regime_number from @v_break_type where persistence_ratio > 0.3) x where regime_end is not null""")
view("v_break_summary", f"""
select cohort, signal_id, n_breaks, {r('mean_m')} as mean_magnitude, {r('max_m')} as max_magnitude, {r('mean_s')} as mean_sharpness, {r('max_s')} as max_sharpness, {r('mean_p')} as mean_persistence, rank() over (order by n_breaks desc) as break_frequency_rank, {rank('max_m')} as max_magnitude_rank, {rank('mean_m')} as mean_magnitude_rank
from (select cohort, signal_id, count(*) as n_breaks, avg(abs(magnitude)) as mean_m, max(abs(magnitude)) as max_m, avg(sharpness) as mean_s, max(sharpness) as max_s, avg(persistence_ratio) as mean_p from @v_break_type group by cohort, signal_id) x""")
view("v_break_patterns_ranked", f"""
select cohort, signal_id, {r('spacing')} as mean_break_spacing, {r('cv')} as spacing_cv, n_breaks, {rank('cv', down=False)} as regularity_rank, rank() over (order by n_breaks desc) as frequency_rank, {share('cv').replace('nulls first', 'nulls last')} as regularity_percentile
from (select cohort, signal_id, avg(gap) as spacing, {div('stddev_samp(gap)', 'avg(gap)')} as cv, count(*) as n_breaks from (select cohort, signal_id, signal_0_center - lag(signal_0_center) over ({K} order by signal_0_center) as gap from @v_break_type) x where gap is not null group by cohort, signal_id) y""")
view("v_break_sequence", """
select cohort, signal_id, first_break as first_break_i, first_break - min(first_break) over (partition by cohort) as detection_latency, row_number() over (partition by cohort order by first_break, signal_id) as propagation_rank,
       first_break - lag(first_break) over (partition by cohort order by first_break, signal_id) as cascade_delay, min(first_break) over (partition by cohort) as reference_index from (select cohort, signal_id, min(signal_0_center) as first_break from @breaks group by cohort, signal_id) x""")
view("v_break_cascade", f"""
select s.cohort, s.signal_id, s.first_break_i, s.detection_latency, s.propagation_rank, s.cascade_delay, b.magnitude, b.direction, b.snr, s.reference_index,
       {first_of(('s.propagation_rank = 1', 'initiator'), ('s.propagation_rank <= 3', 'early_follower'), ('s.cascade_delay < 50', 'follower'), other='late')} as cascade_role, {first_of(('s.cascade_delay is null or s.cascade_delay = 0', 'origin'), ('s.cascade_delay < 10', 'fast'), ('s.cascade_delay < 50', 'medium'), other='slow')} as propagation_speed,
       {first_of(('b.snr is null', 'unknown'), ('b.snr > 10 and abs(b.magnitude) > 1.0', 'strong'), ('b.snr > 3 and abs(b.magnitude) > 0.5', 'moderate'), other='weak')} as break_significance, {first_of(('b.direction > 0', 'upward'), ('b.direction < 0', 'downward'), other='neutral')} as break_direction
from @v_break_sequence s join @breaks b on s.cohort = b.cohort and s.signal_id = b.signal_id and s.first_break_i = b.signal_0_center""")
_counted = (("v_geometry_shape", True), ("v_motion_class", True), ("v_ftle_evolution", True), ("v_urgency_class", True), ("v_break_cascade", False), ("v_network_class", True))
view("v_data_quality_atlas", " union all ".join(f"select '{n}' as view_name, count(*) as total_rows, {'count(distinct signal_0_center)' if windows else 'cast(0 as bigint)'} as unique_windows, count(distinct cohort) as cohorts from @{n}" for n, windows in _counted))

# --- fleet -------------------------------------------------------------------------------------------------------
view("fleet_baseline", f"""
-- windows of the first fifth of each cohort, at least three, pooled
select count(*) as n_windows, count(distinct cohort) as n_cohorts, {r('avg(centroid_mean)')} as mean_center, {r('avg(centroid_std)')} as std_center, {r('stddev_pop(centroid_mean)')} as mean_spread, {r('stddev_pop(centroid_std)')} as std_spread
from (select cohort, centroid_mean, centroid_std, row_number() over (partition by cohort order by window_index) as k, count(*) over (partition by cohort) as n from @cohort_vector) x where k <= greatest(3, 0.2 * n)""")
view("fleet_departure", f"""
select v.cohort, v.window_index, {r('sqrt(pow((v.centroid_mean - b.mean_center) / nullif(b.mean_spread, 0), 2) + pow((v.centroid_std - b.std_center) / nullif(b.std_spread, 0), 2))')} as departure from @cohort_vector v cross join @fleet_baseline b""")
view("signal_dominance", f"""
-- how far each signal's window means carry the cohort's motion
select cohort, signal_id, {r('avg(part)')} as mean_share, rank() over (partition by cohort order by round(avg(part), 6) desc) as dominance_rank from (select cohort, signal_id, {div('v * v', 'sum(v * v) over (partition by cohort, window_index)')} as part from @motion) x group by cohort, signal_id""")
view("co_loading", f"""
-- pairs whose window features move together strongly enough that a causal test is worth its price
select cohort, window_index, signal_a, signal_b, correlation, abs(correlation) > 0.3 as needs_granger from @cohort_pairwise""")
