"""Pairs of signals: correlation, lags, networks, causality proxies and information measures.

Signals of a cohort meet on the axis place, an equality on (cohort, s0); lagged pairs meet on the shifted place, which is
computed before the join, and bands on neighbouring blocks. Lags and blocks multiply rows by an explode of constants.
"""

from __future__ import annotations

from .dag import corr, div, first_of, ladder, oracle, r, rank, view

P = "cohort, signal_a, signal_b"
_pair = lambda a, b: f"{a}.cohort = {b}.cohort and {a}.signal_a = {b}.signal_a and {a}.signal_b = {b}.signal_b"

# --- geometry ----------------------------------------------------------------------------------------------------
view("pair_points", """
select a.cohort, a.s0, a.signal_id as signal_a, b.signal_id as signal_b, a.value as va, b.value as vb, a.d1 as da, b.d1 as db, a.d2 as ca, b.d2 as cb
from @calc a join @calc b on a.cohort = b.cohort and a.s0 = b.s0 and a.signal_id < b.signal_id""")
view("v_correlation_matrix", f"select {P}, {r(corr('va', 'vb'))} as pearson_correlation, count(*) as n_overlap from @pair_points group by {P} having count(*) > 50")
view("lagged_points", """
-- a at a place against b at an earlier one; the lags multiply b, then one equi-join on the shifted place serves all
select a.cohort, a.signal_id as signal_a, b.signal_id as signal_b, b.lag_steps, a.value as va, b.value as vb
from @obs a join (select cohort, signal_id, value, s0 + lag_steps as s0, lag_steps from (select cohort, signal_id, s0, value, #each(1, 5, 10, 15, 20) as lag_steps from @obs) k) b on a.cohort = b.cohort and a.s0 = b.s0 and a.signal_id <> b.signal_id""")
view("v_lagged_correlation", f"select {P}, lag_steps as lag, {r(corr('va', 'vb'))} as correlation from @lagged_points group by {P}, lag_steps")
oracle("v_lagged_correlation", " union all ".join(f"""
select a.cohort, a.signal_id as signal_a, b.signal_id as signal_b, {k} as lag, {r(corr('a.value', 'b.value'))} as correlation from @obs a join @obs b on a.cohort = b.cohort and a.signal_id <> b.signal_id and a.s0 = b.s0 + {k} group by a.cohort, a.signal_id, b.signal_id""" for k in (1, 5, 10, 15, 20)))
view("v_optimal_lag", f"""
select {P}, lag as optimal_lag, correlation as optimal_correlation, abs(correlation) as optimal_abs_correlation,
       {first_of(('correlation > 0.7', 'strong_positive'), ('correlation > 0.3', 'moderate_positive'), ('correlation < -0.7', 'strong_negative'), ('correlation < -0.3', 'moderate_negative'), other='weak')} as coupling_strength
from (select {P}, lag, correlation, row_number() over (partition by {P} order by abs(correlation) desc nulls last, lag) as k from @v_lagged_correlation) x where k = 1""")
view("v_lead_lag", f"""
-- ten places back for the one is ten forward for the other: both come from the pair's lag of ten, either way round
select f.cohort, f.signal_a, f.signal_b, f.correlation as corr_forward, b.correlation as corr_backward, {r('f.correlation - b.correlation')} as lead_lag_asymmetry,
       {first_of(('f.correlation > b.correlation + 0.1', 'A_leads_B'), ('b.correlation > f.correlation + 0.1', 'B_leads_A'), other='contemporaneous')} as lead_lag_direction
from (select * from @v_lagged_correlation where lag = 10) f join (select * from @v_lagged_correlation where lag = 10) b on f.cohort = b.cohort and f.signal_a = b.signal_b and f.signal_b = b.signal_a""")
oracle("v_lead_lag", f"""
with f as (select a.cohort, a.signal_id as signal_a, b.signal_id as signal_b, {r(corr('a.value', 'b.value'))} as c from @obs a join @obs b on a.cohort = b.cohort and a.signal_id <> b.signal_id and a.s0 = b.s0 + 10 group by all),
     b as (select a.cohort, a.signal_id as signal_a, b.signal_id as signal_b, {r(corr('a.value', 'b.value'))} as c from @obs a join @obs b on a.cohort = b.cohort and a.signal_id <> b.signal_id and a.s0 = b.s0 - 10 group by all)
select cohort, signal_a, signal_b, f.c as corr_forward, b.c as corr_backward, {r('f.c - b.c')} as lead_lag_asymmetry, case when f.c > b.c + 0.1 then 'A_leads_B' when b.c > f.c + 0.1 then 'B_leads_A' else 'contemporaneous' end as lead_lag_direction from f join b using (cohort, signal_a, signal_b)""")
view("v_coupling_network", """
select cohort, signal_a as source, signal_b as target, optimal_correlation as weight, optimal_abs_correlation as abs_weight, optimal_lag as lag, coupling_strength, case when optimal_correlation > 0 then 'positive' else 'negative' end as edge_type
from @v_optimal_lag where optimal_abs_correlation > 0.3""")
view("v_node_degree", f"""
select cohort, signal_id, count(*) as degree, {r('sum(abs_weight)')} as weighted_degree, {r('avg(abs_weight)')} as avg_coupling_strength
from (select cohort, source as signal_id, abs_weight from @v_coupling_network union all select cohort, target, abs_weight from @v_coupling_network) x group by cohort, signal_id""")
view("v_directional_degree", f"""
-- a row counts once for the leader and once for the follower
select cohort, signal_id, out_degree, in_degree, out_degree - in_degree as net_influence, {first_of(('out_degree > in_degree * 2', 'driver'), ('in_degree > out_degree * 2', 'follower'), other='bidirectional')} as influence_type
from (select cohort, signal_id, sum(leads) as out_degree, sum(1 - leads) as in_degree from (select cohort, signal_a as signal_id, 1 as leads from @v_lead_lag where lead_lag_direction = 'A_leads_B' union all select cohort, signal_b, 0 from @v_lead_lag where lead_lag_direction = 'A_leads_B') x group by cohort, signal_id) y""")
oracle("v_directional_degree", """
with l as (select cohort, signal_a as signal_id, count(*) as n from @v_lead_lag where lead_lag_direction = 'A_leads_B' group by all), f as (select cohort, signal_b as signal_id, count(*) as n from @v_lead_lag where lead_lag_direction = 'A_leads_B' group by all)
select cohort, signal_id, coalesce(l.n, 0) as out_degree, coalesce(f.n, 0) as in_degree, coalesce(l.n, 0) - coalesce(f.n, 0) as net_influence,
       case when coalesce(l.n, 0) > coalesce(f.n, 0) * 2 then 'driver' when coalesce(f.n, 0) > coalesce(l.n, 0) * 2 then 'follower' else 'bidirectional' end as influence_type from l full join f using (cohort, signal_id)""")
view("v_correlation_clusters", """
-- the smallest neighbour over strong edges, one step; graph.components has whole components
select cohort, signal_id, cluster_id, count(*) over (partition by cohort, cluster_id) as cluster_size from (
  select cohort, signal_id, min(root) as cluster_id from (select cohort, signal_a as signal_id, signal_a as root from @v_optimal_lag where optimal_abs_correlation > 0.6 union all select cohort, signal_b, signal_a from @v_optimal_lag where optimal_abs_correlation > 0.6) x group by cohort, signal_id) y""")
view("v_derivative_correlation", f"select {P}, {r(corr('da', 'db'))} as velocity_correlation, {r(corr('ca', 'cb'))} as acceleration_correlation from @pair_points where da is not null and db is not null group by {P} having count(*) > 50")
view("v_covariance_matrix", f"select {P}, {r('covar_pop(va, vb)')} as covariance from @pair_points group by {P}")
oracle("v_covariance_matrix", f"""
-- around the means of the places that the pair shares
select {P}, {r('avg((va - ma) * (vb - mb))')} as covariance from (select {P}, va, vb, avg(case when vb is not null then va end) over (partition by {P}) as ma, avg(case when va is not null then vb end) over (partition by {P}) as mb from @pair_points) x group by {P}""")
_res = "(select cohort, signal_id, s0, value - avg(value) over (partition by cohort, s0) as x from @obs)"
view("v_partial_correlation_proxy", f"""
select a.cohort, a.signal_id as signal_a, b.signal_id as signal_b, {r(corr('a.x', 'b.x'))} as partial_correlation_proxy from {_res} a join {_res} b on a.cohort = b.cohort and a.s0 = b.s0 and a.signal_id < b.signal_id group by a.cohort, a.signal_id, b.signal_id""")
view("binned", "select cohort, signal_id, s0, value, ntile(10) over (partition by cohort, signal_id order by value, s0) as bin from @obs where value is not null")
view("binned_pairs", """
select a.cohort, a.signal_id as signal_a, b.signal_id as signal_b, a.bin as bin_a, b.bin as bin_b, count(*) as n
from @binned a join @binned b on a.cohort = b.cohort and a.s0 = b.s0 and a.signal_id < b.signal_id group by a.cohort, a.signal_id, b.signal_id, a.bin, b.bin""")
view("v_mutual_info_proxy", f"""
-- marginals are counted over the pair itself
select {P}, {r('sum(1.0 * n / total * ln(1.0 * n * total / (na * nb)))')} as mutual_information_proxy
from (select {P}, n, sum(n) over (partition by {P}) as total, sum(n) over (partition by {P}, bin_a) as na, sum(n) over (partition by {P}, bin_b) as nb from @binned_pairs) x group by {P}""")
view("v_geometry_complete", f"""
select o.cohort, o.signal_a, o.signal_b, c.pearson_correlation as instant_correlation, o.optimal_lag, o.optimal_correlation, o.coupling_strength, l.lead_lag_direction, l.lead_lag_asymmetry, d.velocity_correlation, d.acceleration_correlation, p.partial_correlation_proxy, m.mutual_information_proxy
from @v_optimal_lag o left join @v_correlation_matrix c on {_pair('o', 'c')} left join @v_lead_lag l on {_pair('o', 'l')} left join @v_derivative_correlation d on {_pair('o', 'd')} left join @v_partial_correlation_proxy p on {_pair('o', 'p')} left join @v_mutual_info_proxy m on {_pair('o', 'm')}""")
view("line_correlations", f"""
-- the four measures of a line share its place: all six pairs in one aggregation, without a join
select cohort, {r(corr('l_quantity', 'l_extendedprice'))} as quantity_price, {r(corr('l_quantity', 'l_discount'))} as quantity_discount, {r(corr('l_quantity', 'l_tax'))} as quantity_tax,
       {r(corr('l_extendedprice', 'l_discount'))} as price_discount, {r(corr('l_extendedprice', 'l_tax'))} as price_tax, {r(corr('l_discount', 'l_tax'))} as discount_tax from @obs_lines_wide group by cohort""")

# --- causality ---------------------------------------------------------------------------------------------------
_back = lambda n: f"lag(value, {n}) over (partition by cohort, signal_id order by s0)"
view("v_granger_proxy", f"""
select x.cohort, x.source, x.target, {r('x.cross_r')} as cross_prediction, {r('o.own')} as target_self_prediction, {r('abs(x.cross_r) - abs(o.own)')} as granger_score, coalesce(abs(x.cross_r) > abs(o.own) + 0.1, false) as granger_causes
from (select p.cohort, p.signal_id as source, t.signal_id as target, {corr('t.value', 'p.l10')} as cross_r from (select cohort, signal_id, s0, {_back(10)} as l10 from @obs) p join @obs t on p.cohort = t.cohort and p.s0 = t.s0 and p.signal_id <> t.signal_id where p.l10 is not null group by p.cohort, p.signal_id, t.signal_id) x
join (select cohort, signal_id, {corr('value', 'l10')} as own from (select cohort, signal_id, value, {_back(10)} as l10 from @obs) y where l10 is not null group by cohort, signal_id) o on x.cohort = o.cohort and x.target = o.signal_id""")
view("v_bidirectional_causality", f"""
select a.cohort, a.source as signal_a, a.target as signal_b, a.granger_score as score_a_to_b, b.granger_score as score_b_to_a, a.granger_causes as a_causes_b, b.granger_causes as b_causes_a,
       {first_of(('a.granger_causes and not b.granger_causes', 'A_causes_B'), ('b.granger_causes and not a.granger_causes', 'B_causes_A'), ('a.granger_causes and b.granger_causes', 'bidirectional'), other='no_causation')} as causal_direction, {r('a.granger_score - coalesce(b.granger_score, 0)')} as net_causal_flow
from @v_granger_proxy a left join @v_granger_proxy b on a.cohort = b.cohort and a.source = b.target and a.target = b.source""")
view("bin_steps", f"""
select cohort, signal_id, s0, cast(bin - coalesce(lag(bin) over (partition by cohort, signal_id order by s0), bin) as double) as step
from (select cohort, signal_id, s0, ntile(5) over (partition by cohort, signal_id order by value nulls last, s0) as bin from (select cohort, signal_id, s0, value, {_back(1)} as l1 from @obs) x where l1 is not null) y""")
view("v_transfer_entropy_proxy", f"""
select a.cohort, a.signal_id as source, b.signal_id as target, {r(corr('a.step', 'b.step'))} as change_correlation, {r('abs(' + corr('a.step', 'b.step') + ')')} as transfer_entropy_proxy
from @bin_steps a join (select cohort, signal_id, s0 + 5 as s0, step from @bin_steps) b on a.cohort = b.cohort and a.s0 = b.s0 and a.signal_id <> b.signal_id group by a.cohort, a.signal_id, b.signal_id""")
view("v_causal_roles", f"""
-- signals that cause or are caused; the flow is over all of a signal's pairs
select d.cohort, d.signal_id, d.out_degree, d.in_degree, d.out_degree - d.in_degree as net_influence, coalesce(f.flow, 0.0) as total_causal_flow,
       {first_of(('d.in_degree = 0', 'SOURCE'), ('d.out_degree = 0', 'SINK'), other='CONDUIT')} as causal_role
from (select cohort, signal_id, sum(causes) as out_degree, sum(1 - causes) as in_degree from (select cohort, signal_a as signal_id, 1 as causes from @v_bidirectional_causality where a_causes_b union all select cohort, signal_b, 0 from @v_bidirectional_causality where a_causes_b) x group by cohort, signal_id) d
left join (select cohort, signal_a as signal_id, {r('sum(net_causal_flow)')} as flow from @v_bidirectional_causality group by cohort, signal_a) f on d.cohort = f.cohort and d.signal_id = f.signal_id""")
oracle("v_causal_roles", """
with o as (select cohort, signal_a as signal_id, count(*) as n from @v_bidirectional_causality where causal_direction in ('A_causes_B', 'bidirectional') group by all),
     i as (select cohort, signal_b as signal_id, count(*) as n from @v_bidirectional_causality where causal_direction in ('A_causes_B', 'bidirectional') group by all),
     d as (select cohort, signal_id, coalesce(o.n, 0) as a, coalesce(i.n, 0) as b from o full join i using (cohort, signal_id)), t as (select cohort, signal_a as signal_id, sum(net_causal_flow) as flow from @v_bidirectional_causality group by all)
select cohort, signal_id, a as out_degree, b as in_degree, a - b as net_influence, round(coalesce(flow, 0), 6) as total_causal_flow,
       case when a > b * 2 and b = 0 then 'SOURCE' when b > a * 2 and a = 0 then 'SINK' when a > 0 and b > 0 then 'CONDUIT' when a > b then 'DRIVER' when b > a then 'FOLLOWER' else 'ISOLATED' end as causal_role from d left join t using (cohort, signal_id)""")
view("v_causal_chains", """
select a.cohort, a.signal_a as root, a.signal_b as middle, b.signal_b as leaf, concat(a.signal_a, ' -> ', a.signal_b, ' -> ', b.signal_b) as chain_path
from @v_bidirectional_causality a join @v_bidirectional_causality b on a.cohort = b.cohort and a.signal_b = b.signal_a and a.signal_a <> b.signal_b where a.causal_direction = 'A_causes_B' and b.causal_direction = 'A_causes_B'""")
view("strong_moves", """
select cohort, signal_id, s0, cast(floor(s0 / 50) as bigint) as block from (select cohort, signal_id, s0, percent_rank() over (partition by cohort, signal_id order by abs(d1)) as p from @calc where d1 is not null) x where p > 0.95""")
view("v_causal_timing", f"""
-- moves of other signals within the next 50 places: they lie in the same block of 50 or the next
select s.cohort, s.signal_id as source, t.signal_id as target, {r('avg(t.s0 - s.s0)')} as avg_response_lag, min(t.s0 - s.s0) as min_response_lag, count(*) as n_linked_events
from (select cohort, signal_id, s0, block + step as block from (select cohort, signal_id, s0, block, #each(0, 1) as step from @strong_moves) m) s join @strong_moves t on s.cohort = t.cohort and s.block = t.block and s.signal_id <> t.signal_id
where t.s0 > s.s0 and t.s0 < s.s0 + 50 group by s.cohort, s.signal_id, t.signal_id having count(*) > 5""")
oracle("v_causal_timing", f"""
select s.cohort, s.signal_id as source, t.signal_id as target, {r('avg(t.s0 - s.s0)')} as avg_response_lag, min(t.s0 - s.s0) as min_response_lag, count(*) as n_linked_events
from @strong_moves s join @strong_moves t on s.cohort = t.cohort and s.signal_id <> t.signal_id and t.s0 > s.s0 and t.s0 < s.s0 + 50 group by all having count(*) > 5""")
view("v_intervention_effects", f"""
-- what a signal has changed by over ten places, after shocks of another within 30; the change is taken before shocks meet it
select s.cohort, s.signal_id as source, t.signal_id as target, {r('avg(t.s0 - s.s0)')} as avg_response_lag, {r(corr('s.change_score', 't.step'))} as intervention_correlation, count(*) as n_interventions
from (select cohort, signal_id, s0, change_score, home + step as block from (select cohort, signal_id, s0, change_score, cast(floor(s0 / 30) as bigint) as home, #each(0, 1) as step from @v_regime_changes where is_regime_change) m) s
join (select cohort, signal_id, s0, value - {_back(10)} as step, cast(floor(s0 / 30) as bigint) as block from @obs) t on s.cohort = t.cohort and s.block = t.block and s.signal_id <> t.signal_id
where t.s0 > s.s0 and t.s0 < s.s0 + 30 and t.step is not null group by s.cohort, s.signal_id, t.signal_id having count(*) > 3""")
view("v_root_cause_candidates", """
-- changes of other signals in the 50 places before a change
select e.cohort, e.signal_id as target, p.signal_id as candidate_source, e.s0 as target_change_at, p.s0 as source_changed_at, e.s0 - p.s0 as lead_time, g.source is not null as has_granger_support
from (select cohort, signal_id, s0, cast(floor(s0 / 50) as bigint) as block from @v_regime_changes where is_regime_change) e
join (select cohort, signal_id, s0, home + step as block from (select cohort, signal_id, s0, cast(floor(s0 / 50) as bigint) as home, #each(0, 1) as step from @v_regime_changes where is_regime_change) m) p on e.cohort = p.cohort and e.block = p.block and e.signal_id <> p.signal_id
left join (select cohort, source, target from @v_granger_proxy where granger_causes) g on e.cohort = g.cohort and p.signal_id = g.source and e.signal_id = g.target where p.s0 < e.s0 and p.s0 > e.s0 - 50""")
view("v_causal_strength", f"""
select c.cohort, c.signal_a as source, c.signal_b as target, c.causal_direction, c.score_a_to_b as granger_score, o.optimal_correlation as coupling_strength, o.optimal_lag as coupling_lag, t.transfer_entropy_proxy,
       {r('(coalesce(abs(c.score_a_to_b), 0) + coalesce(abs(o.optimal_correlation), 0) + coalesce(t.transfer_entropy_proxy, 0)) / 3')} as combined_causal_strength
from @v_bidirectional_causality c left join @v_optimal_lag o on {_pair('c', 'o')} left join @v_transfer_entropy_proxy t on c.cohort = t.cohort and c.signal_a = t.source and c.signal_b = t.target where c.causal_direction in ('A_causes_B', 'bidirectional')""")
view("v_causal_graph", """
-- strong couplings join the graph where no causal strength is known either way round
select cohort, source, target, combined_causal_strength as weight, granger_score, coupling_strength, coupling_lag as lag, 'causal' as edge_type from @v_causal_strength where combined_causal_strength > 0.2
union all select o.cohort, o.signal_a, o.signal_b, o.optimal_abs_correlation, null, o.optimal_correlation, o.optimal_lag, 'coupling' from @v_optimal_lag o
left join (select distinct cohort, least(source, target) as lo, greatest(source, target) as hi from @v_causal_strength) k on o.cohort = k.cohort and least(o.signal_a, o.signal_b) = k.lo and greatest(o.signal_a, o.signal_b) = k.hi where o.optimal_abs_correlation > 0.5 and k.lo is null""")
view("v_causality_complete", """
select r.cohort, r.signal_id, r.causal_role, r.out_degree, r.in_degree, r.net_influence, r.total_causal_flow, d.drives, b.driven_by from @v_causal_roles r
left join (select cohort, source, #list(target; ', ') as drives from @v_causal_strength group by cohort, source) d on r.cohort = d.cohort and r.signal_id = d.source
left join (select cohort, target, #list(source; ', ') as driven_by from @v_causal_strength group by cohort, target) b on r.cohort = b.cohort and r.signal_id = b.target""")
view("v_system_causal_structure", f"""
select n.n_sources, n.n_sinks, n.n_conduits, n.n_isolated, e.n_edges, s.n_nodes, {r(div('1.0 * e.n_edges', 's.n_nodes * (s.n_nodes - 1)'))} as causal_density, case when c.n_chains > 0 then 3 end as max_chain_depth, t.top_sources
from (select count(*) filter (where causal_role = 'SOURCE') as n_sources, count(*) filter (where causal_role = 'SINK') as n_sinks, count(*) filter (where causal_role = 'CONDUIT') as n_conduits, count(*) filter (where causal_role = 'ISOLATED') as n_isolated from @v_causal_roles) n
cross join (select count(*) as n_edges from @v_causal_graph) e cross join (select count(distinct signal_id) as n_nodes from @obs) s cross join (select count(*) as n_chains from @v_causal_chains) c
cross join (select #list(signal_id; ', ') as top_sources from (select signal_id, row_number() over (order by total_causal_flow desc, cohort, signal_id) as k from @v_causal_roles where causal_role in ('SOURCE', 'DRIVER')) x where k <= 3) t""")

# --- entropy -----------------------------------------------------------------------------------------------------
_h = lambda n, total: f"-sum(1.0 * {n} / {total} * ln(1.0 * {n} / {total} + 1e-10))"
_tiles = lambda src, x, k, extra="": f"select cohort, signal_id{extra}, bin, count(*) as n, sum(count(*)) over (partition by cohort, signal_id{extra}) as total from (select cohort, signal_id{extra}, ntile({k}) over (partition by cohort, signal_id{extra} order by {x}, s0) as bin from {src} where {x} is not null) t group by cohort, signal_id{extra}, bin"
view("v_binned_distribution", f"select cohort, signal_id, bin as bin_id, n as bin_count, total as total_count, {r('1.0 * n / total', 9)} as probability from ({_tiles('@obs', 'value', 20)}) x")
view("v_shannon_entropy", f"""
select cohort, signal_id, {r('h')} as shannon_entropy, {r('h / ln(20)')} as normalized_entropy, {ladder('h / ln(20)', '>', (0.9, 'high_entropy'), (0.5, 'medium_entropy'), other='low_entropy')} as entropy_category
from (select cohort, signal_id, -sum(probability * ln(probability + 1e-10)) as h from @v_binned_distribution group by cohort, signal_id) x""")
view("v_derivative_entropy", f"select cohort, signal_id, {r(_h('n', 'total'))} as derivative_entropy from ({_tiles('@calc', 'd1', 20)}) x group by cohort, signal_id")
view("v_joint_entropy", f"""
-- ten by ten bins of the values that the pair shares; probabilities are within the pair
select {P}, {r(_h('n', 'total'))} as joint_entropy from (select {P}, n, sum(n) over (partition by {P}) as total from @binned_pairs) x group by {P}""")
view("v_conditional_entropy", f"""
select j.cohort, j.signal_a, j.signal_b, j.joint_entropy, a.shannon_entropy as entropy_a, b.shannon_entropy as entropy_b, {r('j.joint_entropy - a.shannon_entropy')} as conditional_entropy_b_given_a, {r('j.joint_entropy - b.shannon_entropy')} as conditional_entropy_a_given_b
from @v_joint_entropy j join @v_shannon_entropy a on j.cohort = a.cohort and j.signal_a = a.signal_id join @v_shannon_entropy b on j.cohort = b.cohort and j.signal_b = b.signal_id""")
view("v_mutual_information", f"select {P}, {r('entropy_a + entropy_b - joint_entropy', 5)} as mutual_information, {r(div('entropy_a + entropy_b - joint_entropy', 'least(entropy_a, entropy_b)'), 5)} as normalized_mutual_info from @v_conditional_entropy")
view("v_permutation_entropy", f"""
select cohort, signal_id, {r('h')} as permutation_entropy, {r('h / ln(6)')} as normalized_permutation_entropy, {first_of(('h / ln(6) > 0.9', 'random'), ('h / ln(6) < 0.5', 'structured'), other='mixed')} as complexity_category
from (select cohort, signal_id, {_h('n', 'total')} as h from (select cohort, signal_id, pattern, count(*) as n, sum(count(*)) over (partition by cohort, signal_id) as total from (
  select cohort, signal_id, case when a = b or b = c or a = c then null else concat(cast(case when a > b then 1 else 0 end as #string), cast(case when a > c then 1 else 0 end as #string), cast(case when b > c then 1 else 0 end as #string)) end as pattern
  from (select cohort, signal_id, value as a, lead(value) over (partition by cohort, signal_id order by s0) as b, lead(value, 2) over (partition by cohort, signal_id order by s0) as c from @obs) x where c is not null) y
  where pattern is not null group by cohort, signal_id, pattern) z group by cohort, signal_id) w""")
view("v_approx_entropy_proxy", f"""
select cohort, signal_id, {r(_h('n', 'total'))} as approx_entropy_proxy from (
  select cohort, signal_id, word, count(*) as n, sum(count(*)) over (partition by cohort, signal_id) as total from (
    select cohort, signal_id, 4 * bit + 2 * lead(bit) over (partition by cohort, signal_id order by s0) + lead(bit, 2) over (partition by cohort, signal_id order by s0) as word
    from (select cohort, signal_id, s0, case when value > avg(value) over (partition by cohort, signal_id order by s0 rows between 2 preceding and 2 following) then 1 else 0 end as bit from @obs) x) y
  where word is not null group by cohort, signal_id, word) z group by cohort, signal_id""")
_add = lambda part, begin="cast(0 as double)": f"aggregate({part}, {begin}, (t, v) -> t + v)"
_block = lambda k: f"case when blocks > {k} then {_add(f'slice(around, before + {16 * k + 1}, 16)')} else 0 end"
_mean = div(_add("slice(around, before + 16 * blocks + 1, 41)", f"{_add('slice(around, 1, before)')} + {_block(0)} + {_block(1)}"), "n")
view("frequency_ratio", f"""
-- Where the mean meets the value, or the quotient is a half, the last bit of the mean decides. So the 41 places are added up in
-- the order of DuckDB 2.0.0: those before the first whole block of 16, each block's own sum, those after. Blocks are counted
-- over a bin, in which partitions lie one after the other by key; there are 16 bins, then four times as many until a bin has at
-- most 122,880 rows on average. Any order gives a mean as good; where another version adds up in another one, only such rows change.
select cohort, signal_id, s0, #round(ratio; 4) as ratio from (
  select cohort, signal_id, s0, {div('abs(d2)', f'abs(value - {_mean})')} as ratio from (
    select *, greatest(cast(floor((size(around) - before) / 16) as int), 0) as blocks from (
      select a.cohort, a.signal_id, s0, value, d2, around, n, cast(pmod(-(greatest(place - 20, 0) + coalesce(start, 0)), 16) as int) as before from (
        select cohort, signal_id, s0, value, d2, collect_list(coalesce(value, 0)) over w as around, count(value) over w as n, row_number() over (partition by cohort, signal_id order by s0) - 1 as place
        from @calc window w as (partition by cohort, signal_id order by s0 rows between 20 preceding and 20 following)) a
      left join (
        select cohort, signal_id, sum(size) over (partition by shiftright(hash, 48 - bits) order by cohort, signal_id rows between unbounded preceding and 1 preceding) as start from (
          select cohort, signal_id, size, duckdb_hash(cohort, signal_id) as hash, coalesce(element_at(filter(sequence(4, 10, 2), b -> shiftright(total, b) <= 122880), 1), 10) as bits from (
            select cohort, signal_id, count(*) as size, sum(count(*)) over () as total from @calc group by cohort, signal_id) k) h) b on a.cohort = b.cohort and a.signal_id = b.signal_id
      where d2 is not null) c) d) e""")
oracle("frequency_ratio", f"""
select cohort, signal_id, s0, {r(div('abs(d2)', 'abs(value - local)'), 4)} as ratio from (select cohort, signal_id, s0, value, d2, avg(value) over (partition by cohort, signal_id order by s0 rows between 20 preceding and 20 following) as local from @calc) x where d2 is not null""")
view("v_spectral_entropy_proxy", f"select cohort, signal_id, {r(_h('n', 'total'))} as spectral_entropy_proxy from ({_tiles('@frequency_ratio', 'ratio', 10)}) x group by cohort, signal_id")
view("v_rolling_entropy", f"""
-- entropy of the ten levels of a signal over the 101 places around each
select cohort, signal_id, s0, {r('-(' + ' + '.join(f'case when c{k} > 0 then 1.0 * c{k} / n * ln(1.0 * c{k} / n) else 0.0 end' for k in range(1, 11)) + ')')} as rolling_entropy
from (select cohort, signal_id, s0, {', '.join(f'count(case when bin = {k} then 1 end) over w as c{k}' for k in range(1, 11))}, count(*) over w as n from @binned window w as (partition by cohort, signal_id order by s0 rows between 50 preceding and 50 following)) x""")
view("v_information_gain", f"""
-- halves of the axis, each binned by its own values
select cohort, signal_id, {r('max(h) filter (where half = 1)')} as first_half_entropy, {r('max(h) filter (where half = 2)')} as second_half_entropy, {r('max(h) filter (where half = 2) - max(h) filter (where half = 1)')} as information_gain
from (select cohort, signal_id, half, {_h('n', 'total')} as h from ({_tiles('(select cohort, signal_id, s0, value, case when s0 <= max(s0) over (partition by cohort, signal_id) / 2 then 1 else 2 end as half from @obs) o', 'value', 20, ', half')}) z group by cohort, signal_id, half) w group by cohort, signal_id""")
view("v_entropy_complete", """
select s.cohort, s.signal_id, s.shannon_entropy, s.normalized_entropy, s.entropy_category, d.derivative_entropy, p.permutation_entropy, p.complexity_category, a.approx_entropy_proxy, e.spectral_entropy_proxy, g.information_gain
from @v_shannon_entropy s left join @v_derivative_entropy d on s.cohort = d.cohort and s.signal_id = d.signal_id left join @v_permutation_entropy p on s.cohort = p.cohort and s.signal_id = p.signal_id left join @v_approx_entropy_proxy a on s.cohort = a.cohort and s.signal_id = a.signal_id
left join @v_spectral_entropy_proxy e on s.cohort = e.cohort and s.signal_id = e.signal_id left join @v_information_gain g on s.cohort = g.cohort and s.signal_id = g.signal_id""")

# --- windowed correlations ---------------------------------------------------------------------------------------
view("pairwise_windowed", f"""
select {P}, tile, count(*) as n, {r(corr('va', 'vb'))} as correlation from (select {P}, va, vb, cast(floor(s0 / 25) as bigint) as tile from @pair_points) x group by {P}, tile having count(*) >= 10""")
view("correlation_stability", f"""
select {P}, count(correlation) as n_tiles, {r('avg(correlation)', 9)} as mean_correlation, {r('stddev_samp(correlation)', 9)} as std_correlation, {r(div('covar_pop(correlation, tile)', 'var_pop(case when correlation is not null then tile end)'), 9)} as trend, min(correlation) as min_correlation, max(correlation) as max_correlation,
       case when stddev_samp(correlation) < 0.1 then 'stable' when stddev_samp(correlation) < 0.3 then 'variable' else 'unstable' end as stability from @pairwise_windowed group by {P}""")
view("coupling_progression", "select cohort, tile, count(*) as n_pairs, count(*) filter (where abs(correlation) > 0.2) as n_strong from @pairwise_windowed group by cohort, tile")
view("signal_correlations", f"select c.cohort, c.signal_a, c.signal_b, c.correlation, s.mean_correlation, s.stability from @pairwise_full c left join @correlation_stability s on {_pair('c', 's')}")
view("pairwise_full", f"""
-- pairs of signals that are not constant
select p.cohort, p.signal_a, p.signal_b, count(*) as n, {r(corr('p.va', 'p.vb'))} as correlation from @pair_points p
join (select cohort, signal_id from @signal_statistics where continuity <> 'constant') a on p.cohort = a.cohort and p.signal_a = a.signal_id join (select cohort, signal_id from @signal_statistics where continuity <> 'constant') b on p.cohort = b.cohort and p.signal_b = b.signal_id group by p.cohort, p.signal_a, p.signal_b""")
view("v_redundant_pairs", f"""
select least(signal_a, signal_b) as sig_lo, greatest(signal_a, signal_b) as sig_hi, {r('avg(abs(correlation))', 9)} as mean_abs_corr, count(*) as n_observations from @signal_pairwise where correlation is not null group by least(signal_a, signal_b), greatest(signal_a, signal_b) having avg(abs(correlation)) > 0.99""")
view("v_coupling_ranked", f"""
select c.cohort, c.signal_a, c.signal_b, c.signal_0_end, c.correlation, abs(c.correlation) as coupling_magnitude, c.coupling_rank, {r('c.correlation - c.before', 9)} as coupling_delta, coalesce(abs(c.correlation - c.before) > 1.0, false) as is_sign_flip
from (select cohort, signal_a, signal_b, signal_0_end, correlation, {rank('abs(correlation)', 'cohort, window_index')} as coupling_rank, lag(correlation) over (partition by {P} order by window_index) as before from @signal_pairwise where correlation is not null) c
left join @v_redundant_pairs d on least(c.signal_a, c.signal_b) = d.sig_lo and greatest(c.signal_a, c.signal_b) = d.sig_hi where d.sig_lo is null""")
