"""Queries over the operators that SQL cannot express, or that run as functions over grouped rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import store
from ..plans import constants, dag, geometry, pairs, report_queries, report_state, reports, signals, summaries  # noqa: F401  the modules define the views
from ..sources import readers
from ..streaming import analyzer
from . import fleet, graph, interp, kernels, regimes, relational, typology, windows

GEOMETRY = ["rms", "peak", "roc_std", "trend_slope", "hurst_exponent", "spectral_entropy", "permutation_entropy"]
GEOMETRY_ENGINES = ("rms", "peak", "rate_of_change", "trend", "hurst", "spectral", "complexity")


def signal_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.signal_vector(dag.run(spark, sf_dir, "obs"))


def eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.eigendecomposition(windows.signal_vector(dag.run(spark, sf_dir, "obs"), names=GEOMETRY_ENGINES), GEOMETRY)


def cohort_eigen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eigen(spark, sf_dir).select("*", *[F.col("eigenvalues")[i].alias(f"eigenvalue_{i}") for i in range(3)]).drop("eigenvalues", "columns", "loadings")


def geometry_dynamics(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = kernels.central(cohort_eigen(spark, sf_dir), ["cohort"], "window_index", ["effective_dim", "eigenvalue_0", "condition_number", "total_variance"])
    return moved.join(kernels.collapse(moved, ["cohort"], "window_index", "effective_dim_velocity"), "cohort")


def brittleness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernels.brittleness(cohort_eigen(spark, sf_dir))


def ftle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.ftle(dag.run(spark, sf_dir, "obs"))


def granger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.granger(dag.run(spark, sf_dir, "obs"))


def rolling_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.rolling_spearman(dag.run(spark, sf_dir, "pair_points")).withColumn("spearman", F.round("spearman", 6))


SPEARMAN_SQL = f"""
with p as ({dag.text('pair_points', 'duckdb')}), w as (
  select cohort, signal_a, signal_b, s0, list(va) over last_rows as xs, list(vb) over last_rows as ys, count(*) over last_rows as n from p
  window last_rows as (partition by cohort, signal_a, signal_b order by s0 rows between 19 preceding and current row)),
v as (select cohort, signal_a, signal_b, s0, unnest(xs) as x, unnest(ys) as y from w where n = 20 and len(xs) = 20),
k as (select *, rank() over (partition by cohort, signal_a, signal_b, s0 order by x) + (count(*) over (partition by cohort, signal_a, signal_b, s0, x) - 1) / 2.0 as rx,
             rank() over (partition by cohort, signal_a, signal_b, s0 order by y) + (count(*) over (partition by cohort, signal_a, signal_b, s0, y) - 1) / 2.0 as ry from v)
select cohort, signal_a, signal_b, s0, round(case when var_pop(rx) * var_pop(ry) > 0 then covar_pop(rx, ry) / sqrt(var_pop(rx) * var_pop(ry)) end, 6) as spearman from k group by 1, 2, 3, 4"""


def coupling_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = dag.run(spark, sf_dir, "v_coupling_network").filter("abs_weight > 0.3")
    store.shared_dir(spark)
    return graph.components(e.select(F.concat_ws("/", "cohort", "source").alias("a"), F.concat_ws("/", "cohort", "target").alias("b")))


COMPONENTS_SQL = f"""
with recursive n as ({dag.text('v_coupling_network', 'duckdb')}),
e as (select cohort || '/' || source as a, cohort || '/' || target as b from n where abs_weight > 0.3), both_ways as (select a, b from e union select b, a from e),
reach(id, other) as (select a, a from both_ways union select r.id, w.b from reach r join both_ways w on r.other = w.a)
select id, min(other) as component from reach group by id"""


def operating_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = dag.run(spark, sf_dir, "obs_lines_wide")
    return regimes.detect(w, ["l_quantity", "l_discount"]).groupBy("cohort", "regime_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("mean_quantity"))


def rounded_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = regimes.identify(dag.run(spark, sf_dir, "obs_lines_wide"), ["l_discount", "l_tax"])
    return w.groupBy("cohort", "regime").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 6).alias("mean_quantity"))


ROUNDED_SQL = f"""
with w as ({dag.text('obs_lines_wide', 'duckdb')})
select cohort, coalesce(cast(cast(round(l_discount, 2) as double) as varchar), 'none') || '|' || coalesce(cast(cast(round(l_tax, 2) as double) as varchar), 'none') as regime, count(*) as n, round(avg(l_quantity), 6) as mean_quantity from w group by 1, 2"""


def cohort_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fleet.cohort_discovery(dag.run(spark, sf_dir, "obs")).withColumn("mean_abs_corr", F.round("mean_abs_corr", 8))


DISCOVERY_SQL = f"""
with o as (select signal_id, s0, cohort, avg(value) as v from ({dag.text('obs', 'duckdb')}) x where value is not null group by 1, 2, 3),
p as (select a.signal_id, a.cohort as x, b.cohort as y, case when var_pop(a.v) * var_pop(b.v) > 0 then abs(covar_pop(a.v, b.v) / sqrt(var_pop(a.v) * var_pop(b.v))) end as r
      from o a join o b on a.signal_id = b.signal_id and a.s0 = b.s0 and a.cohort < b.cohort group by 1, 2, 3 having count(*) >= 3),
m as (select signal_id, avg(r) as r, count(*) as n from p group by 1), f as (select signal_id, max(s) as top from (select signal_id, cohort, stddev_pop(v) as s from o group by 1, 2) z group by 1)
select f.signal_id, round(m.r, 8) as mean_abs_corr, coalesce(m.n, 0) as n_pairs,
       case when f.top < 1e-10 or m.r >= 0.99 then 'CONSTANT' when m.r >= 0.70 then 'SYSTEM' when m.r < 0.50 then 'COMPONENT' when m.r is null then 'UNKNOWN' else 'MIXED' end as kind from f left join m on f.signal_id = m.signal_id"""


def early_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = fleet.early_fingerprint(dag.run(spark, sf_dir, "obs"))
    return f.select("cohort", "signal_id", "n_early", *[F.round(c, 6).alias(c) for c in f.columns[3:]])


FINGERPRINT_SQL = f"""
with o as (select cohort, signal_id, s0, value, row_number() over w as k, value - lag(value) over w as step, count(*) over (partition by cohort, signal_id) as n from ({dag.text('obs', 'duckdb')}) x where value is not null window w as (partition by cohort, signal_id order by s0))
select cohort, signal_id, count(*) as n_early, round(avg(value), 6) as early_mean, round(stddev_samp(value), 6) as early_std, round(covar_pop(k, value) / nullif(var_pop(k), 0), 6) as early_slope, round(stddev_samp(step), 6) as early_volatility, round(greatest(max(value) - avg(value), avg(value) - min(value)), 6) as early_extent
from o where k <= greatest(2, ceil(n * 0.2)) group by 1, 2"""


def early_warning(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = fleet.early_warning(fleet.early_fingerprint(dag.run(spark, sf_dir, "obs")))
    return w.withColumns({c: F.round(c, 6) for c in ("furthest_z", "risk")})


WARNING_SQL = f"""
with o as (select cohort, signal_id, s0, value, row_number() over w as k, value - lag(value) over w as step, count(*) over (partition by cohort, signal_id) as n from ({dag.text('obs', 'duckdb')}) x where value is not null window w as (partition by cohort, signal_id order by s0)),
f as (select cohort, signal_id, avg(value) as early_mean, stddev_samp(value) as early_std, covar_pop(k, value) / nullif(var_pop(k), 0) as early_slope, stddev_samp(step) as early_volatility, greatest(max(value) - avg(value), avg(value) - min(value)) as early_extent
      from o where k <= greatest(2, ceil(n * 0.2)) group by 1, 2),
l as (unpivot f on early_mean, early_std, early_slope, early_volatility, early_extent into name measure value x),
q as (select signal_id, measure, quantile_cont(x, 0.5) as middle, (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / 1.349 as wide from l group by 1, 2),
z as (select l.cohort, l.signal_id, l.measure, abs((l.x - q.middle) / q.wide) as z from l join q on l.signal_id = q.signal_id and l.measure = q.measure where q.wide <> 0),
t as (select *, row_number() over (partition by cohort order by z desc, signal_id desc, measure desc) as place from z),
c as (select cohort, count(*) as n_measures, cast(sum(case when z > 3 then 1 else 0 end) as bigint) as n_outlying, max(z) as furthest_z, max(case when place = 1 then signal_id || '.' || measure end) as furthest from t group by 1),
r as (select *, 1 - exp(-(5.0 * n_outlying / n_measures + greatest(0, furthest_z - 3) / 10)) as risk from c)
select cohort, n_measures, n_outlying, round(furthest_z, 6) as furthest_z, furthest, round(risk, 6) as risk, case when risk >= 0.75 then 'CRITICAL' when risk >= 0.5 then 'HIGH' when risk >= 0.25 then 'MEDIUM' else 'LOW' end as level from r"""


def signal_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = typology.windows(typology.overlapping(typology.corrected(typology.classified(typology.sparse_kind(typology.measures(dag.run(spark, sf_dir, "obs")))))))
    return m.withColumn("secondary", F.concat_ws(",", "secondary"))


def regime_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = dag.run(spark, sf_dir, "obs").withColumn("regime_id", F.floor(F.col("s0") / 100).cast("int"))
    return regimes.normalise(rows).select("cohort", "signal_id", "s0", "regime_id", F.round("z", 6).alias("z"))


ZSCORES_SQL = f"""
with o as ({dag.text('obs', 'duckdb')}), t as (select *, cast(floor(s0 / 100) as integer) as regime_id from o),
b as (select signal_id, regime_id, count(value) as n, avg(value) as m, stddev_samp(value) as s from t group by 1, 2), w as (select signal_id, avg(value) as wm, stddev_samp(value) as ws from t group by 1)
select t.cohort, t.signal_id, t.s0, t.regime_id, round((value - case when n < 30 or coalesce(s, 0) = 0 then wm else m end) / nullif(case when n < 30 or coalesce(s, 0) = 0 then ws else s end, 0), 6) as z
from t join b on t.signal_id = b.signal_id and t.regime_id = b.regime_id join w on t.signal_id = w.signal_id"""


def asof_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    left = e.filter("event_type = 'error'").select("user_id", "event_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", "value")
    return interp.asof(left, right, ["user_id"], "ts", "value").select("user_id", "event_id", "value_asof")


ASOF_SQL = """
select l.user_id, l.event_id, r.value as value_asof from (select * from events where event_type = 'error') l
asof left join (select * from events where event_type = 'purchase') r on l.user_id = r.user_id and l.ts >= r.ts"""


def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = analyzer.windowed(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["event_type"], "value")
    return w.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"), "least", "most")


HOURLY_SQL = "select cast(epoch(date_trunc('hour', ts)) as bigint) as window_start, event_type, count(value) as n, round(sum(value), 4) as total, min(value) as least, max(value) as most from events group by 1, 2"


def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = analyzer.sessions(spark.read.parquet(f"{sf_dir}/events.parquet"), "ts", ["user_id"])
    return s.select("user_id", F.unix_timestamp("session_start").alias("session_start"), "n")


SESSIONS_SQL = """
select user_id, cast(floor(epoch(min(ts))) as bigint) as session_start, count(*) as n from (
  select user_id, ts, sum(case when before is null or ts >= before + interval 30 minutes then 1 else 0 end) over (partition by user_id order by ts rows unbounded preceding) as k
  from (select user_id, ts, lag(ts) over (partition by user_id order by ts) as before from events) x) y group by user_id, k"""


def lines_unpivoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = dag.run(spark, sf_dir, "obs_lines_wide")
    return readers.wide(w, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "cohort", "s0")


UNPIVOT_SQL = f"""
with w as ({dag.text('obs_lines_wide', 'duckdb')})
select cohort, s0, 'l_quantity' as signal_id, l_quantity as value from w union all select cohort, s0, 'l_extendedprice', l_extendedprice from w
union all select cohort, s0, 'l_discount', l_discount from w union all select cohort, s0, 'l_tax', l_tax from w"""



def reaxis_click(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.reaxis(dag.run(spark, sf_dir, "obs").filter("value is not null"), "click")


REAXIS_SQL = f"""
with o as (select cohort, signal_id, s0, value from ({dag.text('obs', 'duckdb')}) x where value is not null),
a as (select cohort, s0, value + (row_number() over (partition by cohort, value order by s0) - 1) / (1.0 * count(*) over (partition by cohort, value)) as axis from o where signal_id = 'click')
select o.cohort, o.signal_id, a.axis as s0, o.value from o join a on o.cohort = a.cohort and o.s0 = a.s0 where o.signal_id <> 'click' union all select cohort, 'time', axis, cast(s0 as double) from a"""


def quantity_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.mode(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), ["l_linestatus", "l_returnflag"], "l_quantity")


MODES_SQL = """
with n as (select l_linestatus, l_returnflag, l_quantity, count(*) as n from lineitem where l_quantity is not null group by 1, 2, 3)
select l_linestatus, l_returnflag, l_quantity as mode, n as mode_count from n qualify row_number() over (partition by l_linestatus, l_returnflag order by n desc, l_quantity) = 1"""


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = relational.first_values(spark.read.parquet(f"{sf_dir}/orders.parquet"), ["o_custkey"], "o_orderdate", "o_orderkey", 5)
    return o.select("o_custkey", F.array_join(F.transform("first_values", lambda x: x.cast("string")), ",").alias("first_orders"))


FIRST_ORDERS_SQL = """
select o_custkey, string_agg(cast(o_orderkey as varchar), ',' order by k) as first_orders
from (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as k from orders) x where k <= 5 group by 1"""


def last_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.tail(dag.run(spark, sf_dir, "obs"), ["cohort", "signal_id"], "s0", 10).select("cohort", "signal_id", "s0", "value")


LAST_POINTS_SQL = f"select cohort, signal_id, s0, value from ({dag.text('obs', 'duckdb')}) x qualify row_number() over (partition by cohort, signal_id order by s0 desc) <= 10"


def distinct_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").agg(F.sum_distinct("l_quantity").cast("double").alias("distinct_quantity"), F.count(F.lit(1)).alias("n"))


DISTINCT_SQL = "select l_returnflag, cast(sum(distinct l_quantity) as double) as distinct_quantity, count(*) as n from lineitem group by 1"


def negative_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/lineitem.parquet").filter("l_quantity < 0").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n")).select(F.col("l_returnflag").alias("finding"), "n")
    return relational.or_default(found, finding="none", n=0)


FINDINGS_SQL = """
with f as (select l_returnflag as finding, count(*) as n from lineitem where l_quantity < 0 group by 1)
select finding, n from f union all select 'none', 0 where not exists (select 1 from f)"""


def nations_any_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, c = spark.read.parquet(f"{sf_dir}/nation.parquet"), spark.read.parquet(f"{sf_dir}/customer.parquet")
    named = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select("c_custkey", F.lower("n_name").alias("n_name"))
    return relational.lookup(named, n.select("n_name", "n_regionkey"), "n_name").groupBy("n_name", "n_regionkey").agg(F.count(F.lit(1)).alias("n"))


NATIONS_SQL = "select lower(n_name) as n_name, n_regionkey, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1, 2"

QUERIES = {f.__name__: f for f in (signal_vector, cohort_eigen, geometry_dynamics, brittleness, ftle, granger, rolling_spearman, coupling_components, operating_regimes, rounded_regimes, cohort_discovery, early_fingerprint, early_warning, signal_classes, reaxis_click, quantity_modes, first_orders, last_points, distinct_totals, negative_findings, nations_any_case, regime_zscores, asof_purchase, hourly_windows, user_sessions, lines_unpivoted)}
ORACLE = {"regime_zscores": ZSCORES_SQL, "asof_purchase": ASOF_SQL, "hourly_windows": HOURLY_SQL, "user_sessions": SESSIONS_SQL, "lines_unpivoted": UNPIVOT_SQL, "rolling_spearman": SPEARMAN_SQL, "coupling_components": COMPONENTS_SQL, "rounded_regimes": ROUNDED_SQL, "cohort_discovery": DISCOVERY_SQL, "early_fingerprint": FINGERPRINT_SQL, "early_warning": WARNING_SQL, "reaxis_click": REAXIS_SQL, "quantity_modes": MODES_SQL, "first_orders": FIRST_ORDERS_SQL, "last_points": LAST_POINTS_SQL, "distinct_totals": DISTINCT_SQL, "negative_findings": FINDINGS_SQL, "nations_any_case": NATIONS_SQL}
