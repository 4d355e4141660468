"""Fleets of cohorts: which signals they share, how a baseline is chosen, runs joined into one, warnings early in a life."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Mean |correlation| of a signal between cohorts from which it is the same everywhere, driven by the system, or under which it is its cohort's own.
SAME, SYSTEM, OWN = 0.99, 0.70, 0.50


def _corr(x: str, y: str) -> Column:
    """Pearson's r; null where a side does not vary."""
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def cohort_discovery(obs: DataFrame, least: int = 3) -> DataFrame:
    """Per signal: mean |correlation| of its series between pairs of cohorts, and its class CONSTANT, SYSTEM, MIXED or COMPONENT.

    Rows meet by (signal_id, s0); pairs are formed between cohorts at one place, and their products are summed before the shuffle by pair.
    As the mean is of absolute values, the work grows with the square of the number of cohorts that share a signal."""
    rows = obs.filter("value is not null").groupBy("signal_id", "s0", "cohort").agg(F.avg("value").alias("v"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.signal_id") == F.col("b.signal_id")) & (F.col("a.s0") == F.col("b.s0")) & (F.col("a.cohort") < F.col("b.cohort")))
    by = pairs.groupBy(F.col("a.signal_id").alias("signal_id"), F.col("a.cohort").alias("x"), F.col("b.cohort").alias("y")).agg(_corr("a.v", "b.v").alias("r"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    level = F.avg(F.abs("r"))
    flat = rows.groupBy("signal_id", "cohort").agg(F.stddev_pop("v").alias("s")).groupBy("signal_id").agg(F.max("s").alias("most"))
    out = by.groupBy("signal_id").agg(level.alias("mean_abs_corr"), F.count(F.lit(1)).alias("n_pairs")).join(flat, "signal_id", "right")
    r = F.col("mean_abs_corr")
    kind = F.when((F.col("most") < 1e-10) | (r >= SAME), "CONSTANT").when(r >= SYSTEM, "SYSTEM").when(r < OWN, "COMPONENT").when(r.isNull(), "UNKNOWN").otherwise("MIXED")
    return out.select("signal_id", "mean_abs_corr", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), kind.alias("kind"))


def within_coupling(obs: DataFrame) -> DataFrame:
    """Mean |correlation| between the signals of each cohort that share places, and whether the cohort is coupled (at least OWN)."""
    rows = obs.filter("value is not null").groupBy("cohort", "s0", "signal_id").agg(F.avg("value").alias("v"))
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.cohort") == F.col("b.cohort")) & (F.col("a.s0") == F.col("b.s0")) & (F.col("a.signal_id") < F.col("b.signal_id")))
    by = pairs.groupBy(F.col("a.cohort").alias("cohort"), F.col("a.signal_id").alias("x"), F.col("b.signal_id").alias("y")).agg(_corr("a.v", "b.v").alias("r"))
    out = by.groupBy("cohort").agg(F.avg(F.abs("r")).alias("coupling"), F.count(F.lit(1)).alias("n_pairs"))
    return out.withColumn("is_coupled", F.coalesce(F.col("coupling") >= OWN, F.lit(False)))


def series_faults(obs: DataFrame, duplicate: float = 0.999, orphan: float = 0.1) -> DataFrame:
    """Signals that are constant, nearly so, copies of another of their cohort or unlike all others: (cohort, signal_id, fault, other)."""
    rows = obs.filter("value is not null")
    s = rows.groupBy("cohort", "signal_id").agg(F.stddev_pop("value").alias("s"), F.avg("value").alias("m"))
    flat = F.when(F.col("s") < 1e-10, "constant").when(F.try_divide(F.col("s"), F.abs("m")) < 1e-6, "near_constant")
    a, b = rows.alias("a"), rows.alias("b")
    r = a.join(b, (F.col("a.cohort") == F.col("b.cohort")) & (F.col("a.s0") == F.col("b.s0")) & (F.col("a.signal_id") < F.col("b.signal_id"))).groupBy(F.col("a.cohort").alias("cohort"), F.col("a.signal_id").alias("x"), F.col("b.signal_id").alias("y")).agg(F.abs(_corr("a.value", "b.value")).alias("r"))
    r = r.filter("r is not null")
    twin = r.filter(F.col("r") >= duplicate).select("cohort", F.col("y").alias("signal_id"), F.lit("duplicate").alias("fault"), F.col("x").alias("other"))
    each = r.select("cohort", F.explode(F.array("x", "y")).alias("signal_id"), "r").groupBy("cohort", "signal_id").agg(F.max("r").alias("r")).filter(F.col("r") < orphan)
    alone = each.select("cohort", "signal_id", F.lit("orphan").alias("fault"), F.lit(None).cast("string").alias("other"))
    return s.withColumn("fault", flat).filter("fault is not null").select("cohort", "signal_id", "fault", F.lit(None).cast("string").alias("other")).unionByName(twin).unionByName(alone)


def baseline_rows(geometry: DataFrame, mode: str = "first", share: float = 0.1, metric: str = "effective_dim", reference: str | None = None) -> DataFrame:
    """Windows of each cohort that its baseline is taken from: its first or last `share`, all, the `share` where `metric` is highest (`discover`), or those of the cohort `reference` for every cohort."""
    w = W.partitionBy("cohort")
    if mode == "all":
        return geometry
    if mode == "reference":
        return geometry.filter(F.col("cohort") == reference)
    order = {"first": F.col("window_index"), "last": F.col("window_index").desc(), "discover": F.col(metric).desc_nulls_last()}[mode]
    k, n = F.row_number().over(w.orderBy(order, "window_index")), F.count(F.lit(1)).over(w)
    return geometry.withColumn("__k", k).withColumn("__n", n).filter(F.col("__k") <= F.greatest(F.lit(1), F.floor(F.col("__n") * share))).drop("__k", "__n")


def against_baseline(geometry: DataFrame, metrics: list[str], **how) -> DataFrame:
    """geometry with `<metric>_z` by baseline_rows' mean and deviation."""
    base, fleet = baseline_rows(geometry, **how), how.get("mode") == "reference"
    made = [x for m in metrics for x in (F.avg(m).alias(f"{m}__m"), F.stddev_samp(m).alias(f"{m}__s"))]
    joined = geometry.crossJoin(F.broadcast(base.agg(*made))) if fleet else geometry.join(base.groupBy("cohort").agg(*made), "cohort", "left")
    return joined.withColumns({f"{m}_z": F.try_divide(F.col(m) - F.col(f"{m}__m"), F.col(f"{m}__s")) for m in metrics}).select(*geometry.columns, *[f"{m}_z" for m in metrics])


def compiled_runs(runs: dict[str, DataFrame]) -> DataFrame:
    """The rows of several runs, `run_id` first; columns that a run lacks are null."""
    out = None
    for name, rows in runs.items():
        rows = rows.withColumn("run_id", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out.select("run_id", *[c for c in out.columns if c != "run_id"])


def convergence(runs: DataFrame, metric: str, by: list[str], tolerance: float = 0.01) -> DataFrame:
    """Change of `metric` from one run to the next (in the order of run_id), and whether it is within `tolerance` of the former."""
    before = F.lag(metric).over(W.partitionBy(*by).orderBy("run_id"))
    rel = F.try_divide(F.abs(F.col(metric) - F.col("before")), F.abs("before"))
    return runs.select(*by, "run_id", metric, before.alias("before")).withColumn("relative_change", rel).withColumn("converged", F.col("relative_change") <= tolerance).filter("before is not null")


# --- early warning -----------------------------------------------------------------------------------------------------
def early_fingerprint(obs: DataFrame, share: float = 0.2) -> DataFrame:
    """Of the first `share` of each signal's life: mean, deviation, slope, volatility and greatest deviation from the mean, one row per (cohort, signal_id)."""
    w = W.partitionBy("cohort", "signal_id")
    k, n = F.row_number().over(w.orderBy("s0")), F.count(F.lit(1)).over(w)
    step = F.col("value") - F.lag("value").over(w.orderBy("s0"))
    early = obs.filter("value is not null").withColumns({"k": k, "n": n, "step": step}).filter(F.col("k") <= F.greatest(F.lit(2), F.ceil(F.col("n") * share)))
    x, y = F.col("k").cast("double"), F.col("value")
    m = F.avg(y)
    return early.groupBy("cohort", "signal_id").agg(
        F.count(F.lit(1)).alias("n_early"), m.alias("early_mean"), F.stddev_samp(y).alias("early_std"), F.try_divide(F.covar_pop(x, y), F.var_pop(x)).alias("early_slope"), F.stddev_samp("step").alias("early_volatility"), F.greatest(F.max(y) - m, m - F.min(y)).alias("early_extent")
    )


def _robust(c: str, by: W) -> Column:
    middle = F.expr(f"percentile({c}, 0.5)").over(by)
    return F.try_divide(F.col(c) - middle, (F.expr(f"percentile({c}, 0.75)").over(by) - F.expr(f"percentile({c}, 0.25)").over(by)) / 1.349)


def early_warning(fingerprint: DataFrame, z: float = 3.0) -> DataFrame:
    """Per cohort: how many early measures lie more than z robust deviations from the fleet's median of that signal, the furthest one, a risk between 0 and 1, and LOW, MEDIUM, HIGH or CRITICAL."""
    names = ["early_mean", "early_std", "early_slope", "early_volatility", "early_extent"]
    by = W.partitionBy("signal_id")
    scored = fingerprint.withColumns({f"{c}__z": _robust(c, by) for c in names})
    long = scored.select("cohort", "signal_id", F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.abs(F.col(f"{c}__z")).alias("z")) for c in names])).alias("x")).select("cohort", "signal_id", "x.measure", "x.z").filter("z is not null")
    out = long.groupBy("cohort").agg(F.count(F.lit(1)).alias("n_measures"), F.sum((F.col("z") > z).cast("long")).alias("n_outlying"), F.max("z").alias("furthest_z"), F.max_by(F.concat_ws(".", "signal_id", "measure"), F.struct("z", "signal_id", "measure")).alias("furthest"))
    risk = 1 - F.exp(-(F.col("n_outlying") / F.col("n_measures") * 5 + F.greatest(F.lit(0.0), F.col("furthest_z") - z) / 10))
    return out.withColumn("risk", risk).withColumn("level", F.when(F.col("risk") >= 0.75, "CRITICAL").when(F.col("risk") >= 0.5, "HIGH").when(F.col("risk") >= 0.25, "MEDIUM").otherwise("LOW"))
