"""Remaining life from features by cycle: features that look backwards only, folds by unit, boosted trees, scores, ablation."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Cycles that remaining life is capped at, and the scales of the asymmetric score for early and late guesses.
RUL_CAP, EARLY_SCALE, LATE_SCALE = 125, 13.0, 10.0


def with_life(cycles: DataFrame, cap: int = RUL_CAP) -> DataFrame:
    """`rul`: cycles to the unit's last one, at most `cap`."""
    last = cycles.groupBy("unit").agg(F.max("cycle").alias("__last"))
    return cycles.join(last, "unit").withColumn("rul", F.least(F.col("__last") - F.col("cycle"), F.lit(cap)).cast("double")).drop("__last")


def cycle_features(cycles: DataFrame, sensors: list[str], windows: tuple[int, ...] = (5, 20)) -> DataFrame:
    """Per sensor: rolling mean, deviation and slope over the last cycles, change since the cycle before, and distance from the mean of the unit's first thirty cycles. Nothing looks ahead."""
    w = W.partitionBy("unit").orderBy("cycle")
    made = {}
    for c in sensors:
        made[f"{c}_delta"] = F.col(c) - F.lag(c).over(w)
        made[f"{c}_from_start"] = F.col(c) - F.avg(F.when(F.col("__k") <= 30, F.col(c))).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
        for n in windows:
            back = w.rowsBetween(1 - n, W.currentRow)
            made |= {f"{c}_mean_{n}": F.avg(c).over(back), f"{c}_std_{n}": F.stddev_samp(c).over(back), f"{c}_slope_{n}": F.try_divide(F.covar_pop(F.col("__k").cast("double"), F.col(c)).over(back), F.var_pop(F.col("__k").cast("double")).over(back))}
    return cycles.withColumn("__k", F.row_number().over(w)).withColumns(made).drop("__k")


def with_geometry(features: DataFrame, geometry: DataFrame) -> DataFrame:
    """features with the columns of the last window of `geometry` (unit, cycle of the window's end, ...) that had ended: carried forward, never interpolated towards a later one."""
    cols = [c for c in geometry.columns if c not in ("unit", "cycle")]
    both = features.withColumns({c: F.lit(None).cast(geometry.schema[c].dataType) for c in cols}).withColumn("__own", F.lit(1)).unionByName(geometry.withColumn("__own", F.lit(0)), allowMissingColumns=True)
    w = W.partitionBy("unit").orderBy("cycle", "__own").rowsBetween(W.unboundedPreceding, W.currentRow)
    return both.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols}).filter("__own = 1").drop("__own")


def folds(rows: DataFrame, n: int = 5) -> DataFrame:
    """`fold` by unit: no unit is on both sides of a split."""
    return rows.withColumn("fold", F.pmod(F.xxhash64(F.col("unit").cast("string")), F.lit(n)).cast("int"))


def model(features: list[str], kind: str = "gbt", trees: int = 40, depth: int = 5, seed: int = 42) -> Pipeline:
    named = [f"{c}__i" for c in features]
    tree = GBTRegressor(featuresCol="__x", labelCol="rul", maxIter=trees, maxDepth=depth, stepSize=0.1, subsamplingRate=0.8, seed=seed) if kind == "gbt" else RandomForestRegressor(featuresCol="__x", labelCol="rul", numTrees=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[Imputer(inputCols=features, outputCols=named, strategy="median"), VectorAssembler(inputCols=named, outputCol="__x", handleInvalid="keep"), tree])


def scores(predicted: DataFrame) -> dict:
    """rmse, mae, r2, and the asymmetric score: late guesses cost more than early ones."""
    d = F.col("prediction") - F.col("rul")
    cost = F.when(d < 0, F.exp(-d / EARLY_SCALE) - 1).otherwise(F.exp(d / LATE_SCALE) - 1)
    r = predicted.agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(d * d)).alias("rmse"), F.avg(F.abs(d)).alias("mae"), (1 - F.try_divide(F.sum(d * d), F.var_pop("rul") * F.count(F.lit(1)))).alias("r2"), F.sum(cost).alias("phm08")).first()
    return r.asDict()


def last_cycles(predicted: DataFrame) -> DataFrame:
    """Each unit's last row, which the published scores are over."""
    return predicted.withColumn("__k", F.row_number().over(W.partitionBy("unit").orderBy(F.col("cycle").desc()))).filter("__k = 1").drop("__k")


def out_of_fold(rows: DataFrame, features: list[str], n: int = 5, **how) -> DataFrame:
    """rows with `prediction` by a model that never saw their unit. Folds without rows are passed over."""
    rows, out = folds(rows, n), None
    for k in sorted(r[0] for r in rows.select("fold").distinct().collect()):
        train = rows.filter(F.col("fold") != k)
        if train.isEmpty():
            continue
        part = model(features, **how).fit(train).transform(rows.filter(F.col("fold") == k)).select(*rows.columns, F.greatest("prediction", F.lit(0.0)).alias("prediction"))
        out = part if out is None else out.unionByName(part)
    return rows.limit(0).withColumn("prediction", F.lit(None).cast("double")) if out is None else out


def importances(fitted, features: list[str]) -> list[tuple[str, float]]:
    return sorted(zip(features, map(float, fitted.stages[-1].featureImportances.toArray()), strict=True), key=lambda x: (-x[1], x[0]))


def ablation(rows: DataFrame, groups: dict[str, list[str]], n: int = 5, **how) -> list[dict]:
    """Out-of-fold scores as each group of features joins those before it."""
    out, used = [], []
    for name, cols in groups.items():
        used = [*used, *cols]
        out.append({"added": name, "n_features": len(used), **scores(out_of_fold(rows, used, n, **how))})
    return out
