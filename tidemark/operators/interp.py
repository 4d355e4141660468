"""As-of and linear-interpolation joins of two series on one axis, by windows over their union: no range join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, by: list[str], axis: str, value: str) -> DataFrame:
    """left with the value of right at the greatest axis place that is not after its own."""
    l = left.withColumns({"__left": F.lit(1), "__v": F.lit(None).cast("double")})
    r = right.select(*by, axis, F.col(value).cast("double").alias("__v"), F.lit(0).alias("__left"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = W.partitionBy(*by).orderBy(axis, "__left").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn(f"{value}_asof", F.last("__v", ignorenulls=True).over(w)).filter("__left = 1").drop("__left", "__v")


def interpolate(left: DataFrame, right: DataFrame, by: list[str], axis: str, value: str) -> DataFrame:
    """left with right's value at its place, linear between the neighbours and constant beyond the ends."""
    l = left.withColumns({"__left": F.lit(1), "__x": F.lit(None).cast("double"), "__v": F.lit(None).cast("double")})
    r = right.select(*by, axis, F.col(axis).cast("double").alias("__x"), F.col(value).cast("double").alias("__v"), F.lit(0).alias("__left"))
    both = l.unionByName(r, allowMissingColumns=True)
    back = W.partitionBy(*by).orderBy(axis, "__left").rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*by).orderBy(F.col(axis), F.col("__left").desc()).rowsBetween(0, W.unboundedFollowing)
    p = lambda c, w, f: f(c, ignorenulls=True).over(w)
    both = both.withColumns({"__x0": p("__x", back, F.last), "__v0": p("__v", back, F.last), "__x1": p("__x", ahead, F.first), "__v1": p("__v", ahead, F.first)})
    share = F.coalesce(F.try_divide(F.col(axis) - F.col("__x0"), F.col("__x1") - F.col("__x0")), F.lit(0.0))
    out = F.coalesce(F.col("__v0") + share * (F.col("__v1") - F.col("__v0")), "__v0", "__v1")
    return both.withColumn(f"{value}_at", out).filter("__left = 1").drop("__left", "__x", "__v", "__x0", "__v0", "__x1", "__v1")
