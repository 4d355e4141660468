"""Relational operators with parameters: a signal as the axis, modes, ordered arrays, last rows, default rows, lookups whatever the case, units by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def reaxis(obs: DataFrame, axis_signal: str, time_name: str = "time") -> DataFrame:
    """(cohort, signal_id, s0, value) ordered by the values of a signal: they become s0 and the former places the signal `time_name`.

    Rows whose axis value repeats in a cohort are set apart by rank / count, in their former order. Unknown axis signals, null values in them and a taken time_name are errors, as is a place without an axis value."""
    seen = obs.agg(F.max(F.col("signal_id") == axis_signal).alias("known"), F.max((F.col("signal_id") == axis_signal) & F.col("value").isNull()).alias("holes"), F.max(F.col("signal_id") == time_name).alias("taken")).first()
    if not seen["known"]:
        raise ValueError(f"there is no signal {axis_signal}")
    if seen["holes"]:
        raise ValueError(f"signal {axis_signal} has nulls and cannot be the axis")
    if seen["taken"] and time_name != axis_signal:
        raise ValueError(f"a signal is called {time_name} already")
    tied = W.partitionBy("cohort", "value")
    offset = (F.row_number().over(tied.orderBy("s0")) - 1) / F.count(F.lit(1)).over(tied)
    axis = obs.filter(F.col("signal_id") == axis_signal).select(F.col("cohort").alias("c"), F.col("s0").alias("at"), (F.col("value") + offset).alias("axis"))
    moved = obs.filter(F.col("signal_id") != axis_signal).join(axis, F.col("cohort").eqNullSafe(F.col("c")) & (F.col("s0") == F.col("at"))).select("cohort", "signal_id", F.col("axis").alias("s0"), "value")
    return moved.unionByName(axis.select(F.col("c").alias("cohort"), F.lit(time_name).alias("signal_id"), F.col("axis").alias("s0"), F.col("at").cast("double").alias("value")))


def mode(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """The most frequent value of each group and its count; of equally frequent ones the least. Counts by value are summed before the shuffle by group."""
    n = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy(*by).agg(F.min(F.struct((-F.col("n")).alias("n"), F.col(column).alias("v"))).alias("x"))
    return best.select(*by, F.col("x.v").alias("mode"), (-F.col("x.n")).alias("mode_count"))


def first_values(df: DataFrame, by: list[str], order: str, column: str, n: int) -> DataFrame:
    """The first n values of each group in order, as an array; rows beyond n are dropped before the arrays are built."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(order, column))
    return df.withColumn("__k", k).filter(F.col("__k") <= n).groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__k", column))), lambda x: x[column]).alias("first_values"))


def tail(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """The last n rows of each group."""
    k = F.row_number().over(W.partitionBy(*by).orderBy(F.col(order).desc()))
    return df.withColumn("__k", k).filter(F.col("__k") <= n).drop("__k")


def or_default(df: DataFrame, **values) -> DataFrame:
    """df, or one row of the values given if df is empty; columns that are not given are null."""
    spark = df.sparkSession
    row = spark.range(1).select(*[F.lit(values.get(f.name)).cast(f.dataType).alias(f.name) for f in df.schema])
    some = df.limit(1).select(F.lit(1).alias("__some"))
    return df.unionByName(row.join(F.broadcast(some), F.lit(True), "left_anti"))  # at most a row on either side


def lookup(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """df joined with the rows of `other` whose key is equal but for case and outer blanks; other's key is dropped."""
    plain = lambda c: F.lower(F.trim(c))
    names = [c for c in other.columns if c != key]
    right = other.select(plain(key).alias("__key"), *names).groupBy("__key").agg(*[F.min(c).alias(c) for c in names])
    return df.withColumn("__key", plain(key)).join(right, "__key", "left").drop("__key")


#: Endings and parts of signal names that tell a unit; the first that fits counts.
UNITS = (
    (r"(_|\b)(degc|celsius|temp_c)$", "degC"), (r"(_|\b)(degf|fahrenheit|temp_f)$", "degF"), (r"(_|\b)(kelvin|temp_k)$", "K"), (r"(_|\b)psi(a|g)?$", "psi"), (r"(_|\b)k?pa$", "Pa"), (r"(_|\b)bar$", "bar"), (r"(_|\b)rpm$", "rpm"), (r"(_|\b)(hz|freq|frequency)$", "Hz"), (r"(_|\b)(amps?|current)$", "A"),
    (r"(_|\b)(volts?|voltage)$", "V"), (r"(_|\b)(watts?|power)$", "W"), (r"(_|\b)(gpm|flow)$", "gpm"), (r"(_|\b)(mm_s|velocity)$", "mm/s"), (r"(_|\b)(acc|accel|g)(_[xyzhv])?$", "g"), (r"(_|\b)(pct|percent)$", "%"), (r"(_|\b)(usd|price)$", "usd"), (r"(_|\b)(count|n)$", "count"),
)


def unit_by_name(name: Column) -> Column:
    """The unit that a signal's name tells, or null."""
    out = F
    for pattern, unit in UNITS:
        out = out.when(F.lower(name).rlike(pattern), F.lit(unit))
    return out.otherwise(F.lit(None).cast("string"))
