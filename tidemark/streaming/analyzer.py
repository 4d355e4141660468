"""Live analysis: event-time windows with watermarks, and a per-key stateful analyser of the last points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

WINDOW, BATCH, LEAST = 100, 500, 10
#: Points needed for the batch metrics, each with its own counter: spectral, permutation entropy, divergence exponent (and points between two of them).
SPECTRAL, PERMUTATION, EXPONENT, BETWEEN = 100, 150, 200, 50

#: Effective dimensions below which alerts are raised, the divergence exponent above which one is, and seconds that an alert stays.
CRITICAL_DIM, WARNING_DIM, CHAOTIC, STAYS = 1.5, 2.0, 0.1, 300.0

METRICS = (
    "key string, n long, at double, stage string, effective_dim double, eigenvalue_0 double, eigenvalue_1 double, eigenvalue_2 double, eigenvalue_ratio double, total_variance double, "
    "signal_strength double, noise_level double, spectral_entropy double, permutation_entropy double, exponent double, raised array<string>, alerts array<string>"
)
STATE = "n long, since long, points array<double>, raised array<string>, times array<double>"


def windowed(events: DataFrame, time: str, keys: list[str], value: str, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Count, sum, mean and extremes by key and event-time window; rows later than the watermark are left out when streaming."""
    frame = F.window(time, size, slide) if slide else F.window(time, size)
    return (
        events.withWatermark(time, late)
        .groupBy(frame.alias("w"), *keys)
        .agg(F.count(value).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))
        .select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total", "mean", "least", "most")
    )


def sessions(events: DataFrame, time: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions by key that end after a gap without rows."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, "n")


#: Points from which a stage begins.
STAGES = ((200, "full_analysis"), (100, "computing_complexity"), (50, "analyzing_dynamics"), (10, "computing_eigenstructure"), (0, "initializing"))


def stage(n: int) -> str:
    return next(name for least, name in STAGES if n >= least)


def instant(x: np.ndarray) -> list[float]:
    """Effective dimension, three eigenvalues, the first over the second, total variance, mean deviation and mean step of a window of points.

    Sensors are scaled by their deviation; those that do not vary are left out.
    """
    dev = x.std(0)
    strength, noise = float(dev.mean()), float(np.abs(np.diff(x, axis=0)).mean())
    z = ((x - x.mean(0)) / np.where(dev > 0, dev, 1))[:, dev > 0]
    if z.shape[1] == 0:
        return [np.nan] * 6 + [strength, noise]
    v = np.maximum(np.linalg.eigvalsh(np.atleast_2d(np.cov(z.T)))[::-1], 0)
    t, q = float(v.sum()), float(v @ v)
    clean = [float(e) for e in v if e > v[0] * 1e-6]
    first = [*clean, np.nan, np.nan, np.nan][:3]
    return [t * t / q if q > 0 else np.nan, *first, clean[0] / clean[1] if len(clean) > 1 else 1.0, t, strength, noise]


def warnings(dim: float, exponent: float) -> list[str]:
    """Every alert that a point raises."""
    out = []
    if dim < CRITICAL_DIM:
        out.append("CRITICAL effective_dimension")
    elif dim < WARNING_DIM:
        out.append("WARNING effective_dimension")
    if exponent > CHAOTIC:
        out.append("WARNING divergence")
    return out


def analyse(points: DataFrame, key: str, sensors: list[str], time: str | None = None) -> DataFrame:
    """One row of metrics for each point, from state that holds the last BATCH points of its key.

    `time` (a timestamp or seconds) orders the points of a batch and ages alerts; without it a point counts as a second.
    `raised` are the alerts of the point, `alerts` those that are not older than STAYS seconds. Each batch metric has its
    own counter, so that spectral metrics, which every point renews, do not hold the exponent back.
    """
    from ..functions import engines as E

    at = F.col(time).cast("double") if time else F.lit(None).cast("double")
    names = [c.split()[0] for c in METRICS.split(", ")]

    def step(k, frames, state):
        n, since, flat, kinds, times = state.get if state.exists else (0, 0, [], [], [])
        x, active = np.array(flat).reshape(-1, len(sensors)), dict(zip(kinds, times, strict=True))
        f = pd.concat(list(frames))
        if time:
            f = f.sort_values("__at", kind="stable")
        out = []
        for now, row in zip(f["__at"].to_numpy(float), f[sensors].to_numpy(float), strict=True):
            x = np.vstack([x, row])[-BATCH:]
            n, since = n + 1, since + 1
            now = float(n) if np.isnan(now) else float(now)
            values, spectral, perm, exponent = [np.nan] * 8, np.nan, np.nan, np.nan
            with np.errstate(all="ignore"):
                if len(x) >= LEAST:
                    values = instant(x[-WINDOW:])
                if len(x) >= SPECTRAL:
                    spectral = E.spectral(x[:, 0])[2]
                if len(x) >= PERMUTATION:
                    perm = E.permutation_entropy(x[:, 0])
                if len(x) >= EXPONENT and since >= BETWEEN:
                    exponent, since = E.rosenstein(x[:, 0])[0], 0
            raised = warnings(values[0], exponent)
            active = {a: t for a, t in active.items() if t > now - STAYS} | dict.fromkeys(raised, now)
            out.append([str(k[0]), n, now, stage(n), *values, spectral, perm, exponent, raised, sorted(active)])
        state.update((n, since, x.ravel().tolist(), list(active), [float(t) for t in active.values()]))
        yield pd.DataFrame(out, columns=names)

    return points.withColumn("__at", at).groupBy(key).applyInPandasWithState(step, METRICS, STATE, "append", GroupStateTimeout.NoTimeout)


def status(metrics: DataFrame) -> DataFrame:
    """The last row of each key in a table of metrics, with the number of rows kept of it."""
    last = metrics.groupBy("key").agg(F.max_by(F.struct("n", "stage", "effective_dim", "alerts"), "n").alias("last"), F.count(F.lit(1)).alias("n_rows"))
    return last.select("key", "last.*", "n_rows")


def history(metrics: DataFrame, rows: int = 1000) -> DataFrame:
    """The last `rows` rows of each key."""
    top = F.max("n").over(W.partitionBy("key"))
    return metrics.withColumn("__top", top).filter(F.col("n") > F.col("__top") - rows).drop("__top")


def deliver(metrics: DataFrame, send, checkpoint: str):
    """Starts a query that hands every batch of rows, as a list of dictionaries, to send(); bounded by the trigger's batch."""

    def batch(df, _):
        for row in df.toLocalIterator():
            send(row.asDict(recursive=True))

    return metrics.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def synthetic(spark: SparkSession, rows_per_second: int = 10) -> DataFrame:
    """A stream of points of three sensors: two coupled oscillations and noise."""
    rate = spark.readStream.format("rate").option("rowsPerSecond", rows_per_second).load()
    t = F.col("value") / 10.0
    return rate.select(F.col("timestamp").alias("ts"), F.lit("synthetic").alias("key"), F.sin(t).alias("a"), (F.cos(t) + 0.3 * F.sin(3 * t)).alias("b"), (F.rand(7) - 0.5).alias("c"))


def with_typology(points: DataFrame, typology: DataFrame, on: list[str]) -> DataFrame:
    """A stream joined to what is known of its signals, so that nothing is classified again."""
    return points.join(typology, on, "left")


def overlapped(part: DataFrame, before: DataFrame, keys: list[str], axis: str, rows: int) -> DataFrame:
    """A partition's rows with the last `rows` of the one before it, at negative places, so that its first windows are full."""
    w = W.partitionBy(*keys).orderBy(F.col(axis).desc())
    tail = before.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= rows).withColumn(axis, -F.col("__k").cast("double")).drop("__k")
    return tail.unionByName(part)


def reindexed(part: DataFrame, keys: list[str], axis: str) -> DataFrame:
    """A partition whose places are numbered from 0 by key."""
    return part.withColumn(axis, (F.row_number().over(W.partitionBy(*keys).orderBy(axis)) - 1).cast("double"))


def ingest(spark, folder: str, schema, out: str, checkpoint: str) -> None:
    """All files of a folder that the checkpoint has not seen, appended to a table by ISO week of the file's time; resumes after a failure."""
    rows = spark.readStream.schema(schema).parquet(folder).withColumn("week", F.date_format(F.date_trunc("week", F.col("_metadata.file_modification_time")), "yyyy-MM-dd"))
    rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).partitionBy("week").trigger(availableNow=True).start().awaitTermination()
