"""Readers and writers of observations: long-format (cohort, signal_id, s0, value) from wide, delimited and run-log files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

OBSERVATIONS = T.StructType([T.StructField("cohort", T.StringType()), T.StructField("signal_id", T.StringType(), False), T.StructField("s0", T.DoubleType(), False), T.StructField("value", T.DoubleType())])

#: Other names that columns come by.
ALIASES = {"entity_id": "cohort", "unit_id": "cohort", "i": "s0", "signal_0": "s0", "sensor": "signal_id", "signal": "signal_id"}


def clean(df: DataFrame, domain: str = "") -> DataFrame:
    """Aliases renamed, an empty cohort filled with the domain's name, NaN and infinities nulled, one row for each (cohort, signal, place)."""
    for a, b in ALIASES.items():
        if b not in df.columns:
            for c in df.columns:
                if c.lower() == a:
                    df = df.withColumnRenamed(c, b)
    v = F.col("value").cast("double")
    cohort = F.col("cohort") if "cohort" in df.columns else F.lit(None).cast("string")
    rows = df.select(F.when(F.coalesce(cohort, F.lit("")) == "", F.lit(domain)).otherwise(cohort).alias("cohort"), F.col("signal_id").cast("string").alias("signal_id"), F.col("s0").cast("double").alias("s0"), F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias("value"))
    return rows.groupBy("cohort", "signal_id", "s0").agg(F.min("value").alias("value"))  # of repeated places the least value


def wide(df: DataFrame, signals: list[str], cohort: str | None = None, axis: str | None = None, order: list[str] | None = None) -> DataFrame:
    """A wide table unpivoted; without an axis the rows of a cohort are numbered in the order of the columns given."""
    c = F.col(cohort).cast("string") if cohort else F.lit("")
    place = F.col(axis).cast("double") if axis else (F.row_number().over(W.partitionBy(c).orderBy(*(order or signals))) - 1).cast("double")
    base = df.select(c.alias("cohort"), place.alias("s0"), *[F.col(s).cast("double").alias(s) for s in signals])
    return clean(base.unpivot(["cohort", "s0"], signals, "signal_id", "value"))


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sep: str = ",") -> DataFrame:
    """Delimited rows with a header; without a schema one is inferred, which reads the file twice."""
    read = spark.read.option("header", True).option("sep", sep)
    return (read.schema(schema) if schema is not None else read.option("inferSchema", True)).csv(path)


#: Formats by the end of a file's name.
FORMATS = {".parquet": "parquet", ".csv": "csv", ".tsv": "tsv", ".txt": "text", ".json": "json", ".xlsx": "excel", ".xls": "excel", ".mat": "matlab"}
RUN_LOG_FIELDS = 26


def detect_format(spark: SparkSession, path: str) -> str:
    """The format by the name's end; a text file whose first line has as many fields as a run log is one."""
    found = next((f for end, f in FORMATS.items() if path.lower().rstrip("/").endswith(end)), "unknown")
    if found in ("text", "unknown"):
        first = spark.read.text(path).filter(F.trim("value") != "").limit(1).collect()
        if first and len(first[0]["value"].split()) == RUN_LOG_FIELDS:
            return "run_log"
        if first and found == "text":
            return "tsv" if "\t" in first[0]["value"] else "csv"
    return found


def load(spark: SparkSession, path: str) -> DataFrame:
    """A file or folder as a table, by its format; other formats come through convert()."""
    kind = detect_format(spark, path)
    if kind == "parquet":
        return spark.read.parquet(path)
    if kind in ("csv", "tsv"):
        return csv(spark, path, sep="\t" if kind == "tsv" else ",")
    if kind == "json":
        return spark.read.json(path)
    if kind == "run_log":
        return run_log(spark, path)
    raise ValueError(f"no reader for {kind} files; give a converter")


def preview(spark: SparkSession, path: str, rows: int = 10) -> list[dict]:
    return [r.asDict() for r in load(spark, path).limit(rows).collect()]


def file_info(spark: SparkSession, path: str) -> dict:
    """Format, columns with their types, rows, and columns that hold numbers."""
    df = load(spark, path)
    return {"format": detect_format(spark, path), "columns": dict(df.dtypes), "n_rows": df.count(), "numeric": [c for c, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint")]}


class Converter:
    """Turns files that Spark has no reader for into observations. A subclass gives the pattern of its files' names and rows of a file."""

    pattern = "*"

    def rows(self, data: bytes, name: str):
        """Yields (cohort, signal_id, s0, value)."""
        raise NotImplementedError


def convert(spark: SparkSession, folder: str, converter: Converter) -> DataFrame:
    """Observations of all files of a folder that fit the converter's pattern; each file is one task's row."""
    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", converter.pattern).load(folder)

    def work(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):
                yield pd.DataFrame(list(converter.rows(bytes(content), path.rsplit("/", 1)[-1])), columns=[c.name for c in OBSERVATIONS]).astype({"s0": float, "value": float})

    return files.select("path", "content").mapInPandas(work, OBSERVATIONS)


def pivoted(obs: DataFrame, signals: list[str]) -> DataFrame:
    """Long to wide: a column for each signal, a row for each (cohort, place); the first value where a place repeats is the least."""
    return obs.groupBy("cohort", "s0").pivot("signal_id", signals).agg(F.min("value"))


def oscillator(spark: SparkSession, n: int = 24000, step: float = 0.05, a: float = 0.2, b: float = 0.2, c: float = 5.7, cohort: str = "oscillator") -> DataFrame:
    """A chaotic three-variable oscillator by fourth-order steps (x' = -y - z, y' = x + a y, z' = b + z (x - c)) and a pulse where z exceeds its mean by two deviations."""
    import numpy as np

    move = lambda s: np.array([-s[1] - s[2], s[0] + a * s[1], b + s[2] * (s[0] - c)])
    path, now = np.empty((n, 3)), np.array([1.0, 1.0, 1.0])
    for i in range(n):
        k1 = move(now)
        k2 = move(now + step / 2 * k1)
        k3 = move(now + step / 2 * k2)
        now = now + step / 6 * (k1 + 2 * k2 + 2 * k3 + move(now + step * k3))
        path[i] = now
    pulse = (path[:, 2] > path[:, 2].mean() + 2 * path[:, 2].std()).astype(float)
    rows = [(cohort, s, float(i), float(v)) for s, column in (("x", path[:, 0]), ("y", path[:, 1]), ("z", path[:, 2]), ("pulse", pulse)) for i, v in enumerate(column)]
    return spark.createDataFrame(rows, OBSERVATIONS)


def validated(obs: DataFrame, constant: float = 1e-10, near_constant: float = 1e-6) -> DataFrame:
    """What is wrong with each signal: nulls, repeated places, no or hardly any variation, too few points; an empty list if nothing."""
    per = obs.groupBy("cohort", "signal_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("n_values"), F.count_distinct("s0").alias("n_places"), F.stddev_pop("value").alias("dev"))
    flag = lambda c, name: F.when(c, F.lit(name))
    faults = F.array(
        flag(F.col("n_values") == 0, "no_values"), flag((F.col("n_values") < F.col("n")) & (F.col("n_values") > 0), "nulls"), flag(F.col("n_places") < F.col("n"), "repeated_places"), flag(F.col("dev") < constant, "constant"), flag((F.col("dev") >= constant) & (F.col("dev") < near_constant), "near_constant"), flag(F.col("n") < 50, "short")
    )
    return per.select("cohort", "signal_id", "n", F.array_compact(faults).alias("faults"))


#: Words that names of an index have, by what they index.
INDEX_WORDS = {"time": ("time", "date", "timestamp", "datetime", "ts"), "cycle": ("cycle", "step", "sample", "index", "iteration"), "space": ("position", "distance", "depth", "height", "location"), "frequency": ("frequency", "freq", "hz", "band")}


def detect_index(df: DataFrame, rows: int = 1000) -> list[dict]:
    """Columns that may be the ordering axis, the likeliest first: by name, and by whether a bounded sample of the first rows rises, and evenly."""
    sample = df.limit(rows).toPandas()
    out = []
    for c in sample.columns:
        kind = next((k for k, words in INDEX_WORDS.items() if c.lower() in words or any(c.lower().endswith("_" + w) for w in words)), None)
        x = sample[c]
        number = x.astype("int64") / 1e9 if str(x.dtype).startswith("datetime") else x if x.dtype.kind in "if" else None
        d = number.dropna().diff().dropna() if number is not None else None
        rises = bool(d is not None and len(d) and (d > 0).all())
        even = bool(rises and d.std(ddof=0) <= 0.01 * d.mean())
        score = 2 * (kind is not None) + rises + even + str(x.dtype).startswith("datetime")
        if score:
            out.append({"column": c, "kind": kind or "unknown", "rises": rises, "even": even, "step": float(d.median()) if rises else None, "score": int(score)})
    return sorted(out, key=lambda r: (-r["score"], r["column"]))


def run_log(spark: SparkSession, path: str, settings: int = 3, sensors: int = 21) -> DataFrame:
    """White-space separated rows without a header: unit, cycle, settings, sensors; the axis is the cycle less one."""
    names = ["unit", "cycle", *[f"setting_{i + 1}" for i in range(settings)], *[f"sensor_{i + 1}" for i in range(sensors)]]
    part = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter(F.trim("value") != "").select(*[part[i].cast("double").alias(n) for i, n in enumerate(names)])
    rows = rows.select(F.concat(F.lit("engine_"), F.col("unit").cast("long")).alias("cohort"), (F.col("cycle") - 1).alias("s0"), *names[2:])
    return clean(rows.unpivot(["cohort", "s0"], names[2:], "signal_id", "value"))


def write(df: DataFrame, path: str, by_cohort: bool = False) -> None:
    """Observations as Parquet; partitioned by cohort only where cohorts are few."""
    out = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in OBSERVATIONS]).write.mode("overwrite")
    (out.partitionBy("cohort") if by_cohort else out).parquet(path)


def markdown(df: DataFrame, rows: int = 50) -> str:
    """The first rows as a Markdown table."""
    head = df.limit(rows).collect()
    line = lambda v: "| " + " | ".join("" if x is None else str(x) for x in v) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *(line(r) for r in head)])
