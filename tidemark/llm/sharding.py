"""Sharding by a Feistel permutation over global row numbers.

Every row gets a gapless global number in the order of the key. A balanced Feistel network over the next even
number of bits, with cycle walking, permutes 0..N-1. The permuted number p alone decides: shard = p mod shards,
slot = p div shards. Shard sizes differ by one row at most, slots are gapless, and either can be computed for any
row number without looking at the others. The network is a bijection, so an inverse exists as well.

Nulls: a null key sorts first. Equal keys are ordered by the remaining columns given, then arbitrarily; repeated
rows each get a number of their own. An empty table gives an empty result. Extra columns are carried, whatever their
names; the columns `shard` and `slot` are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import mix64, table, written

ROUNDS = 6


def _halves(n: int) -> tuple[int, int]:
    bits = max(2, int(max(1, n - 1)).bit_length())
    half = (bits + 1) // 2
    return half, (1 << half) - 1


def _round_key(seed: int, r: int) -> np.uint64:
    return mix64(np.array([(seed * 0x9E3779B97F4A7C15 + r + 1) % 2**64], np.uint64))[0]


def permute(x: np.ndarray, n: int, seed: int = 0, inverse: bool = False) -> np.ndarray:
    """The permutation of 0..n-1 (or its inverse) at x: the network is applied again while a value lies outside."""
    half, mask = _halves(n)
    h, m = np.uint64(half), np.uint64(mask)
    out = np.asarray(x).astype(np.uint64)
    todo = np.arange(len(out))
    order = range(ROUNDS)
    while len(todo):
        v = out[todo]
        left, right = v >> h, v & m
        if inverse:
            for r in reversed(order):
                left, right = right ^ (mix64(left ^ _round_key(seed, r)) & m), left
        else:
            for r in order:
                left, right = right, left ^ (mix64(right ^ _round_key(seed, r)) & m)
        out[todo] = v = (left << h) | right
        todo = todo[v >= np.uint64(n)]
    return out.astype(np.int64)


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def numbered(df: DataFrame, key: str, ties: tuple[str, ...] = (), name: str = "row_number") -> tuple[DataFrame, int]:
    """df with its row's number 0..N-1 in the order of key and ties, and N. Only per-partition counts meet in one place."""
    spark = df.sparkSession
    spread, part, at = (free(df, f"__{c}") for c in ("spread", "part", "at"))  # the first deals even fully equal rows to several partitions
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = df.withColumn(spread, F.monotonically_increasing_id() % 1024)
    cols = [key, *ties, spread]
    sorted_ = flat.repartitionByRange(parts, *cols).sortWithinPartitions(*cols).drop(spread)
    here = F.monotonically_increasing_id()
    held = written(sorted_.withColumns({part: F.shiftright(here, 33), at: here.bitwiseAND(F.lit((1 << 33) - 1))}), "numbered")
    counts = held.groupBy(part).agg(F.count(F.lit(1)).alias("n")).collect()  # one row per partition
    base, at_row = {}, 0
    for r in sorted(counts):
        base[r[0]] = at_row
        at_row += r[1]
    first = free(df, "__first")
    offsets = spark.createDataFrame([*base.items()], f"`{part}` long, `{first}` long")
    return held.join(F.broadcast(offsets), part).withColumn(name, F.col(first) + F.col(at)).drop(part, at, first), at_row


def shard(df: DataFrame, key: str, shards: int, ties: tuple[str, ...] = (), seed: int = 0) -> DataFrame:
    """df with `shard` and `slot`."""
    df = df.drop("shard", "slot")
    number = free(df, "__number")
    rows, n = numbered(df, key, ties, number)
    schema = T.StructType([*df.schema.fields, T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])

    def place(batches):
        for b in batches:
            p = permute(b.column(b.num_columns - 1).to_numpy(zero_copy_only=False), n, seed)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array((p % shards).astype(np.int32)), pa.array(p // shards)], names=[*b.schema.names[:-1], "shard", "slot"])

    return rows.select(*df.columns, number).mapInArrow(place, schema)


SHARDS = 40


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = shard(docs, "doc_id", SHARDS, ("text_crc32", "size"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
