"""Shared helpers: Arrow text access, hashing and labelled-fold rules."""

from __future__ import annotations

import ctypes
import gc
import inspect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.store import shared_dir, written  # noqa: F401  the operators take them from here

#: Bytes of text that one vectorised step handles at a time; bounds the temporaries of a Python worker.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def erase(*tables: DataFrame) -> None:
    """Deletes tables of written() whose last reader is done."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def batch_rows(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the Arrow batches that Python workers get, by rows and by bytes, as texts may be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


def release(collect: bool = True) -> None:
    """Gives what the allocators of this process keep of freed memory back to the system; after large temporary arrays, where others need the room."""
    if collect:
        gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def lean(f):
    """f for Python workers, which outlive their tasks: what a stream of batches, a group or a pair of groups took is given back when f is done."""
    if inspect.isgeneratorfunction(f):

        def stream(batches):
            yield from f(batches)
            release(False)

        return stream

    def group(t):
        try:
            return f(t)
        finally:
            release(False)

    def both(key, left, right):
        try:
            return f(key, left, right)
        finally:
            release(False)

    return group if f.__code__.co_argcount == 1 else both


def held_out(doc_id="doc_id"):
    """The fold that is never learned from: crc32 of the id as text, modulo 3, is 1 (a null id is not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (a null counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    off = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES):
    """Consecutive row ranges (from, to) of about `most` bytes; a longer row is a range of its own."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the well-known murmur finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... counts[0] of them, then those of the next."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    first = np.repeat(starts - np.r_[0, np.cumsum(counts)[:-1]], counts)
    return first + np.arange(total, dtype=np.int64)
