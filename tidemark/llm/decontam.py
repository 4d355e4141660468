"""Benchmark decontamination by spaced-seed hashing.

Words (letters and digits, lower-cased) of every benchmark item are hashed under the fixed masks `MASKS`. The same
hashes of every document are looked up; around each hit, item and document are aligned and the best stretch of the
overlap (+1 for an equal word, -`PENALTY` for another) is kept if it has at least `MIN_WORDS` equal words, or nine
tenths of a shorter item, and at least `MIN_SHARE` of its words are equal.

The masks follow from that law. They are all that hold four words in a row with at most one ignored among them. If each
five words in a row of a stretch had two unequal ones or more, so that none of the masks fits, a stretch of 5 q + r
words (r < 5) would have 2 q + max(0, r - 3) unequal words, and more than a quarter of it, unless it has at most eight
words. So whatever the verification accepts of nine words or more holds a mask; a stretch of four to eight words is
accepted as a whole item only, all of whose words are equal, and items of ten words with one replaced hold four equal
words in a row. Items of fewer words than a mask are looked up as a whole.

The benchmark is the stated query set: its index goes to the executors in blocks of at most `BLOCK_WORDS` words, one
after another. What a block finds is written before the next is sent, and its copies on the executors are deleted, so
that one block is held at a time whatever the benchmark's size. Each block is a pass over the documents.

Defined results: null and empty texts on either side match nothing; an item of fewer than ten words is found where
all of its words are, so one of a single common word lies in many documents; equal items are reported each; a repeated
document is reported each time; rows are distinct places (the same item may lie in a document twice); empty tables give
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import STEP_BYTES, batch_rows, lean, ranges, steps, table, utf8, written
from ._words import ALNUM, grams, words

#: Fixed masks; 0 ignores a word. With other limits below they are to be derived anew.
MASKS = ("1111", "10111", "11011", "11101")
LEAST = min(map(len, MASKS))
MIN_WORDS, MIN_SHARE, PENALTY = 11, 0.75, 2
BLOCK_WORDS = 200_000
#: Hits, or words compared, that one vectorised step handles at a time.
STEP_HITS = 1 << 20
TABLE_BITS = 20

OUT = "doc_id long, item_id long, doc_from long, doc_to long, item_from long, n_equal long"


def _offsets(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def windows(w: np.ndarray, off: np.ndarray, offs: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows that lie within one text, and their first words."""
    h = grams(w, offs)
    text = np.searchsorted(off, np.arange(len(h)), side="right") - 1
    at = np.flatnonzero(np.arange(len(h)) + offs[-1] < off[text + 1]) if len(h) else np.zeros(0, np.int64)
    return h[at], at


def index(items: list[tuple]) -> dict | None:
    """Words of the items and, by mask, sorted window hashes with their places."""
    if not items:
        return None
    raw, off = utf8(pa.array([t for _, t in items], pa.string()))
    w, w_off = words(raw, off, ALNUM)
    seeds = {}
    sizes = np.diff(w_off)
    short = [tuple(range(n)) for n in range(1, LEAST) if (sizes == n).any()]
    for offs in [*map(_offsets, MASKS), *short]:
        h, at = windows(w, w_off, offs)
        if offs in short:  # the whole item, and nothing of longer items
            item = np.searchsorted(w_off, at, side="right") - 1
            keep = sizes[item] == len(offs)
            h, at = h[keep], at[keep]
        order = np.argsort(h, kind="stable")
        there = np.zeros(1 << TABLE_BITS, bool)
        there[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
        seeds[offs] = (h[order], at[order], there)
    return {"ids": [i for i, _ in items], "words": w, "off": w_off, "seeds": seeds}


def best(equal: np.ndarray) -> tuple[int, int]:
    """The stretch [from, to) with the greatest score."""
    c = np.r_[0, np.cumsum(np.where(equal, 1, -PENALTY))]
    low = np.minimum.accumulate(c)
    to = int(np.argmax(c - low))
    return int(np.argmin(c[: to + 1])), to


def enough(found: np.ndarray, w: np.ndarray, w_off: np.ndarray, idx: dict) -> np.ndarray:
    """Which of the alignments (text, item, shift) have as many equal words in all as the best stretch needs."""
    text, item, shift = found.T
    size = idx["off"][item + 1] - idx["off"][item]
    lo = np.maximum(idx["off"][item], w_off[text] - shift)
    n = np.minimum(idx["off"][item + 1], w_off[text + 1] - shift) - lo
    equal = np.zeros(len(found), np.int64)
    for a, z in steps(np.r_[0, np.cumsum(n)], STEP_HITS):
        at = ranges(lo[a:z], n[a:z])
        c = np.r_[0, np.cumsum(idx["words"][at] == w[at + np.repeat(shift[a:z], n[a:z])])]
        to = np.cumsum(n[a:z])
        equal[a:z] = c[to] - c[to - n[a:z]]
    return equal >= np.minimum(MIN_WORDS, 0.9 * size)


def overlaps(w: np.ndarray, w_off: np.ndarray, idx: dict) -> list[tuple[int, int, int, int, int, int]]:
    """(text, item, from, to, item's from, equal words) of all verified overlaps."""
    pairs = []
    for offs, (hashes, places, there) in idx["seeds"].items():
        h = grams(w, offs)
        at = np.flatnonzero(there[(h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
        at = at[np.isin(h[at], hashes)] if len(hashes) else at[:0]
        text = np.searchsorted(w_off, at, side="right") - 1
        keep = at + offs[-1] < w_off[text + 1]
        at, text = at[keep], text[keep]
        lo, hi = np.searchsorted(hashes, h[at], side="left"), np.searchsorted(hashes, h[at], side="right")
        for a, z in steps(np.r_[0, np.cumsum(hi - lo)], STEP_HITS):
            n = (hi - lo)[a:z]
            place = places[ranges(lo[a:z], n)]
            item = np.searchsorted(idx["off"], place, side="right") - 1
            pairs.append(np.unique(np.column_stack([np.repeat(text[a:z], n), item, np.repeat(at[a:z], n) - place]), axis=0))
    found = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 3), np.int64)
    out = []
    for text, item, shift in found[enough(found, w, w_off, idx)].tolist():
        i0, i1 = int(idx["off"][item]), int(idx["off"][item + 1])
        d0, d1 = int(w_off[text]), int(w_off[text + 1])
        a, z = max(i0, d0 - shift), min(i1, d1 - shift)
        equal = idx["words"][a:z] == w[a + shift : z + shift]
        f, t = best(equal)
        n = int(equal[f:t].sum())
        if n >= min(MIN_WORDS, 0.9 * (i1 - i0)) and n >= MIN_SHARE * (t - f):
            out.append((text, item, a + f + shift - d0, a + t + shift - d0, a + f - i0, n))
    return out


def blocks(benchmark: DataFrame):
    """Indexes of the benchmark's items, each of at most BLOCK_WORDS words and one item."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").filter("text is not null").sort("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += len(r["text"]) // 2 + 1
        if size >= BLOCK_WORDS:
            yield index(block)
            block, size = [], 0
    if block:
        yield index(block)


def found(column: pa.Array, idx: dict):
    """(first row of a step, its overlaps) over a batch's texts."""
    raw, off = utf8(column)
    for a, z in steps(off, STEP_BYTES):
        w, w_off = words(raw[off[a] : off[z]], off[a : z + 1] - off[a], ALNUM)
        rows = overlaps(w, w_off, idx) if len(w) else []
        if rows:
            yield a, rows


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, doc_from, doc_to, item_from, n_equal); places count words."""
    spark = docs.sparkSession
    batch_rows(spark)
    ids = docs.select("doc_id", "text")

    def step(_, held):
        def work(batches):
            for b in batches:
                for a, rows in found(b.column(1), held.value):
                    text, item, *rest = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([b.column(0)[a:].take(pa.array(text)), pa.array([held.value["ids"][i] for i in item], pa.int64()), *(pa.array(r, pa.int64()) for r in rest)], names=[x.split()[0] for x in OUT.split(", ")])

        return ids.mapInArrow(lean(work), OUT)

    done = by_block(spark, benchmark, step)
    return functools.reduce(DataFrame.unionByName, done) if done else spark.createDataFrame([], OUT)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without any overlap."""
    spark, at = docs.sparkSession, docs.columns.index("text")
    batch_rows(spark)

    def step(before, held):
        def work(batches):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                for a, rows in found(b.column(at), held.value):
                    keep[[a + r[0] for r in rows]] = False
                yield b.filter(pa.array(keep))

        left = before[-1] if before else docs
        return left.mapInArrow(lean(work), docs.schema)

    done = by_block(spark, benchmark, step)
    return done[-1] if done else docs


def by_block(spark: SparkSession, benchmark: DataFrame, step) -> list[DataFrame]:
    """step(results so far, broadcast index) for each block; all results but the last are written, and their blocks given up."""
    done, held = [], None
    for idx in blocks(benchmark):
        if held is not None:
            done[-1] = written(done[-1], "block")
            held.destroy()
        held = spark.sparkContext.broadcast(idx)
        done.append(step(done, held))
    return done


def op4_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
