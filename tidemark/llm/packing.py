"""Packing by shortest-pack-first over the histogram of lengths.

Documents are tokenised whole, cut into pieces of at most `max_len` tokens, and ranked within their length. The
histogram alone (at most `max_len` numbers) goes to the driver, where lengths are placed longest first, each into the
pack that is the shortest at the time; what is kept is counts of packing patterns, not packs. The patterns, a few
thousand at most whatever the corpus, go back to the pieces by rank: the r-th piece of a length has a computable
pattern, instance and offset.

Ranks come from three parts: a counter in the task that made the piece, the sum over earlier tasks of the same
length, and nothing else; no length is ever gathered into one task as rows.

Defined results: a null or empty text is the end id alone; documents with the same id, or repeated rows, are packed
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import batch_rows, lean, steps, table, utf8, written

MAX_LEN = 2048
#: Words whose ids a Python worker remembers, from task to task; beyond it the memory starts anew.
CACHE_WORDS = 800_000
LONGEST_CACHED = 40

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


class WordIds:
    """Ids of a text as little-endian 32-bit words. Blanks and line feeds separate what this tokenizer treats apart
    (it lower-cases, drops white space, splits letters from marks and merges within these), so each stretch between
    them, less a full stop or comma at its end, is tokenised once and remembered. Texts with combining marks or with
    the beginning of a special token are tokenised whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def learn(self, words: set[bytes]) -> None:
        new = [w.decode() for w in words]
        plain = [w for w in new if w.isalpha()]
        for at in range(0, len(plain), 200):
            part = plain[at : at + 200]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            end = 4 * (np.flatnonzero(self.ends[ids]) + 1)  # a word of letters alone ends where a piece with the word's end does
            if len(end) != len(part):
                for w in part:
                    self.known[w.encode()] = self.whole(w)
                continue
            data, first = ids.tobytes(), 0
            for w, last in zip(part, end.tolist(), strict=True):
                self.known[w.encode()] = data[first:last]
                first = last
        for w in new:
            if not w.isalpha():
                self.known[w.encode()] = self.whole(w)

    def encode(self, texts: list[str]) -> list[bytes]:
        data = [t.encode() for t in texts]
        split = [None if b"<|" in d or b"\xcc" in d or b"\xcd" in d else _MARK.sub(rb"\1 \2", d.lower()).replace(b"\n", b" ").split(b" ") for d in data]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        fresh = set().union(*(w for w in split if w)).difference(self.known)
        self.learn(fresh)
        out = [self.whole(t) if w is None else b"".join(map(self.known.__getitem__, w)) for t, w in zip(texts, split, strict=True)]
        for w in fresh:
            if len(w) > LONGEST_CACHED:
                self.known.pop(w, None)
        return out


_MARK = re.compile(rb"([a-z])([.,])(?=[ \n])")
_CODERS: dict[str, WordIds] = {}


def coder_for(path: str) -> WordIds:
    """The worker's own coder; what it has learned serves the worker's later tasks too."""
    if path not in _CODERS:
        _CODERS[path] = WordIds(path)
    return _CODERS[path]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_len: int) -> DataFrame:
    end = array("I", [end_id]).tobytes()

    def cut(batches):
        coder, seen, part = coder_for(tokenizer), np.zeros(max_len + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            rows = []
            off = utf8(b.column(1))[1]
            coded = (x for a, z in steps(off) for x in coder.encode([t or "" for t in b.column(1)[a:z].to_pylist()]))
            for doc_id, data in zip(b.column(0).to_pylist(), coded, strict=True):
                data += end
                n = len(data) // 4
                for at in range(0, n, max_len):
                    length = min(max_len, n - at)
                    rows.append((doc_id, at, length, zlib.crc32(data[4 * at : 4 * (at + length)]), n, part, int(seen[length])))
                    seen[length] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 5 else pa.int64()) for k, c in enumerate(cols)], names=[x.split()[0] for x in PIECE.split(", ")])

    batch_rows(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(lean(cut), PIECE)


def patterns(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[tuple[int, int], ...]]]:
    """(count, ((length, times), ...)) for each packing pattern, lengths placed longest first into the shortest pack."""
    room: list[list[list]] = [[] for _ in range(max_len + 1)]  # by tokens left: [count, pattern]
    most = 0
    for length in sorted((k for k, v in histogram.items() if v), reverse=True):
        left = histogram[length]
        while left:
            while most > 0 and not room[most]:
                most -= 1
            if most < length or not room[most]:
                # a new pack is the shortest until no more of this length fits
                times = min(left, max_len // length)
                count = left // times
                room[max_len - times * length].append([count, ((length, times),)])
                most, left = max(most, max_len - times * length), left - count * times
                continue
            pack = room[most][-1]
            times = min(most // length, -(-left // pack[0]))  # how many of this length the shortest packs take in a row
            times = max(1, min(times, left // pack[0])) if left >= pack[0] else 1
            # one more would leave it longer than the next shortest: place one at a time unless it is alone
            if len(room[most]) > 1 or any(room[k] for k in range(max(0, most - length * (times - 1)), most)):
                times = 1
            take = min(pack[0], left // times)
            pack[0] -= take
            if not pack[0]:
                room[most].pop()
            old = pack[1]
            new = (*old[:-1], (length, old[-1][1] + times)) if old[-1][0] == length else (*old, (length, times))
            room[most - times * length].append([take, new])
            left -= take * times
    merged: dict[tuple, int] = {}
    for rows in room:
        for count, pattern in rows:
            merged[pattern] = merged.get(pattern, 0) + count
    return [(c, p) for p, c in sorted(merged.items(), reverse=True)]


def slots(found, max_len: int) -> dict[int, np.ndarray]:
    """By length: rows (first rank, times in the pattern, first sequence, offset), in the order of rank."""
    out: dict[int, list] = {}
    rank: dict[int, int] = {}
    sequence = 0
    for count, pattern in found:
        at = 0
        for length, times in pattern:
            out.setdefault(length, []).append((rank.get(length, 0), times, sequence, at))
            rank[length] = rank.get(length, 0) + count * times
            at += length * times
        sequence += count
    return {k: np.array(v, np.int64) for k, v in out.items()}


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, max_len: int = MAX_LEN) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)."""
    held = written(pieces(docs, tokenizer, end_id, max_len), "pieces")
    counts = held.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    earlier = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    base = counts.select("part", "length", earlier.alias("base"))
    histogram = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # max_len rows at most
    where = slots(patterns(histogram, max_len), max_len)
    ranked = held.join(base, ["part", "length"]).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("nth")).alias("rank"))

    def place(batches):
        for b in batches:
            length, rank = b.column(2).to_numpy(), b.column(5).to_numpy()
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                t = where[int(n)]
                row = t[np.searchsorted(t[:, 0], rank[at], side="right") - 1]
                k = rank[at] - row[:, 0]
                seq[at], off[at] = row[:, 2] + k // row[:, 1], row[:, 3] + k % row[:, 1] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], names=[*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(lean(place), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op8_histogram_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
