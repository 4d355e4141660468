"""Exact substring dedup with suffix arrays.

A byte is removed if a string of `LENGTH` bytes covers it that also starts in a document with a smaller doc_id.

Every string of LENGTH bytes (a window) has one anchor: the `GRAM`-byte string in it with the smallest hash. A window
repeats in another text only if its anchor does. The windows of one place of an anchor are consecutive, and the bytes
that they span are the place's context. Equal texts are one from the start (the smallest doc_id stands for them), and
texts are dealt by hash into stretches of about STRETCH_BYTES, the unit in which everything is handled:

1. A stretch sends each of its distinct anchors once, as 32 bits and a count, to the anchor's bucket. The bucket tells
   the stretches back which anchors lie in several texts, and which in so many (`HOT`) that they are split.
2. A stretch sends each distinct context of such anchors once, with its smallest doc_id, to the anchor's bucket. The
   bucket tells the smallest doc_id of each window of each context back.
3. A stretch cuts the windows out that have a smaller doc_id than their own.

So a string that very many texts share counts once a stretch and not once a text. Within a bucket, an anchor with one
context is settled by that. The windows of other contexts are cut into thirds, by how many bytes stand before the
anchor; the windows of a third have the anchor and 18 bytes more in common with each other, so that only contexts equal
in these can share one, and they meet under them. What is still several different strings there goes through a suffix
array by linear grouping (_suffix.py), the common bytes as one symbol; equal windows are neighbours in its order, and
each run of them gets its smallest doc_id. Split anchors are sent by ninths instead, i.e. under the anchor and 24 bytes
more, with at most four bytes that differ: the number of different strings under one key is bounded by that and does
not grow with the number of texts.

Defined results: a null text is empty; a null doc_id counts as the largest; rows with equal ids are no earlier than
each other, and repeated rows give the same result each; an empty table gives an empty result; extra columns are
ignored. Texts are named by SHA-256; contexts and windows are compared byte by byte.
"""

from __future__ import annotations

import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import STEP_BYTES, batch_rows, erase, lean, mix64, ranges, steps, table, utf8, written
from ._suffix import suffix_array

LENGTH, GRAM = 50, 24
SPAN = LENGTH - GRAM + 1
#: Windows that share a key, of an anchor's SPAN: a third of them, or a ninth where the anchor is split.
THIRD, NINTH = 9, 3
#: Texts that have an anchor from which on it is split (at most 255, as counts are sent as bytes).
HOT = 255
STRETCH_BYTES, BUCKET_BYTES = 4 << 20, 6 << 20
#: Symbols that one suffix array is built over (whole keys).
ARRAY = 1 << 17
LAST = 2**63 - 1
_B = np.uint64(0x9E3779B97F4A7C15)
_BYTE = mix64(np.arange(11, 267, dtype=np.uint64))


def window_hashes(x: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of `size` bytes, by doubling."""
    n = len(x) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h, have, base = _BYTE[x], 1, int(_B)
    out, done = None, 0
    while True:
        if size & have:
            out = h[:n].copy() if out is None else out * np.uint64(pow(int(_B), have, 1 << 64)) + h[done : done + n]
            done += have
        if done == size:
            return mix64(out)
        h = h[:-have] * np.uint64(base) + h[have:]
        have, base = 2 * have, base * base % (1 << 64)


def anchors(x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, hash, place, first window, last window + 1) of the anchors of a batch of texts; every window has exactly one anchor."""
    parts = []
    for a in range(0, max(0, len(x) - LENGTH + 1), STEP_BYTES):
        g = window_hashes(x[a : min(len(x), a + STEP_BYTES + LENGTH - 1)], GRAM)
        # 40 bits of hash, then the place, so that the leftmost of equal ones wins
        v = (g >> np.uint64(24) << np.uint64(24)) | np.arange(len(g), dtype=np.uint64)
        have = 1
        while 2 * have <= SPAN:
            v = np.minimum(v[:-have], v[have:])
            have *= 2
        low = np.minimum(v[: len(v) - (SPAN - have)], v[SPAN - have :])
        first, last = (int(i) for i in np.searchsorted(off, [a, a + len(low) - 1], side="right") - 1)
        begin = np.maximum(off[first : last + 1] - a, 0)
        ends = np.minimum(off[first + 1 : last + 2] - LENGTH + 1 - a, len(low))
        n = np.maximum(ends - begin, 0)
        at = ranges(begin, n)  # windows that lie within one text
        place = (low[at] & np.uint64((1 << 24) - 1)).astype(np.int64)
        text = np.repeat(np.arange(first, last + 1), n)
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (text[1:] != text[:-1])]) if len(at) else np.zeros(0, np.int64)
        own = off[text[new]] - a
        parts.append((text[new], mix64(g[place[new]]), place[new] - own, at[new] - own, at[np.r_[new[1:], len(at)][: len(new)] - 1] + 1 - own))
    if not parts:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def narrow(h: np.ndarray, buckets: int) -> np.ndarray:
    """The name of an anchor while it is dealt: its bucket, which the high half of its hash tells, and the low half."""
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) << np.uint64(32) | (h & np.uint64(0xFFFFFFFF))


def firsts_of(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def cuts(x: np.ndarray) -> list[tuple[int, int]]:
    at = firsts_of(x)
    return list(zip(at.tolist(), np.r_[at[1:], len(x)][: len(at)].tolist(), strict=True))


def batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def tabled(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([batch(schema, rows)])


def packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


#: What blobs hold: a string that a stretch sends, a place of such a string, and a run of windows with one smallest doc_id.
STRING = np.dtype([("number", "<u4"), ("size", "u1"), ("low", "<i8")])
PLACE = np.dtype([("text", "<u4"), ("start", "<u4"), ("number", "<u4")])
RUN = np.dtype([("number", "<u4"), ("first", "u1"), ("end", "u1"), ("low", "<i8")])
SENT = pa.schema([("bucket", pa.int32()), ("stretch", pa.int64()), ("wide", pa.bool_()), ("blob", pa.binary())])
SENT_SQL = "bucket int, stretch long, wide boolean, blob binary"
TOLD = pa.schema([("stretch", pa.int64()), ("blob", pa.binary())])
TOLD_SQL = "stretch long, blob binary"


# --- anchors that several texts share ----------------------------------------------------------------------------------
def shared(texts: DataFrame, buckets: int) -> DataFrame:
    """(stretch, blob): anchors of the stretch that lie in several texts; blob has their count, names, and whether they are split."""

    def told(stretch, keys):
        key = np.sort(np.concatenate(keys))
        at = firsts_of(key)
        n = np.minimum(np.diff(np.r_[at, len(key)]), 255).astype(np.uint8)
        key = key[at]
        bucket = (key >> np.uint64(32)).astype(np.int64)
        low = key.astype(np.uint32)
        return [(int(bucket[a]), stretch, False, low[a:z].tobytes() + n[a:z].tobytes()) for a, z in cuts(bucket)]

    def send(batches):
        now, keys, size = None, [], 0
        for b in batches:
            raw, off = utf8(b.column(1))
            stretch = b.column(0).to_numpy()
            for i, j in cuts(stretch):
                if stretch[i] != now or size > 4 * STRETCH_BYTES:  # a stretch may send several times
                    if size:
                        for rows in itertools.batched(told(now, keys), 256):
                            yield batch(SENT, rows)
                    now, keys, size = int(stretch[i]), [], 0
                for a, z in steps(off[i : j + 1]):
                    text, h, *_ = anchors(raw[off[i + a] : off[i + z]], off[i + a : i + z + 1] - off[i + a])
                    key = narrow(h, buckets)
                    order = np.lexsort((key, text))
                    key, text = key[order], text[order]
                    keys.append(key[np.r_[True, (key[1:] != key[:-1]) | (text[1:] != text[:-1])][: len(key)]])  # once a text
                    size += 8 * len(key)
        if size:
            for rows in itertools.batched(told(now, keys), 256):
                yield batch(SENT, rows)

    def tell(t: pa.Table) -> pa.Table:
        own, keys, counts = np.uint64(t["bucket"][0].as_py()) << np.uint64(32), [], []
        for x in t["blob"]:
            x = x.as_buffer()
            n = len(x) // 5
            keys.append(np.frombuffer(x, np.uint32, n))
            counts.append(np.frombuffer(x, np.uint8, n, 4 * n))
        of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        key, count = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(key, kind="stable")
        at = firsts_of(key[order])
        total = np.empty(len(key), np.int64)
        total[order] = np.repeat(np.add.reduceat(count[order], at), np.diff(np.r_[at, len(key)]))
        keep = total > 1
        key, hot, of = key[keep].astype(np.uint64) | own, total[keep] >= HOT, of[keep]
        stretch = t["stretch"].to_pylist()
        return tabled(TOLD, [(stretch[of[a]], key[a:z].tobytes() + hot[a:z].tobytes()) for a, z in cuts(of)])

    sent = texts.select("stretch", "text").mapInArrow(lean(send), SENT_SQL)
    return sent.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lean(tell), TOLD_SQL)


# --- contexts ----------------------------------------------------------------------------------------------------------
def distinct_texts(t: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """A stretch's texts in order of name, each once; their ids, bytes and offsets."""
    t = t.sort_by("sha")
    names = t["sha"].to_pylist()
    t = t.take([i for i in range(len(names)) if not i or names[i] != names[i - 1]])
    raw, off = utf8(t["text"])
    return t, t["id"].to_numpy(), raw, off


def under(place: int, lo: int, hi: int, width: int):
    """(first byte, end, bytes before the key) of the strings that an anchor's windows lo to hi - 1 are cut into, `width` windows each."""
    for a in range(SPAN - width, -1, -width):  # bytes before the anchor, from and to
        most, least = min(a + width - 1, place - lo), max(a, place - hi + 1)
        if least <= most:
            yield place - most, place - least + LENGTH, most - a


def contexts(texts: DataFrame, known: DataFrame, key_buckets: int, buckets: int) -> DataFrame:
    """What stretches send: contexts to buckets; to bucket -1, the places of contexts, for themselves."""

    def send(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return tabled(SENT, [])
        stretch = left["stretch"][0].as_py()
        _, ids, raw, off = distinct_texts(left)
        parts = [x.as_buffer() for x in right["blob"]]
        key = np.concatenate([np.frombuffer(x, np.uint64, len(x) // 9) for x in parts])
        hot = np.concatenate([np.frombuffer(x, bool, len(x) // 9, 8 * (len(x) // 9)) for x in parts])
        order = np.argsort(key)
        key, hot = key[order], hot[order]
        whole: dict[bytes, int] = {}  # number of a string with the place of its key, if it is not split, and if it is
        split: dict[bytes, int] = {}
        where, entry, deal = [], [], []
        for a, z in steps(off):
            data, base = raw[off[a] : off[z]].tobytes(), off[a:z] - off[a]
            text, h, place, lo, hi = anchors(raw[off[a] : off[z]], off[a : z + 1] - off[a])
            name = narrow(h, key_buckets)
            found = np.minimum(np.searchsorted(key, name), len(key) - 1)
            keep = np.flatnonzero(key[found] == name)
            cold, base_of = ~hot[found[keep]], base[text[keep]]
            for i, b, p, f, e, one in zip((text[keep] + a).tolist(), base_of.tolist(), place[keep].tolist(), lo[keep].tolist(), hi[keep].tolist(), cold.tolist(), strict=True):
                if one:
                    k = data[b + f : b + e + LENGTH - 1] + _ONE[p - f]
                    n = whole.get(k)
                    if n is None:
                        n = whole[k] = len(deal)
                        deal.append(zlib.crc32(data[b + p : b + p + GRAM]))
                    where.append((i, f))
                    entry.append(n)
                else:
                    for s, t, g in under(p, f, e, NINTH):
                        k = data[b + s : b + t] + _ONE[g]
                        n = split.get(k)
                        if n is None:
                            n = split[k] = len(deal)
                            deal.append(zlib.crc32(k[g : g + LENGTH - NINTH + 1]))
                        where.append((i, s))
                        entry.append(n)
        if not entry:
            return tabled(SENT, [])
        where, entry = np.array(where, np.int64), np.array(entry, np.int64)
        low = np.full(len(deal), LAST)
        np.minimum.at(low, entry, ids[where[:, 0]])
        bucket = np.array(deal, np.uint64) * np.uint64(buckets) >> np.uint64(32)
        places = np.empty(len(entry), PLACE)
        places["text"], places["start"], places["number"] = where[:, 0], where[:, 1], entry
        rows = [(-1, stretch, False, packed(places.tobytes()))]
        for strings, wide in ((whole, True), (split, False)):
            number, string = np.fromiter(strings.values(), np.int64, len(strings)), list(strings)
            order = np.argsort(bucket[number], kind="stable")
            for a, z in cuts(bucket[number[order]]):
                o = order[a:z]
                own = [string[i] for i in o.tolist()]
                head = np.empty(len(own), STRING)
                head["number"], head["size"], head["low"] = number[o], [len(s) for s in own], low[number[o]]
                rows.append((int(bucket[number[o[0]]]), stretch, wide, packed(len(own).to_bytes(8, "little") + head.tobytes() + b"".join(own))))
        return tabled(SENT, rows)

    return texts.groupBy("stretch").cogroup(known.groupBy("stretch")).applyInArrow(lean(send), SENT_SQL)


_ONE = [bytes([i]) for i in range(256)]


def settle(strings: list[bytes], low: list[int], width: int, least: list[list[int]]) -> None:
    """Appends to least[i] the smallest doc_id of each window of strings[i], a string with the place of its key as last byte;
    low has the smallest that has the string. Strings meet under their keys."""
    size = LENGTH - width + 1
    by: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        by.setdefault(s[s[-1] : s[-1] + size], []).append(i)
    chunk, n = [], 0
    for own in by.values():
        if len(own) == 1:
            i = own[0]
            least[i] += [low[i]] * (len(strings[i]) - LENGTH)
            continue
        chunk.append(own)
        n += sum(len(strings[i]) - size + 1 for i in own)
        if n >= ARRAY:
            grouped(strings, low, width, least, chunk)
            chunk, n = [], 0
    if chunk:
        grouped(strings, low, width, least, chunk)


def grouped(strings: list[bytes], low: list[int], width: int, least: list[list[int]], chunk: list[list[int]]) -> None:
    """settle() for the strings of several keys by one suffix array: a symbol for the key, one for each other byte, and one of its own after each string."""
    size, flat = LENGTH - width + 1, [i for own in chunk for i in own]
    text = np.frombuffer(b"".join(strings[i][: strings[i][-1]] + b"\0" + strings[i][strings[i][-1] + size :] for i in flat), np.uint8).astype(np.int64) + len(flat) + len(chunk)
    ends = np.cumsum([len(strings[i]) - size + 1 for i in flat])  # the last symbol of each is where the place of the key stood
    begins = np.r_[0, ends[:-1]]
    text[ends - 1] = np.arange(len(flat))
    text[begins + [strings[i][-1] for i in flat]] = np.repeat(np.arange(len(chunk)), [len(own) for own in chunk]) + len(flat)
    counts = ends - begins - width  # windows
    windows = ranges(begins, counts)
    number = np.full(len(text), -1)
    number[windows] = np.arange(len(windows))
    sa = suffix_array(text)
    sa = sa[number[sa] >= 0]
    rows = np.lib.stride_tricks.sliding_window_view(text, width)[sa]
    new = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]).any(1)])
    out = np.repeat(np.array([low[i] for i in flat], np.int64), counts)
    which = number[sa]
    out[which] = np.repeat(np.minimum.reduceat(out[which], new), np.diff(np.r_[new, len(which)]))
    out = out.tolist()
    for i, a, n in zip(flat, np.r_[0, np.cumsum(counts)[:-1]].tolist(), counts.tolist(), strict=True):
        least[i] += out[a : a + n]


def settle_whole(strings: list[bytes], low: list[int], least: list[list[int]]) -> None:
    """The same for whole contexts, which meet under their anchors."""
    by: dict[bytes, list[int]] = {}
    for i, s in enumerate(strings):
        by.setdefault(s[s[-1] : s[-1] + GRAM], []).append(i)
    pieces: dict[bytes, int] = {}
    piece_low, of = [], []
    for own in by.values():
        if len(own) == 1:
            i = own[0]
            least[i] += [low[i]] * (len(strings[i]) - LENGTH)
            continue
        for i in own:
            s, mine = strings[i], []
            for a, z, g in under(s[-1], 0, len(s) - LENGTH, THIRD):
                k = s[a:z] + _ONE[g]
                n = pieces.get(k)
                if n is None:
                    n = pieces[k] = len(piece_low)
                    piece_low.append(low[i])
                elif low[i] < piece_low[n]:
                    piece_low[n] = low[i]
                mine.append(n)
            of.append((i, mine))
    found: list[list[int]] = [[] for _ in piece_low]
    settle(list(pieces), piece_low, THIRD, found)
    for i, mine in of:
        for n in mine:
            least[i] += found[n]


def settled(sent: DataFrame, buckets: int) -> DataFrame:
    """(stretch, blob): for each string that the stretch sent, runs of windows with one smallest doc_id, (number, first, end, doc_id)."""

    def tell(t: pa.Table) -> pa.Table:
        out = []
        for wide in (True, False):
            numbers: dict[bytes, int] = {}
            low, asked = [], []
            for stretch, w, blob in zip(t["stretch"].to_pylist(), t["wide"].to_pylist(), t["blob"], strict=True):
                if w != wide:
                    continue
                blob = unpacked(blob.as_py())
                n = int.from_bytes(blob[:8], "little")
                head = np.frombuffer(blob, STRING, n, 8)
                at, mine = 8 + STRING.itemsize * n, []
                for size, least in zip(head["size"].tolist(), head["low"].tolist(), strict=True):
                    s = blob[at : at + size]
                    at += size
                    k = numbers.get(s)
                    if k is None:
                        k = numbers[s] = len(low)
                        low.append(least)
                    elif least < low[k]:
                        low[k] = least
                    mine.append(k)
                asked.append((stretch, head["number"], mine))
            least = [[] for _ in low]
            settle_whole(list(numbers), low, least) if wide else settle(list(numbers), low, NINTH, least)
            runs = []
            for x in least:
                if x.count(x[0]) == len(x):
                    runs.append([(0, len(x), x[0])])
                else:
                    at = [0, *(i for i in range(1, len(x)) if x[i] != x[i - 1]), len(x)]
                    runs.append([(a, z, x[a]) for a, z in itertools.pairwise(at)])
            for stretch, number, mine in asked:
                flat = np.array([(n, *r) for n, k in zip(number.tolist(), mine, strict=True) for r in runs[k]], RUN)
                out.append((stretch, packed(flat.tobytes())))
        return tabled(TOLD, out)

    return sent.filter("bucket >= 0").repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lean(tell), TOLD_SQL)


OUT = pa.schema([("sha", pa.string()), ("removed", pa.int64()), ("runs", pa.int64()), ("sha_kept", pa.string()), ("kept", pa.string())])
OUT_SQL = "sha string, removed long, runs long, sha_kept string, kept string"


def cut(texts: DataFrame, places: DataFrame, answers: DataFrame, with_text: bool) -> DataFrame:
    """Rows of OUT for the texts that lose bytes."""

    def work(_, left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return tabled(OUT, [])
        t, ids, raw, off = distinct_texts(left)
        blobs = [(unpacked(x.as_py()), p) for x, p in zip(right["blob"], right["places"].to_pylist(), strict=True)]
        own = np.concatenate([np.frombuffer(x, PLACE) for x, p in blobs if p])
        told = np.concatenate([np.frombuffer(x, RUN) for x, p in blobs if not p])
        told = told[np.argsort(told["number"], kind="stable")]
        number = told["number"].copy()
        at = np.searchsorted(number, own["number"])
        n = np.searchsorted(number, own["number"], side="right") - at
        run, text, start = told[ranges(at, n)], np.repeat(own["text"], n), np.repeat(own["start"].astype(np.int64), n)
        keep = run["low"] < ids[text]
        run, begin = run[keep], (off[text] + start)[keep]
        edge = np.zeros(len(raw) + 1, np.int32)
        np.add.at(edge, begin + run["first"], 1)
        np.add.at(edge, begin + run["end"] + LENGTH - 1, -1)
        gone = np.cumsum(edge[:-1]) > 0
        rise = gone & ~np.r_[False, gone[:-1]]
        rise[off[:-1]] = gone[off[:-1]]
        total, rises = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(rise)]
        removed, runs = total[off[1:]] - total[off[:-1]], rises[off[1:]] - rises[off[:-1]]
        rows = []
        for i in np.flatnonzero(removed).tolist():
            kept = raw[off[i] : off[i + 1]][~gone[off[i] : off[i + 1]]].tobytes()
            rows.append((t["sha"][i].as_py(), int(removed[i]), int(runs[i]), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if with_text else None))
        return tabled(OUT, rows)

    told = places.select("stretch", "blob", F.lit(True).alias("places")).unionByName(answers.select("stretch", "blob", F.lit(False).alias("places")))
    return texts.groupBy("stretch").cogroup(told.groupBy("stretch")).applyInArrow(lean(work), OUT_SQL)


def text_name(text="text"):
    """The name of a text in dedup()'s result."""
    return F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)


def dedup(docs: DataFrame, texts: bool = False) -> DataFrame:
    """(doc_id, name, n_bytes, n_removed, n_spans, kept_sha256, kept) of all rows; name is text_name(); kept, the text without the removed bytes
    (less any incomplete character at a cut), is filled, where bytes were removed, if texts is set."""
    spark = docs.sparkSession
    batch_rows(spark)
    rows = docs.select("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.coalesce("text", F.lit("")).alias("text"), text_name().alias("sha"))
    own = written(rows.select("doc_id", "id", "sha", F.octet_length("text").cast("long").alias("n_bytes")), "texts")
    firsts = written(own.groupBy("sha").agg(F.min("id").alias("first"), F.first("n_bytes").alias("n_bytes")), "firsts")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = firsts.filter(F.col("n_bytes") >= LENGTH).agg(F.sum("n_bytes")).first()[0] or 0
    stretches, key_buckets = size // STRETCH_BYTES + 1, max(partitions, size * 5 // (14 * BUCKET_BYTES) + 1)
    once = rows.filter(F.octet_length("text") >= LENGTH).join(firsts.select("sha", F.col("first").alias("id")), ["sha", "id"]).select(F.pmod(F.xxhash64("sha"), F.lit(stretches)).alias("stretch"), "sha", "id", "text")
    once = written(once.repartition("stretch").sortWithinPartitions("stretch"), "once")
    known = written(shared(once, key_buckets), "shared")
    n = known.agg(F.sum(F.octet_length("blob"))).first()[0] or 0
    buckets = max(partitions, n * 8 // BUCKET_BYTES + 1)
    sent = written(contexts(once, known, key_buckets, buckets), "sent")
    answers = written(settled(sent, buckets), "answers")
    done = written(cut(once, sent.filter("bucket < 0"), answers, texts), "cut")
    erase(once, known, sent, answers)
    base = own.join(firsts.select("sha", "first"), "sha").join(done, "sha", "left")
    copy = (F.col("first") < F.col("id")) & (F.col("n_bytes") >= LENGTH)
    return base.select(
        "doc_id",
        F.col("sha").alias("name"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("runs", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("sha_kept", "sha")).alias("kept_sha256"),
        F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"),
    )


def op5_suffix_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
