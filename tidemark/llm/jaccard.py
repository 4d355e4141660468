"""Jaccard self-join on word shingles by parity sketches.

Every distinct shingle flips one bit of its text's sketch, so the Hamming distance of two sketches is at most the size
of the symmetric difference of the two sets. Texts fall into size bands; two sets with similarity of at least 3/4
whose smaller lies in band b differ in at most D(b) shingles, so of the blocks that the band cuts sketches into, all
but D(b) agree (pigeonhole). Band b's blocks are joined on their content: a block is a long sparse run of the sketch,
and its content is told by the XOR of its set bits' mixed addresses. A text takes part in its own band and in the one
below. Blocks without a shingle are left out; a text with more filled blocks than D(b) still agrees in as many as it has
more, which a pair must reach, and the few small texts with no more than that are also joined on their single shingles.

Candidates pass the Hamming bound on dense sketches (at least as many bits as shingles, folded to the smaller of
the two) and are then verified on the whole sets.

Equal sets are one class from the start. Block contents shared by more than `HOT` classes (a passage that many texts
have, or a large group of near copies) are never expanded into pairs: a text that has more filled blocks apart from
these than D(b) is found by the others. Only pairs of texts that are both made up mostly of such blocks are left. For
these (`crowded`) blocks shrink to single shingles and bands to the exact sizes: linked sets of sizes a and b share at
least 3/7 (a + b) shingles, so in one common order, the rarest first, they share one of the first quarter of each.
Shingles of at most HOT crowded texts give pairs. A text that has so many of these that it needs no other is done; the
rest meet under their frequent shingles, but each only with the leader there, the text with the fewest rare shingles,
i.e. the one nearest to what the group has in common. What then lies in another component than most of its group is
compared with the group, block by block, by size, by the number of shingles that the two can have in common at all,
and by sketch; only what passes is told. Contents that are frequent within one task are told at once by a marker, and so
their members never meet in one task.

Defined results: null texts and texts without a word have no shingle and are linked with nothing; fewer than five
words are one shingle; equal texts and repeated rows share a class; a null doc_id gets the component of its text, which
is null if the whole component has no doc_id; one doc_id on unlike texts is one row each, with its own component; an
empty table gives an empty result; extra columns are ignored. Shingles are told apart by 64-bit hashes within a pair of
texts, classes by 128 bits of hash.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import batch_rows, erase, lean, mix64, steps, table, utf8, written
from ._words import NOT_BLANK, grams, words

WIDTH = 5
#: Classes that share a block's content beyond which no pairs are made of them, and the same within one task's stretch.
HOT, HOT_IN_TASK = 16, 16
#: Keys that a task gathers before it deals them to buckets, and bytes of a bucket.
FLUSH_KEYS, BUCKET_BYTES = 1_500_000, 20 << 20
MOST_BITS = 1 << 16
#: Bits of the filter by which sets are chosen for verification (16 MB); beyond some 10^8 classes it chooses nearly all.
FILTER_BITS = 1 << 27
#: Texts in a block of those that are left to be compared one by one.
BLOCK = 2048
_Z = np.uint64(0x9E3779B97F4A7C15)


def shingles(w: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of one text's word hashes."""
    if not len(w):
        return w
    if len(w) < WIDTH:
        return grams(w, tuple(range(len(w)))) ^ np.uint64(len(w))
    return np.unique(grams(w, tuple(range(WIDTH))))


def texts_of(batch_column):
    """Word hashes text by text."""
    raw, off = utf8(batch_column)
    for a, z in steps(off):
        w, w_off = words(raw[off[a] : off[z]], off[a : z + 1] - off[a], NOT_BLANK)
        for i in range(z - a):
            yield w[w_off[i] : w_off[i + 1]]


def fingerprint(h: np.ndarray) -> bytes:
    """128 bits that name a set."""
    parts = np.array([h.sum(dtype=np.uint64), np.bitwise_xor.reduce(mix64(h ^ _Z)), mix64(h + _Z).sum(dtype=np.uint64), len(h)], np.uint64)
    return hashlib.blake2b(parts.tobytes(), digest_size=16).digest()


def sketch(h: np.ndarray) -> bytes:
    """Parity bits, a power of two of them and at least as many as shingles, up to MOST_BITS."""
    bits = min(MOST_BITS, max(64, 1 << int(len(h) - 1).bit_length()))
    return np.packbits((np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Distance of two sketches, the longer folded onto the shorter."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = np.bitwise_xor.reduce(x.reshape(-1, len(y)), axis=0)
    return int(np.bitwise_count(x ^ y).sum())


def most_apart(a: int, b: int) -> int:
    """The largest symmetric difference of linked sets of these sizes; negative where none can be linked."""
    least = -(-3 * (a + b) // 7)  # 100 i >= 75 (a + b - i)
    return a + b - 2 * least if least <= min(a, b) else -1


@functools.lru_cache(None)
def bands() -> np.ndarray:
    """First sizes of the bands, each at most a third above the one before."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, out[-1] * 4 // 3))
    return np.array(out, np.int64)


@functools.lru_cache(None)
def scheme(b: int) -> tuple[int, int]:
    """(D, blocks) of band b: the most that linked sets differ in whose smaller lies in the band, and its blocks."""
    lo, hi = int(bands()[b]), int(bands()[b + 1])
    if hi - lo < 64:
        d = max(most_apart(x, y) for x in range(lo, hi) for y in range(x, 4 * x // 3 + 1))
    else:
        d = (hi - 1) // 3
    return d, 16 * lo if lo < 32 else 2 * (d + 1) if lo < 256 else 3 * (d + 1) // 2


def keys(h: np.ndarray, n: int):
    """(key, flag, slack) for the bands that this set takes part in: flag 1 is the band below; slack is how many frequent keys it can do without."""
    b = int(np.searchsorted(bands(), n, side="right")) - 1
    # a smaller partner has at least 3/4 of the size, which is in this band or the one below, or two below where bands are narrow
    first = int(np.searchsorted(bands(), -(-3 * n // 4), side="right")) - 1
    for j in range(first, b + 1):
        d, blocks = scheme(j)
        at = ((h >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32) if blocks < 1 << 31 else h >> np.uint64(33)
        new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        content = np.bitwise_xor.reduceat(mix64(h ^ np.uint64(j + 1)), new)
        key = mix64(content + at[new] * _Z + np.uint64(j))
        slack = len(key) - d - 1
        if slack < 0:
            key = np.r_[key, mix64(h * _Z + np.uint64(j))]
        yield key, b - j, slack


#: A class and which of its bands (4 * id + flag, negative for a marker), and its slack, of which more than this many say nothing more.
MEMBER = np.dtype([("own", "<i8"), ("slack", "<i2")])
MOST_SLACK = 32767


def dealt(once: DataFrame, buckets: int) -> DataFrame:
    """(bucket, hot, blob): the keys of all classes (id, text), dealt by key; those frequent in a stretch are dealt at random, with a marker to the key's bucket."""

    def flush(keys_, who, members):
        key, of = np.concatenate(keys_), np.concatenate(who)
        # while they are dealt, keys are named by their bucket, which the high half tells, and the low half
        key = ((key >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32) << np.uint64(32) | (key & np.uint64(0xFFFFFFFF))
        table_ = np.array(members, MEMBER)
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        n = np.diff(np.r_[new, len(key)])
        hot = np.repeat(n > HOT_IN_TASK, n)
        marks = key[new[n > HOT_IN_TASK]]
        rows = []
        # a marker is a key whose member number is -1
        cold = np.r_[key[~hot], marks]
        cold_of = np.r_[of[~hot], np.full(len(marks), -1)]
        order = np.argsort(cold, kind="stable")
        cold, cold_of = cold[order], cold_of[order]
        bucket = cold >> np.uint64(32)
        new = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        for a, z in zip(new, np.r_[new[1:], len(bucket)][: len(new)], strict=True):
            rows.append((int(bucket[a]), False, _blob(cold[a:z] & np.uint64(0xFFFFFFFF), cold_of[a:z], table_, False)))
        k, o = key[hot], of[hot]
        for a in range(0, len(k), 50_000):
            rows.append((int(mix64(k[a : a + 1] + np.uint64(a))[0] % np.uint64(buckets)), True, _blob(k[a : a + 50_000], o[a : a + 50_000], table_, True)))
        cols = list(zip(*rows, strict=True))
        for a in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array(cols[0][a : a + 64], pa.int32()), pa.array(cols[1][a : a + 64]), pa.array(cols[2][a : a + 64], pa.binary())], names=["bucket", "hot", "blob"])

    def work(batches):
        ks, who, members, seen, size = [], [], [], set(), 0
        for b in batches:
            for i, w in zip(b.column(0).to_pylist(), texts_of(b.column(1)), strict=True):
                if i in seen:
                    continue
                seen.add(i)
                h = shingles(w)
                for key, flag, slack in keys(h, len(h)):
                    ks.append(key)
                    who.append(np.full(len(key), len(members), np.int32))
                    members.append((4 * i + flag, min(slack, MOST_SLACK)))
                    size += len(key)
                if size >= FLUSH_KEYS:
                    yield from flush(ks, who, members)
                    ks, who, members, seen, size = [], [], [], set(), 0
        if size:
            yield from flush(ks, who, members)

    return once.select("id", "text").mapInArrow(lean(work), "bucket int, hot boolean, blob binary")


def _blob(key: np.ndarray, of: np.ndarray, members: np.ndarray, wide: bool) -> bytes:
    """Keys (in full, or the low half where the bucket tells the rest), numbers into the members that occur, and those."""
    used, number = np.unique(of, return_inverse=True)
    real = used >= 0
    table_ = np.zeros(len(used), MEMBER)
    table_[real] = members[used[real]]
    table_["own"][~real] = -1
    small = len(used) <= 1 << 16
    return np.array([len(key), len(used), small], np.int64).tobytes() + key.astype(np.uint64 if wide else np.uint32).tobytes() + number.astype(np.uint16 if small else np.uint32).tobytes() + table_.tobytes()


def _unblob(data: bytes, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, numbers into the members, and those."""
    n, m, small = np.frombuffer(data, np.int64, 3).tolist()
    key = np.frombuffer(data, np.uint64 if wide else np.uint32, n, 24).astype(np.uint64)
    at = 24 + n * (8 if wide else 4)
    number = np.frombuffer(data, np.uint16 if small else np.uint32, n, at)
    return key, number.astype(np.int32), np.frombuffer(data, MEMBER, m, at + n * (2 if small else 4))


FOUND = "hot boolean, key long, a long, b long, slack int, flag int"


def matched(bucketed: DataFrame, buckets: int) -> DataFrame:
    """Pairs (hot false: a, b, in `slack` how many infrequent keys of the bucket they share, in `key` both sides' slack and flag, see agreeing())
    and the members of frequent keys (hot true: key, a, slack, flag)."""

    def rows(hot, n, key=None, a=None, b=None, slack=None, flag=None):
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = [pa.nulls(n, k) if c is None else pa.array(c, k) for c, k in zip((key, a, b, slack, flag), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, hot)), *columns], names=[x.split()[0] for x in FOUND.split(", ")])

    def frequent(k, m):
        return rows(True, len(k), key=k.view(np.int64), a=m["own"] >> 2, slack=m["slack"].astype(np.int32), flag=(m["own"] & 3).astype(np.int32))

    def group(t: pa.Table) -> pa.Table:
        out, key, who, members, base = [], [], [], [], 0
        own = np.uint64(t["bucket"][0].as_py()) << np.uint64(32)
        for hot, blob in zip(t["hot"].to_pylist(), t["blob"], strict=True):
            k, number, m = _unblob(blob.as_py(), hot)
            if hot:
                out.append(frequent(k, m[number]))
            else:
                key.append(k | own)
                who.append(number + np.int32(base))
                members.append(m)
                base += len(m)
        if key:
            k, of, m = np.concatenate(key), np.concatenate(who), np.concatenate(members)
            del key, who, members
            order = np.argsort(k, kind="stable")
            k, of = k[order], of[order]
            n = np.diff(np.r_[np.flatnonzero(np.r_[True, k[1:] != k[:-1]]), len(k)])
            keep = np.repeat(n > 1, n)  # most keys are alone
            k, of = k[keep], of[keep]
            ids = m["own"][of] >> 2
            order = np.lexsort((ids, k))
            k, of, ids = k[order], of[order], ids[order]
            new = np.r_[True, (k[1:] != k[:-1]) | (ids[1:] != ids[:-1])] if len(k) else np.zeros(0, bool)
            k, of, ids = k[new], of[new], ids[new]  # repeated rows
            at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
            n = np.diff(np.r_[at, len(k)])
            marked = np.maximum.reduceat(ids < 0, at) if len(at) else np.zeros(0, bool)
            big = marked | (n > HOT)
            told = np.repeat(big, n) & (ids >= 0)
            if told.any():
                out.append(frequent(k[told], m[of[told]]))
            pairs = []
            for size in np.unique(n[~big & (n > 1)]):
                first = at[~big & (n == size)]
                i, j = np.triu_indices(size, 1)
                here = of[first[:, None] + np.arange(size)]
                pairs.append(np.column_stack([here[:, i].ravel(), here[:, j].ravel()]))
            if pairs:
                x, y = m[np.concatenate(pairs)].T
                how = np.maximum(x["slack"], 0).astype(np.int64) | np.maximum(y["slack"], 0).astype(np.int64) << 16 | (x["own"] & 3) << 32 | (y["own"] & 3) << 34
                p = np.column_stack([x["own"] >> 2, y["own"] >> 2, how])
                p = p[np.lexsort((how, p[:, 1], p[:, 0]))]
                new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]).any(1)])
                out.append(rows(False, len(new), key=p[new, 2].copy(), a=p[new, 0].copy(), b=p[new, 1].copy(), slack=np.diff(np.r_[new, len(p)]).astype(np.int32)))
        return pa.Table.from_batches(out or [rows(False, 0)])

    return bucketed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(lean(group), FOUND)


def agreeing(found: DataFrame, hot: DataFrame) -> DataFrame:
    """The pairs (a, b) that share as many infrequent keys as a link takes: linked sets agree in all filled blocks of either
    but D, i.e. in slack + 1, of which no more than its frequent ones (hot: a, flag, n) are not told as pairs."""
    part = lambda at, bits: F.shiftright("key", at).bitwiseAND(F.lit((1 << bits) - 1))
    pairs = found.filter("not hot").groupBy("a", "b", "key").agg(F.sum("slack").alias("shared"))
    pairs = pairs.select("a", "b", "shared", part(0, 16).alias("a_slack"), part(16, 16).alias("b_slack"), part(32, 2).cast("int").alias("a_flag"), part(34, 2).cast("int").alias("b_flag"))
    for c in ("a", "b"):
        own = hot.select(F.col("a").alias(c), F.col("flag").alias(f"{c}_flag"), F.col("n").alias(f"{c}_hot"))
        pairs = pairs.join(own, [c, f"{c}_flag"], "left").filter(f"shared >= {c}_slack + 1 - coalesce({c}_hot, 0)")
    return pairs.select("a", "b").distinct()


def text_name(text="text"):
    """128 bits that name a text, as hexadecimal digits."""
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, name, n_shingles, node, sketch) of all rows; node and sketch are null without a shingle."""

    def work(batches):
        for b in batches:
            rows = []
            for w in texts_of(b.column(2)):
                h = shingles(w)
                rows.append((len(h), fingerprint(h), sketch(h)) if len(h) else (0, None, None))
            n, node, bits = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(node, pa.binary()), pa.array(bits, pa.binary())], names=["doc_id", "name", "n_shingles", "node", "sketch"])

    return docs.select("doc_id", text_name().alias("name"), "text").mapInArrow(lean(work), "doc_id long, name string, n_shingles long, node binary, sketch binary")


def near(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sizes and sketches allow a link."""
    side = lambda c: nodes.select(F.col("id").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_s"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("4 * least(a_n, b_n) >= 3 * greatest(a_n, b_n)")

    def work(batches):
        for b in batches:
            n = zip(*(b.column(i).to_pylist() for i in range(6)), strict=True)
            keep = [(min(x, y), max(x, y)) for x, y, p, q, s, t in n if hamming(s, t) <= most_apart(p, q)]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keep], pa.int64()), pa.array([y for _, y in keep], pa.int64())], names=["a", "b"])

    return both.select("a", "b", "a_n", "b_n", "a_s", "b_s").mapInArrow(lean(work), "a long, b long").distinct()


def probable(ids: DataFrame) -> bytes:
    """FILTER_BITS bits, of which one for each id's hash is set; at most FILTER_BITS / 8 bytes, whatever the ids' number."""
    h = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)) + 1  # bit numbers count from 1
    rows = ids.select(h.alias("h")).groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in rows:
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["bits"], np.uint8)[: len(out) - at]
    return out.tobytes()


def sets_of(once: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, h): the whole sets of the classes in wanted (id). A filter of bounded size spares the sets of most others their
    making; the join leaves exactly the wanted ones."""
    held = once.sparkSession.sparkContext.broadcast(probable(wanted))

    def work(batches):
        bits = np.frombuffer(held.value, np.uint8)
        for b in batches:
            h = b.column(2).to_numpy()
            b = b.filter(pa.array((bits[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(w).tobytes() for w in texts_of(b.column(1))], pa.binary())], names=["id", "h"])

    likely = once.select("id", "text", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("bit")).mapInArrow(lean(work), "id long, h binary")
    return likely.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes that are linked, by their whole sets."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("h").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("h").alias("y")), "b")

    def work(batches):
        for b in batches:
            ids, keep = (b.column(0).to_pylist(), b.column(1).to_pylist()), []
            for i in range(b.num_rows):
                x, y = (np.frombuffer(b.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                z = np.concatenate([x, y])
                z.sort()
                same = int(np.count_nonzero(z[1:] == z[:-1]))
                if 100 * same >= 75 * (len(z) - same):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([ids[k][i] for i in keep], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(lean(work), "a long, b long")


def crowded(nodes: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For the classes `nodes` (id, n), pairs (a, b) that share a rare shingle, and (leader, id, rare) of those that need frequent ones too."""

    def spread(batches):
        for b in batches:
            for i in range(b.num_rows):
                h = np.frombuffer(b.column(1)[i].as_buffer(), np.int64)
                for a in range(0, len(h), 1 << 16):
                    part = h[a : a + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b.column(0)[i].as_py())), pa.array(part)], names=["id", "shingle"])

    entries = written(sets.join(nodes.select("id"), "id").select("id", "h").mapInArrow(lean(spread), "id long, shingle long"), "entries")
    often = written(entries.groupBy("shingle").agg(F.count(F.lit(1)).alias("often")).filter("often > 1"), "often")
    rare = entries.join(often.filter(F.col("often") <= HOT), "shingle").select("shingle", "id")
    pairs = written(rare.withColumnRenamed("id", "a").join(rare.withColumnRenamed("id", "b"), "shingle").filter("a < b").select("a", "b").distinct(), "rare")
    frequent = written(entries.join(often.filter(F.col("often") > HOT), "shingle"), "frequent")
    own = frequent.groupBy("id").agg(F.count(F.lit(1)).alias("common")).join(nodes.select("id", "n"), "id").select("id", "n", (F.col("n") - F.col("common")).alias("rare"))
    own = own.withColumn("needs", F.col("n") - F.ceil(F.col("n") * 0.75) + 1 - F.col("rare")).filter("needs > 0")
    nth = F.row_number().over(W.partitionBy("id").orderBy("often", "shingle"))
    prefix = written(frequent.join(own.withColumn("share", F.col("rare") / F.col("n")), "id").withColumn("nth", nth).filter("nth <= needs").select("shingle", "id", "rare", "share"), "prefix")
    leaders = prefix.groupBy("shingle").agg(F.min(F.struct("share", "id")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("shingle", F.col("first.id").alias("leader"))
    groups = written(prefix.join(leaders, "shingle").select("leader", "id", "rare").distinct(), "groups")
    erase(entries, often, frequent, prefix)
    return pairs, groups


def blockwise(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) that sizes, common shingles and sketches allow to be linked, of the pairs of a group's members (leader, id, rare, part) that lie
    in unlike components `part`; members outside of the group's largest component meet all its members, in blocks."""
    sizes = members.groupBy("leader", "part").agg(F.count(F.lit(1)).alias("n"))
    main = sizes.groupBy("leader").agg(F.max(F.struct("n", "part")).alias("main"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    main = main.select("leader", F.col("main.part").alias("main"), blocks(F.col("n")).alias("all_blocks"), blocks(F.col("n") - F.col("main.n")).alias("few_blocks"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.col(m) - 1))
    block = lambda m: F.pmod(F.xxhash64("id"), F.col(m)).cast("int")
    own = members.join(main, "leader")
    everyone = own.select("leader", "id", "rare", "part", block("all_blocks").alias("i"), every("few_blocks").alias("j"), F.lit(False).alias("few"))
    few = own.filter("part <> main").select("leader", "id", "rare", "part", every("all_blocks").alias("i"), block("few_blocks").alias("j"), F.lit(True).alias("few"))
    rows = everyone.unionByName(few).join(nodes.select("id", "n", "sketch"), "id").select("leader", "i", "j", "few", "id", "rare", "part", "n", "sketch")

    def group(t: pa.Table) -> pa.Table:
        few, ids, rare, part, n, bits = (t[c].to_numpy() for c in ("few", "id", "rare", "part", "n", "sketch"))
        found = set()
        size = np.array([len(x) for x in bits])
        stacks = {k: (at := np.flatnonzero(~few & (size == k)), np.array([np.frombuffer(bits[i], np.uint8) for i in at])) for k in np.unique(size[~few])}
        for j in np.flatnonzero(few).tolist():
            y = np.frombuffer(bits[j], np.uint8)
            for k, (at, x) in stacks.items():
                total = n[at] + n[j]
                least = -(-3 * total // 7)  # shingles in common that a link takes; those of rare shingles are told already
                keep = (part[at] != part[j]) & (4 * np.minimum(n[at], n[j]) >= 3 * np.maximum(n[at], n[j])) & (n[at] - rare[at] >= least) & (n[j] - rare[j] >= least)
                if not keep.any():
                    continue
                at, x, most = at[keep], x[keep], (total - 2 * least)[keep]
                low = min(int(k), len(y))
                p = np.bitwise_xor.reduce(x.reshape(len(x), -1, low), axis=1)
                q = np.bitwise_xor.reduce(y.reshape(-1, low), axis=0)
                found.update((min(ids[i], ids[j]), max(ids[i], ids[j])) for i in at[np.bitwise_count(p ^ q).sum(1) <= most])
        return pa.table([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

    return rows.groupBy("leader", "i", "j").applyInArrow(lean(group), "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of all ids on an edge, by alternating large and small stars; each round is written."""
    e = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = written(large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u > v").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if now == state:
            return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
        state = now


def jaccard_join(docs: DataFrame) -> DataFrame:
    """(doc_id, name, n_shingles, component_id, part) of all rows; name is text_name(); part tells components apart and is null without a shingle."""
    spark = docs.sparkSession
    batch_rows(spark)
    own = written(classes(docs), "classes")
    nodes = own.filter("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "name")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), "node", F.col("rep.doc_id").alias("rep"), F.col("rep.name").alias("name"), "n", "sketch"), "nodes")
    total = nodes.agg(F.sum("n")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total * 7 // BUCKET_BYTES) + 1)
    # each class once, by the text of its name under its doc_id
    rows = docs.select("doc_id", text_name().alias("name"), "text").join(nodes.select("id", "rep", F.col("name").alias("named")), (F.col("name") == F.col("named")) & F.col("doc_id").eqNullSafe(F.col("rep")))
    once = written(rows.select("id", "text"), "once")
    found = written(matched(dealt(once, buckets), buckets), "matched")
    hot = written(found.filter("hot").select("key", "a", "slack", "flag").distinct().groupBy("a", "flag", "slack").agg(F.count(F.lit(1)).alias("n")), "hot")
    pairs = written(near(agreeing(found, hot), nodes), "pairs")
    # texts that have too few infrequent keys to be found by them
    left = written(hot.filter("n > slack").select(F.col("a").alias("id")).distinct().join(nodes, "id").select("id", "n"), "left")
    erase(found, hot)
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(left.select("id")).distinct()
    sets = written(sets_of(once, wanted), "sets")
    erase(once)
    rare, groups = crowded(left, sets)
    stars = groups.filter("id <> leader").select(F.least("leader", "id").alias("a"), F.greatest("leader", "id").alias("b"))
    candidates = written(pairs.unionByName(near(rare.unionByName(stars).distinct(), nodes)).distinct(), "candidates")
    # one candidate a text first; then only what is not yet in one component
    one = candidates.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
    first = written(linked(one, sets), "links")
    part = components(first)
    of = lambda c: part.select(F.col("id").alias(c), F.col("component").alias(f"{c}_part"))
    rest = candidates.join(one, ["a", "b"], "left_anti").join(of("a"), "a", "left").join(of("b"), "b", "left").filter("a_part is null or b_part is null or a_part <> b_part").select("a", "b")
    edges = written(first.unionByName(linked(rest, sets)), "links")
    part = components(edges)
    members = written(groups.join(part, "id", "left").select("leader", "id", "rare", F.coalesce("component", "id").alias("part")), "members")
    more = written(linked(blockwise(members, nodes), sets), "links")
    part = components(edges.unionByName(more))
    final = nodes.select("id", "node", "rep").join(part, "id", "left").select("node", "rep", F.coalesce("component", "id").alias("part"))
    least = final.groupBy("part").agg(F.min("rep").alias("component"))
    out = written(own.select("doc_id", "name", "n_shingles", "node").join(final.join(least, "part").select("node", "part", "component"), "node", "left"), "components")
    erase(own, nodes, pairs, left, sets, rare, groups, candidates, first, edges, members, more)
    return out.select("doc_id", "name", "n_shingles", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component")).alias("component_id"), "part")


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("name", "part")
