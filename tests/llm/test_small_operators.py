import itertools
import random
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import _words, chat, decontam, language, media, packing, quality, sharding, warc
from tidemark.llm._common import shared_dir, utf8

SF = "/root/testdata/sf0.001"


# --- 1 ---------------------------------------------------------------------------------------------------------------
def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_rotation_spans_are_what_the_speaker_says(spark):
    rows = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|end|>"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, None, None, "x"), (1, 200, "eve", "late"), (1, 200, "eve", "late")]
    got = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(turns(spark, rows).withColumn("mask", F.lit(1))).collect()}
    assert {k[:2] for k in got} == {(1, "ann"), (1, "bob"), (1, "eve"), (None, "unknown")}
    first = got[(1, "ann", 0)]
    assert first["text"] == "<|system|>\nbe nice<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo <\\|end|><|end|>\n<|assistant|>\n<|end|>\n"
    assert [first["text"][m["from"] : m["to"]] for m in first["mask"]] == ["hi<|end|>\n", "<|end|>\n"]
    late = got[(1, "eve", 3)]
    assert late["n_turns"] == 2 and late["start_char"] == len(got[(1, "eve", 0)]["text"]) and got[(1, "bob", 3)]["mask"] == []
    assert chat.rotate(turns(spark, rows).limit(0)).count() == 0


def test_rotation_of_very_long_texts_and_many_parts(spark):
    rows = [(9, k, f"p{k % 3}", "é" * 300_000 if k in (5, 170) else f"t{k}") for k in range(200)]
    got = {(r["perspective"], r["part"]): r for r in chat.rotate(turns(spark, rows), part_turns=8).collect()}
    assert len(got) == 3 * 25
    for p in ("p0", "p1", "p2"):
        at = 0
        for part in range(25):
            r = got[p, part]
            said = [t for _, k, who, t in rows if k // 8 == part and who == p]
            assert r["start_char"] == at and [r["text"][m["from"] : m["to"]] for m in r["mask"]] == [t + "<|end|>\n" for t in said]
            at += len(r["text"])


def test_rotation_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{SF}/conversations.parquet'")
    df = chat.op1_perspective_rotation(spark, SF)
    rel = con.execute(chat.OP1_SQL)
    at = [[c[0] for c in rel.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[i] for i in at) for r in rel.fetchall())


# --- 2 and 6 ---------------------------------------------------------------------------------------------------------
def test_quality_separates_and_covers_hard_cases(spark, hard, none):
    good = [(i, f"The {i} quick brown foxes jump over lazy dogs, and then they rest in the shade near a river.", 1) for i in range(60)]
    bad = [(100 + i, f"!!! ### BUY {i} NOW $$$ " * 5, 0) for i in range(60)]
    docs = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    x = quality.measured(docs)
    got = {r["doc_id"]: r for r in quality.scored(x, quality.fit(x, docs.select("doc_id", "quality"))).collect()}
    assert np.mean([got[i]["predicted"] == q for i, _, q in good + bad]) > 0.97
    h = quality.measured(hard)
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 0)], "doc_id long, quality int")
    assert quality.scored(h, quality.fit(h, labels)).count() == hard.count()
    assert all(0 <= r["score"] <= 1 for r in quality.scored(h, quality.fit(x, docs.select("doc_id", "quality"))).collect())
    assert quality.scored(quality.measured(none), quality.fit(h, labels)).count() == 0
    assert quality.fit(quality.measured(none), labels.limit(0)) == {"constant": 0.5}


def test_quality_on_held_out_labels(spark):
    got = quality.op2_quadratic_discriminant(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out and quality is not null")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_words_are_told_apart_like_by_a_regex():
    import re

    texts = ["Hello  WORLD hello", None, "world\x0bx", "", "é É x hello", "hello"]
    raw, off = utf8(pa.array(texts))
    w, at = _words.words(raw, off, _words.NOT_BLANK)
    want = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()) for t in texts]
    assert np.diff(at).tolist() == [len(x) for x in want]
    flat = [x for ws in want for x in ws]
    assert len(set(w.tolist())) == len(set(flat)) and {a: b for a, b in zip(flat, w.tolist(), strict=True)} == dict(zip(flat, w.tolist(), strict=True))


def test_language(spark, hard, none):
    got = language.op6_nearest_centroid(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    rows = language.identify(hard, language.fit(hard)).collect()
    assert len(rows) == hard.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (0, 1, 2)} == {"und"}
    assert language.fit(none) is None and {r["lang_pred"] for r in language.identify(hard, None).collect()} == {"und"}
    kept = language.accepted(hard, language.fit(hard))
    assert kept.columns == hard.columns and kept.filter("text is null or trim(text) = ''").count() == 0


def test_language_against_plain_cosines(spark):
    """Scores and languages of a table against cosines taken one by one, and clean documents, short ones too, against rejection."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = language.fit(docs)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in language.identify(docs, m).collect():
        t = (texts[r["doc_id"]] or "").lower()
        if not any(c.isalpha() for c in t):
            assert (r["lang_pred"], r["score"], r["rejected"]) == ("und", 0, True)
            continue
        v = [np.log1p(float(x)) * float(w) for x, w in zip(language.counts([t])[0], m["idf"], strict=True)]
        cos = [float(np.dot(v, c)) / (np.linalg.norm(v) or 1) for c in m["centroids"]]
        assert abs(max(cos) - r["score"]) < 1e-4 and max(cos) - cos[m["names"].index(r["lang_pred"])] >= -1e-6
        assert max(c for c, n in zip(cos, m["names"], strict=True) if n == r["lang_pred"]) > max(cos) - 1e-5 and not r["rejected"]
    assert not language.judged(["This.", "Avec.", "A. All rights reserved.", "und die"], m)[2].any()


def test_quality_against_plain_densities(spark):
    """Scores against class densities by numpy's inverse and determinant, from the labelled rows of the training fold."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    x = quality.measured(docs)
    rows = {r["doc_id"]: np.frombuffer(r["x"]) for r in x.collect()}
    learn = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1) and r["doc_id"] in rows and zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    own = [np.array([rows[i] for i, q in learn.items() if q == c]) for c in (0, 1)]
    within = sum(np.cov(v.T, bias=True) * len(v) for v in own) / len(learn)
    means = np.array([v.mean(0) for v in own])
    scale = np.sqrt(np.diag(within) + means.var(0) + 1e-9)
    log = {}
    for c in (0, 1):
        s = (1 - quality.SHRINK_POOLED) * np.cov((own[c] / scale).T, bias=True) + quality.SHRINK_POOLED * within / np.outer(scale, scale)
        s = (1 - quality.SHRINK_IDENTITY) * s + quality.SHRINK_IDENTITY * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
        inverse, logdet = np.linalg.inv(s), np.linalg.slogdet(s)[1]
        for i, v in rows.items():
            d = v / scale - means[c] / scale
            log[i, c] = -0.5 * d @ inverse @ d - 0.5 * logdet
    for r in quality.scored(x, quality.fit(x, labels)).collect():
        i = r["doc_id"]
        want = 1 / (1 + np.exp(-np.clip((log[i, 1] - log[i, 0]) / len(scale), -500, 500)))
        assert abs(want - r["score"]) < 1e-6 and r["predicted"] == (r["score"] >= 0.5)


# --- 4 ---------------------------------------------------------------------------------------------------------------
def test_decontamination_tolerates_substitutions_and_spares_clean_texts(spark, hard):
    r = random.Random(0)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    item = [word() for _ in range(30)]
    swapped = [w if i % 8 else "zzz" for i, w in enumerate(item)]
    noise = [word() for _ in range(200)]
    text = lambda ws: " ".join(noise[:50] + ws + noise[50:100])
    docs = spark.createDataFrame([(1, text(item)), (2, text(swapped).upper()), (3, " ".join(noise)), (4, text(item[:6])), (5, None), (6, ""), (7, text(item)), (7, text(item)), (None, text(item)), (9, "one two three four five six seven")], "doc_id long, text string")
    bench = spark.createDataFrame([(10, " ".join(item)), (11, None), (12, ""), (13, "two three four five six"), (14, " ".join(item)), (15, "the of")], "item_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(d, i) for d in (1, 2, 7, None) for i in (10, 14)} | {(9, 13)}
    assert {(r["doc_from"], r["doc_to"]) for r in got if r["doc_id"] == 1} == {(50, 80)} and sum(r["doc_id"] == 7 for r in got) == 4
    assert sorted(r["doc_id"] for r in decontam.clean(docs, bench).collect() if r["doc_id"]) == [3, 4, 5, 6]
    assert decontam.contaminated(docs, bench.limit(0)).count() == 0 and decontam.clean(hard, bench).columns == hard.columns


def test_decontamination_in_blocks(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(map(tuple, decontam.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 300)
    assert once and sorted(map(tuple, decontam.contaminated(docs, bench).collect())) == once
    left = {r["doc_id"] for r in decontam.clean(docs, bench).collect()}
    assert left == {r["doc_id"] for r in docs.collect()} - {r[0] for r in once}


def test_masks_find_every_item_that_is_planted_whole():
    r = np.random.default_rng(0)
    texts = [" ".join("".join(chr(97 + c) for c in r.integers(0, 26, 6)) for _ in range(20)) for _ in range(20)]
    idx = decontam.index([(i, t) for i, t in enumerate(texts)])
    raw, off = utf8(pa.array(texts))
    w, w_off = _words.words(raw, off, _words.ALNUM)
    assert {(a, b) for a, b, *_ in decontam.overlaps(w, w_off, idx)} == {(i, i) for i in range(20)}


def test_overlaps_against_brute_force(spark):
    """Every document of a table against every item at every shift, by words as a regular expression finds them."""
    import re

    find = lambda t: re.findall(r"[0-9a-z\u0080-\U0010ffff]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    number = {}
    coded = lambda t: np.array([number.setdefault(x, len(number)) for x in find(t)], np.int64)
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    items = [(r["item_id"], coded(r["text"])) for r in bench.collect()]
    want = set()
    for r in docs.collect():
        w = coded(r["text"])
        for item, v in items:
            places = {}
            for i, x in enumerate(v.tolist()):
                places.setdefault(x, []).append(i)
            hits = [k - i for k, x in enumerate(w.tolist()) for i in places.get(x, ())]
            shifts, n = np.unique(hits, return_counts=True)
            for shift in shifts[n >= min(decontam.MIN_WORDS, 0.9 * len(v))].tolist():
                a, z = max(0, -shift), min(len(v), len(w) - shift)
                equal = v[a:z] == w[a + shift : z + shift]
                f, t = decontam.best(equal)
                k = int(equal[f:t].sum())
                if k >= min(decontam.MIN_WORDS, 0.9 * len(v)) and k >= decontam.MIN_SHARE * (t - f):
                    want.add((r["doc_id"], item, a + f + shift, a + t + shift, a + f, k))
    assert want and {tuple(r) for r in decontam.contaminated(docs, bench).collect()} == want


def test_decontamination_on_hard_and_empty_tables(spark, hard, none):
    bench = spark.createDataFrame([(1, "a b c d e"), (None, "word word word word word"), (3, None), (4, "the cat sat on the mat the cat sat on the mat")], "item_id long, text string")
    got = decontam.contaminated(hard, bench).select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in got} == {(4, 1), (5, 1), (6, 1), (None, 1), (7, None), (11, 4)}
    assert decontam.contaminated(none, bench).count() == decontam.clean(none, bench).count() == decontam.contaminated(hard, bench.limit(0)).count() == 0
    assert decontam.clean(hard, bench.limit(0)).count() == hard.count()


@pytest.mark.parametrize("n", range(1, 19))
def test_every_acceptable_pattern_of_replaced_words_is_found(n):
    idx = decontam.index([(0, " ".join(f"word{i}" for i in range(n)))])
    equal = np.array([[i not in gone for i in range(n)] for m in range(n // 2 + 1) for gone in itertools.combinations(range(n), m) if m <= 5])
    w = np.where(equal, idx["words"], np.arange(equal.size, dtype=np.uint64).reshape(equal.shape))
    got = {r[0] for r in decontam.overlaps(w.ravel(), np.arange(0, w.size + 1, n), idx)}
    want = set()
    for k, e in enumerate(equal):
        f, t = decontam.best(e)
        if e[f:t].sum() >= min(decontam.MIN_WORDS, 0.9 * n) and e[f:t].mean() >= decontam.MIN_SHARE:
            want.add(k)
    assert 0 in want and got == want


# --- 7 ---------------------------------------------------------------------------------------------------------------
def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "x" * 300
    rows = [(3, "http://a", big), (1, "http://b\r\nX: y", big), (2, None, "short"), (5, "u", "short"), (4, "u", None), (6, "u", ""), (7, "é", "é" * 60), (8, "é", "é" * 60), (None, "n", big), (1, "again", big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    folder = shared_dir(spark) + "/warc-test"
    index = warc.write_archives(pages, folder)
    back = warc.read_archives(index, folder).collect()
    assert len(back) == len(rows)
    by = {}
    for r in back:
        by.setdefault(r["page_id"], []).append(r)
    assert [r["record_type"] for r in by[1]] == ["response"] * 2 and by[3][0]["refers_to"] == 1 == by[None][0]["refers_to"] and by[8][0]["refers_to"] == 7
    assert by[2][0]["record_type"] == by[5][0]["record_type"] == "response" and by[4][0]["payload_bytes"] == 0
    assert by[1][0]["payload"] == big.encode() and by[3][0]["payload"] is None and by[3][0]["payload_bytes"] == len(big)
    assert warc.read_archives(index.filter("page_id = 7"), folder).collect()[0]["payload"] == ("é" * 60).encode()
    assert warc.write_archives(pages.limit(0), folder + "0").count() == 0


def test_warc_reader_rejects_what_was_changed():
    data = warc.record(1, "u", b"y" * 200, warc.hashlib.sha256(b"z" * 200).hexdigest(), None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse(data)


def test_warc_matches_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    df = warc.op7_warc_index_first(spark, SF)
    rel = con.execute(warc.OP7_SQL)
    at = [[c[0] for c in rel.description].index(c) for c in df.columns]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


# --- 8 ---------------------------------------------------------------------------------------------------------------
def packed_well(rows, max_len):
    by, docs = {}, {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        docs.setdefault(r["doc_id"], []).append(r)
    for s in by.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= max_len
    return by, docs


def test_packing(spark, hard, none):
    rows = packing.pack(hard, packing.tokenizer_path(), max_len=64).collect()
    _, docs = packed_well(rows, 64)
    coder = packing.WordIds(packing.tokenizer_path())
    assert {r["doc_id"]: r["text"] for r in hard.collect()}.keys() == docs.keys()
    for r in hard.filter("doc_id is not null").dropDuplicates(["doc_id"]).collect():
        ids = np.array([*coder.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        for p in docs[r["doc_id"]]:
            assert p["doc_tokens"] == len(ids) // 4 and p["ids_crc32"] == zlib.crc32(ids[4 * p["start"] : 4 * (p["start"] + p["length"])])
        assert sum({p["start"]: p["length"] for p in docs[r["doc_id"]]}.values()) == len(ids) // 4
    assert packing.pack(none, packing.tokenizer_path()).count() == 0


def test_packing_of_the_tables_has_little_padding(spark):
    by, _ = packed_well(packing.op8_histogram_packing(spark, "/root/testdata/sf0.01").collect(), 2048)
    assert sum(n for s in by.values() for _, n in s) / 2048 / len(by) > 0.98


@pytest.mark.parametrize("text", ["a\x1cb", "Σας ΟΔΟΣ. Σ'Σ", "<|endoftext|> x<|startoftext|>y", "é ́a b c\r\n\td", "", "it's we'll 'S 12³½ ४", "J̌ ǰ T̈", "İ ẞ", "a.b, c., d!, 'e,", "K.\nA, b"])
def test_words_have_the_tokenizers_ids(text):
    coder = packing.WordIds(packing.tokenizer_path())
    for _ in range(2):
        assert coder.encode([text])[0] == np.array(coder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_patterns_use_every_length_once():
    r = np.random.default_rng(1)
    for most in (1, 7, 64, 2048):
        h = {int(n): int(c) for n, c in zip(range(1, most + 1), r.integers(0, 50, most), strict=True)}
        total = dict.fromkeys(h, 0)
        for count, pattern in packing.patterns(h, most):
            assert sum(a * b for a, b in pattern) <= most
            for a, b in pattern:
                total[a] += count * b
        assert total == h


def test_patterns_are_those_of_placing_lengths_one_by_one():
    r = np.random.default_rng(2)
    for most in (5, 16, 64, 300):
        for _ in range(8):
            h = {int(n): int(c) for n, c in zip(range(1, most + 1), r.integers(0, r.choice([2, 5, 40]), most), strict=True)}
            packs = []
            for n in sorted((n for n, c in h.items() for _ in range(c)), reverse=True):
                k = min(range(len(packs)), key=packs.__getitem__, default=None)
                if k is None or packs[k] + n > most:
                    packs.append(n)
                else:
                    packs[k] += n
            assert sorted(packs) == sorted(sum(a * b for a, b in p) for c, p in packing.patterns(h, most) for _ in range(c))


# --- 9 ---------------------------------------------------------------------------------------------------------------
def test_page_checksum_is_the_containers():
    def slow(data):
        c = 0
        for x in data:
            c ^= x << 24
            for _ in range(8):
                c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        return c

    for s in (b"", b"a", bytes(range(256))):
        assert media.page_crc(s) == slow(s)


def test_ogg_round_trip_and_checks(spark, hard, none):
    r = random.Random(1)
    for n in (64, 255, 4000, 4064, 66_000):
        payload = r.randbytes(n)
        data = media.store(payload)
        back, marks, seconds, _ = media.load(data)
        assert back == payload and seconds == n / media.RATE and [m[0] for m in marks] == list(range(0, n, media.PACKET))
        broken = bytearray(data)
        broken[len(data) // 2] ^= 1
        with pytest.raises((ValueError, KeyError, StopIteration)):
            media.load(bytes(broken))
    long_ = media.demux(media.mux({5: [(b"h", 0), (b"z" * 100_000, 9)], 6: [(b"", 1), (b"q" * 255, 2)]}))
    assert [len(p[0]) for p in long_[5]] == [1, 100_000] and long_[6][1] == (b"q" * 255, 2, 2 / media.RATE)
    rows = media.media_features(hard).collect()
    assert len(rows) == hard.count() and all(x["payload_bytes"] % 64 == 0 and x["payload_bytes"] for x in rows)
    assert media.media_features(none).count() == 0


def test_media_columns_of_a_table(spark):
    """All columns against hashlib and zlib, the stored form read back anew, and equal values of equal texts."""
    import hashlib

    texts = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    seen = {}
    rows = media.op9_ogg_columns(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        payload = t + b"\0" * (-len(t) % 64 if t else 64)
        stored = media.store(payload)
        assert media.load(stored)[0] == payload
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        value = tuple(r[c] for c in rows[0].__fields__ if c != "doc_id")
        assert seen.setdefault(t, value) == value


# --- 10 --------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000, 4097])
def test_permutation_is_a_bijection(n):
    p = sharding.permute(np.arange(n), n, 3)
    assert sorted(p.tolist()) == list(range(n)) and (sharding.permute(p, n, 3, inverse=True) == np.arange(n)).all()


def test_sharding(spark, hard, none):
    rows = sharding.shard(hard, "doc_id", 5, ("text",)).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == hard.count() and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert sharding.shard(none, "doc_id", 5).count() == 0


def test_sharding_keeps_columns_of_any_name(spark):
    names = ["row_number", "__part", "__at", "__AT_", "__first", "__spread", "__number"]
    df = spark.range(20).select(F.col("id").alias("doc_id"), *[(F.col("id") * (i + 2)).alias(c) for i, c in enumerate(names)], F.lit(-1).alias("Shard"))
    got = sharding.shard(df, "doc_id", 3)
    assert got.columns == ["doc_id", *names, "shard", "slot"] and {(r["shard"], r["slot"]) for r in got.collect()} == {(p % 3, p // 3) for p in range(20)}
    assert all(r[c] == r["doc_id"] * (i + 2) for r in got.collect() for i, c in enumerate(names))
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = sharding.op10_feistel_sharding(spark, SF).collect()
    assert {(r["doc_id"], r["size"], r["text_crc32"], r["law"], r["grown_shard"]) for r in held} == {(i, len(t) + 16, zlib.crc32(t), "rows", None) for i, t in docs.items()}
    for n, i in enumerate(sorted(docs)):  # the place of any row can be computed by itself
        p = int(sharding.permute(np.array([n]), len(docs))[0])
        assert [(r["shard"], r["slot"]) for r in held if r["doc_id"] == i] == [(p % 40, p // 40)]
    a, b = (sorted(map(tuple, sharding.op10_feistel_sharding(spark, SF).drop("grown_shard").collect())) for _ in range(2))
    assert a == b
