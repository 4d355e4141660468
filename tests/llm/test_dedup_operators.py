import collections
import hashlib
import random
import re

import numpy as np
import pytest

from tidemark.llm import _suffix, jaccard, substrings

SF = "/root/testdata/sf0.001"


# --- suffix arrays ---------------------------------------------------------------------------------------------------
def test_suffix_array_against_sorting():
    r = np.random.default_rng(0)
    for _ in range(600):
        x = r.integers(0, int(r.integers(1, 5)), int(r.integers(0, 40)))
        assert _suffix.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())
    for x in (np.zeros(300, int), np.tile([1, 0], 200), np.tile([0, 1, 0, 0, 1], 50), np.arange(100)[::-1]):
        assert _suffix.suffix_array(x).tolist() == sorted(range(len(x)), key=lambda i: x[i:].tolist())


# --- 3 ---------------------------------------------------------------------------------------------------------------
def sets(rows):
    low = lambda s: re.sub("[A-Z]+", lambda m: m[0].lower(), s)
    out = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t or ""))
        out.append((i, frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])))
    return out


def brute_components(rows):
    s = sets(rows)
    by = collections.defaultdict(list)
    for i, x in s:
        by[x].append(i)
    keys = [x for x in by if x]
    up = {x: x for x in keys}

    def top(x):
        while up[x] is not x:
            x = up[x]
        return x

    for a in range(len(keys)):
        for b in range(a):
            x, y = keys[a], keys[b]
            if 4 * min(len(x), len(y)) >= 3 * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= 75 * (len(x) + len(y) - n):
                    p, q = top(x), top(y)
                    if p is not q:
                        up[p] = q
    least = {}
    for x in keys:
        t = top(x)
        least[t] = min([least.get(t, 10**9), *(i for i in by[x] if i is not None)])
    return sorted(((i, len(x), least[top(x)] if x else i) for i, x in s), key=str)


def families(seed):
    """Groups of near copies around the threshold, copies, a passage that most texts share, and short texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(12):
        base = [word() for _ in range(r.choice([4, 5, 6, 9, 20, 60, 150, 400]))]
        for _ in range(r.choice([1, 2, 6, 30])):
            w = list(base)
            for _ in range(int(len(w) * r.choice([0, 0, 0.01, 0.02, 0.05]))):
                w[r.randrange(len(w))] = word()
            if r.random() < 0.4:
                w = w + passage
            rows.append(" ".join(w).upper() if r.random() < 0.1 else "  ".join(w))
    return list(enumerate(rows))


@pytest.mark.parametrize("hot", [(16, 16), (2, 1)])
def test_jaccard_join_against_brute_force(spark, monkeypatch, hot):
    """Also with limits so low that nearly everything takes the way of large groups."""
    monkeypatch.setattr(jaccard, "HOT", hot[0])
    monkeypatch.setattr(jaccard, "HOT_IN_TASK", hot[1])
    rows = families(hot[0])
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("name", "part").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_jaccard_join_tells_texts_of_one_id_apart(spark):
    """Also where texts without a doc_id have near copies."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(5))
    a, b, c = ([word() for _ in range(60)] for _ in range(3))
    text = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows = [(5, text(a, 0)), (5, text(b, 0)), (7, text(a, 59)), (8, text(b, 59)), (None, text(a, 1)), (None, text(c, 0)), (None, text(c, 59)), (9, text(c, 1))]
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    names = {hashlib.md5(t.encode()).hexdigest(): k for k, (_, t) in enumerate(rows)}
    assert {names[r["name"]]: r["component_id"] for r in got} == {0: 5, 1: 5, 2: 5, 3: 5, 4: 5, 5: 9, 6: 9, 7: 9}
    alone = jaccard.jaccard_join(spark.createDataFrame(rows[5:7], "doc_id long, text string")).collect()
    assert [r["component_id"] for r in alone] == [None, None]


def test_jaccard_join_of_large_groups_stays_small(spark, monkeypatch):
    """Texts that share a passage but are not linked, and a large group of near copies: whole results, and no more pairs than a few a text."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    passage, base = [word() for _ in range(60)], [word() for _ in range(80)]
    rows = [" ".join(passage + [word() for _ in range(r.randrange(15, 60))]) for _ in range(700)]
    for _ in range(700):
        w = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            w[r.randrange(len(w))] = word()
        rows.append(" ".join(w))
    rows, told = list(enumerate(rows)), []
    near = jaccard.near

    def counted(pairs, nodes):
        told.append(pairs.count())
        return near(pairs, nodes)

    monkeypatch.setattr(jaccard, "near", counted)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).drop("name", "part").collect()
    assert sorted(map(tuple, got), key=str) == brute_components(rows)
    assert sum(told) < 30 * len(rows)


def test_jaccard_join_on_hard_cases(spark, hard, none):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    got = jaccard.jaccard_join(hard).drop("name", "part").collect()
    want = brute_components([x for x in rows if x[0] is not None])
    assert sorted((tuple(r) for r in got if r["doc_id"] is not None), key=str) == want
    assert sum(r["doc_id"] is None for r in got) == 2 and jaccard.jaccard_join(none).count() == 0


def test_sketches_bound_the_difference():
    r = np.random.default_rng(0)
    for n in (1, 5, 80, 3000):
        a = np.unique(r.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[n // 10 :], r.integers(0, 2**63, n // 8 + 1).astype(np.uint64)])
        assert jaccard.hamming(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_pigeonhole_holds_in_every_band():
    for a in range(1, 400):
        for b in range(a, 4 * a // 3 + 1):
            j = int(np.searchsorted(jaccard.bands(), a, side="right")) - 1
            assert jaccard.most_apart(a, b) <= jaccard.scheme(j)[0] < jaccard.scheme(j)[1]


# --- 5 ---------------------------------------------------------------------------------------------------------------
def brute_cut(rows):
    texts = [(2**63 - 1 if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in texts:
        for k in range(len(b) - 49):
            w = b[k : k + 50]
            first[w] = min(first.get(w, i), i)
    out = []
    for (i, _), (n, b) in zip(rows, texts, strict=True):
        c = np.zeros(len(b), bool)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < n:
                c[k : k + 50] = True
        runs = int((np.diff(np.r_[0, c.astype(int)]) == 1).sum())
        out.append((i, len(b), int(c.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~c].tobytes()).hexdigest()))
    return sorted(out, key=str)


def columns(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


@pytest.mark.parametrize("hot", [255, 2])
def test_substring_dedup_against_brute_force(spark, monkeypatch, hot):
    """Also with every shared anchor split, and with several stretches."""
    monkeypatch.setattr(substrings, "HOT", hot)
    monkeypatch.setattr(substrings, "STRETCH_BYTES", 1 << 12)
    r = random.Random(hot)
    text = lambda n: "".join(r.choice("abcdé ") for _ in range(n))
    shared = [text(n) for n in (49, 50, 51, 120, 700)] + ["ab" * 60, "z" * 90]
    rows = [(i, "".join(r.choice([text(r.choice([0, 3, 40])), r.choice(shared)]) for _ in range(r.randrange(6)))) for i in range(80)]
    rows += [(200 + i, t) for i, (_, t) in enumerate(rows[:10])]
    assert columns(substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))) == brute_cut(rows)


def test_substring_dedup_on_hard_cases(spark, hard, none):
    rows = [(r["doc_id"], r["text"]) for r in hard.collect()]
    assert columns(substrings.dedup(hard)) == brute_cut(rows)
    assert substrings.dedup(none).count() == 0


def test_substring_dedup_of_the_table(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert columns(substrings.op5_suffix_groups(spark, SF)) == brute_cut(rows)


def test_window_hashes_tell_strings_apart():
    x = np.random.default_rng(0).integers(0, 3, 500).astype(np.uint8)
    for n in (1, 2, 7, 24, 50):
        h, seen = substrings.window_hashes(x, n), {}
        assert len(h) == len(x) - n + 1 and all(seen.setdefault(x[i : i + n].tobytes(), h[i]) == h[i] for i in range(len(h)))
        assert len(set(seen.values())) == len(seen)
