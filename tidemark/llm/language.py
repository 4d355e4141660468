"""Language identification by the nearest of several centroids per language.

A text is a normalised TF-IDF vector over hashed byte n-grams (one to three bytes of the lower-cased text's words, `DIMS`
buckets). The vectors of each language's training texts are clustered by spherical k-means; a text gets the language
of the centroid with the greatest cosine. A text that is farther from that centroid than `REJECT` times the reach
of the training texts assigned to it, or that has no letter, is rejected. A centroid's reach is the cosine that all but
a twentieth of its texts have; centroids of less than a fiftieth of a language's texts, i.e. its outliers, are dropped
unless the language has no other. Texts of fewer than `SURE_BYTES` bytes have few n-grams and so lower cosines with any
centroid; what is asked of them is less in proportion to the square root of their bytes.

The classifier is fitted on a bounded sample of about `SAMPLE_DOCS` distinct labelled texts, dealt evenly over the
languages by a hash of the text; idf and centroids come from that sample, so that what reaches the driver is bounded.

Defined results: null text, empty text and text without a letter are `und` with score 0 and rejected; null labels
are not learned; with no labelled row at all every text is `und`; a null id is in the training fold; repeated rows
are scored each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_rows, held_out, lean, mix64, release, table

DIMS = 4096
SAMPLE_DOCS = 2000
CENTROIDS = 4
REJECT = 0.3
SURE_BYTES = 400
#: Texts a dense step handles at a time.
STEP_DOCS = 128
LETTER = regex.compile(r"\p{L}")
#: All ASCII but letters counts as a blank, so that marks and digits do not tell languages apart.
_BLANKED = np.arange(256, dtype=np.uint8)
_BLANKED[[c for c in range(128) if not chr(c).isalpha()]] = 32
_TRI = mix64(np.arange(3 * 256, dtype=np.uint64)).reshape(3, 256)


def counts(texts: list[str]) -> np.ndarray:
    """Dense n-gram counts, a row for each text."""
    out = np.zeros((len(texts), DIMS), np.float32)
    for i, t in enumerate(texts):
        x = _BLANKED[np.frombuffer(t.encode(), np.uint8)]
        x = x[(x != 32) | (np.append(np.uint8(0), x[:-1])[: len(x)] != 32)]  # one blank between words, whatever stood there
        for a in range(0, len(x), 1 << 20):
            y = x[a : a + (1 << 20) + 2]
            own = min(len(x) - a, 1 << 20)
            h = np.zeros(len(y), np.uint64)
            for k in range(3):
                if len(y) <= k:
                    break
                h = h[: len(y) - k] * np.uint64(31) + _TRI[k][y[k:]]
                out[i] += np.bincount(((h[:own] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64), minlength=DIMS)
    return out


def vectors(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(raw) * idf
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def clustered(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """Centroids of spherical k-means, begun with the texts farthest from those chosen so far."""
    chosen = [x.mean(0)]
    while len(chosen) < min(k, len(x)):
        far = np.max(x @ np.array(chosen).T, axis=1)
        if far.min() > 1 - 1e-6:
            break
        chosen.append(x[int(np.argmin(far))])
    c = np.array(chosen)
    for _ in range(rounds):
        near = np.argmax(x @ c.T, axis=1)
        c = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.sqrt((c * c).sum(1, keepdims=True)), 1e-12)
    return c


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, centroids: int = CENTROIDS) -> dict | None:
    """idf, centroids, the language of each, and the least cosine accepted by each."""
    model = _learned(docs, sample_docs, centroids)
    release()
    return model


def _learned(docs: DataFrame, sample_docs: int, centroids: int) -> dict | None:
    rows = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    per = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each label
    if not per:
        return None
    share = F.lit(0.0)
    for lang, n in sorted(per.items()):
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_docs / len(per) / n))).otherwise(share)
    part = rows.filter(F.pmod(F.xxhash64("text", F.lit(6)), F.lit(1 << 20)) < share * (1 << 20)).select("lang", "text").distinct()

    def vec(batches):
        for b in batches:
            for a in range(0, b.num_rows, STEP_DOCS):
                c = counts([t.lower() for t in b.column(1)[a : a + STEP_DOCS].to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0)[a : a + STEP_DOCS], pa.array([x.tobytes() for x in c], pa.binary())], names=["lang", "c"])

    got = part.mapInArrow(lean(vec), "lang string, c binary").toArrow().sort_by([("lang", "ascending"), ("c", "ascending")])
    langs = np.array(got["lang"].to_pylist())
    if not len(langs):
        return None
    raw = np.array([np.frombuffer(x, np.float32) for x in got["c"].to_pylist()])
    idf = (np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))) + 1).astype(np.float32)
    x = vectors(raw, idf)
    cents, names, least = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        c = clustered(own, centroids)
        cos = own @ c.T
        near = np.argmax(cos, axis=1)
        size = np.bincount(near, minlength=len(c))
        for j in np.flatnonzero(size >= min(size.max(), max(2, len(own) / 50))):
            cents.append(c[j])
            names.append(str(lang))
            least.append(REJECT * float(np.quantile(cos[near == j, j], 0.05)))
    return {"idf": idf, "centroids": np.array(cents, np.float32), "names": names, "least": np.array(least)}


def judged(texts: list, m: dict | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, cosine and rejection of each text."""
    low = [t.lower() if t else "" for t in texts]
    at = np.flatnonzero([LETTER.search(t) is not None for t in low])
    names, score, reject = ["und"] * len(low), np.zeros(len(low)), np.ones(len(low), bool)
    if m is not None and len(at):
        cos = vectors(counts([low[i] for i in at]), m["idf"]) @ m["centroids"].T
        best = np.argmax(cos, axis=1)
        top = cos[np.arange(len(at)), best]
        for i, j in zip(at, best, strict=True):
            names[i] = m["names"][j]
        share = np.sqrt(np.minimum(1, np.array([len(low[i].encode()) for i in at]) / SURE_BYTES))
        score[at], reject[at] = np.clip(top, 0, 1), top < m["least"][best] * share
    return names, score, reject


def identify(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs' doc_id with lang_pred, score (the cosine) and rejected."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)  # DIMS floats for each of CENTROIDS times the number of languages

    def work(batches):
        for b in batches:
            for a in range(0, b.num_rows, STEP_DOCS):
                names, score, reject = judged(b.column(1)[a : a + STEP_DOCS].to_pylist(), held.value)
                yield pa.RecordBatch.from_arrays([b.column(0)[a : a + STEP_DOCS], pa.array(names, pa.string()), pa.array(score), pa.array(reject)], names=["doc_id", "lang_pred", "score", "rejected"])

    batch_rows(spark)
    return docs.select("doc_id", "text").mapInArrow(lean(work), "doc_id long, lang_pred string, score double, rejected boolean")


def accepted(docs: DataFrame, model: dict | None) -> DataFrame:
    """The rows of docs whose text is not rejected."""
    spark = docs.sparkSession
    held, at = spark.sparkContext.broadcast(model), docs.columns.index("text")

    def work(batches):
        for b in batches:
            for a in range(0, b.num_rows, STEP_DOCS):
                part = b.slice(a, STEP_DOCS)
                yield part.filter(pa.array(~judged(part.column(at).to_pylist(), held.value)[2]))

    batch_rows(spark)
    return docs.mapInArrow(lean(work), docs.schema)


def op6_nearest_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
