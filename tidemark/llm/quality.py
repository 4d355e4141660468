"""Quality scores by regularised quadratic discriminant analysis over transformed document statistics.

Statistics of each whole text (size, words, shares of character classes, repetition of words and lines, entropy) are
transformed (logarithms of sizes, square roots of shares) and written once. Class means and covariances come from sums
over all labelled training rows, added up on the executors. Each covariance is shrunk towards the pooled one and
towards a multiple of the identity; its Cholesky factor is computed once and its inverse kept, so that a score is two
Mahalanobis distances. score = sigmoid(log-density difference / number of statistics); 0.5 is the Bayes boundary for
equal priors.

Defined results: null and empty texts have the statistics of an empty text; null labels are not learned; where a class
has no training row every score is the share of the other; repeated rows are scored each, and repeated labels count
each; a null id has no label; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_rows, held_out, steps, table, utf8, written
from ._words import NOT_BLANK, words

SHRINK_POOLED, SHRINK_IDENTITY = 0.2, 0.02

_CLASSES = np.zeros((256, 8), np.int64)
_CLASSES[65:91, 0] = 1  # upper case
_CLASSES[97:123, 1] = 1  # lower case
_CLASSES[48:58, 2] = 1  # digits
_CLASSES[[9, 11, 12, 13, 32], 3] = 1  # blanks
_CLASSES[10, 4] = 1  # line feeds
_CLASSES[[ord(c) for c in ".,;:?'\"-()"], 5] = 1  # punctuation of prose
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:?'\"-()"], 6] = 1  # other symbols
_CLASSES[128:, 7] = 1  # beyond ASCII
NAMES = ("size", "words", "word_length", "upper", "lower", "digits", "blanks", "lines", "punctuation", "symbols", "beyond", "distinct_words", "distinct_lines", "entropy")
D = len(NAMES)


def _distinct(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    n = np.diff(off)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((h, doc))
    a, d = h[order], doc[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[new], minlength=len(n))


_LINE = np.ones(256, bool)
_LINE[10] = False


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of D transformed statistics for each text."""
    n = np.diff(off)
    k = len(n)
    levels = np.array([np.bincount(raw[a:b], minlength=256) for a, b in zip(off[:-1], off[1:], strict=True)]).reshape(k, 256)
    share = (levels @ _CLASSES) / np.maximum(n, 1)[:, None]
    w, w_off = words(raw, off, NOT_BLANK)
    n_words = np.diff(w_off)
    lines, l_off = words(raw, off, _LINE)
    p = levels / np.maximum(n, 1)[:, None]
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    blank = levels[:, [9, 10, 11, 12, 13, 32]].sum(1)
    return np.column_stack(
        [
            np.log1p(n),
            np.log1p(n_words),
            np.log1p((n - blank) / np.maximum(n_words, 1)),
            np.sqrt(share),
            np.sqrt(_distinct(w, w_off) / np.maximum(n_words, 1)),
            np.sqrt(_distinct(lines, l_off) / np.maximum(np.diff(l_off), 1)),
            entropy,
        ]
    )


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x), x being the statistics as 64-bit floats."""

    def work(batches):
        for b in batches:
            raw, off = utf8(b.column(1))
            for a, z in steps(off):
                x = statistics(raw[off[a] : off[z]], off[a : z + 1] - off[a])
                yield pa.RecordBatch.from_arrays([b.column(0)[a:z], pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "x"])

    batch_rows(docs.sparkSession)
    return written(docs.select("doc_id", "text").mapInArrow(work, "doc_id long, x binary"), "statistics")


def fit(x: DataFrame, labels: DataFrame) -> dict:
    """Means, inverse Cholesky factors and log determinants of the two classes."""
    rows = x.filter(~held_out()).join(labels.filter(F.col("quality").isin(0, 1)).select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")

    def sums(batches):
        total = np.zeros((2, 1 + D + D * D))
        for b in batches:
            v = np.array([np.frombuffer(r, np.float64) for r in b.column(0).to_pylist()]).reshape(-1, D)
            q = b.column(1).to_numpy()
            for c in (0, 1):
                y = v[q == c]
                total[c] += np.r_[len(y), y.sum(0), (y.T @ y).ravel()]
        c, i = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(c), pa.array(i), pa.array(total.ravel())], names=["c", "i", "s"])

    got = rows.select("x", "quality").mapInArrow(sums, "c long, i long, s double").groupBy("c", "i").agg(F.sum("s").alias("s")).collect()  # 2 * (1 + D + D * D) rows
    total = np.zeros((2, 1 + D + D * D))
    for r in got:
        total[r["c"], r["i"]] = r["s"]
    n = total[:, 0]
    if not n.all():
        return {"constant": float(n[1] / n.sum()) if n.sum() else 0.5}
    mean = total[:, 1 : 1 + D] / n[:, None]
    cov = (total[:, 1 + D :] / n[:, None]).reshape(2, D, D) - mean[:, :, None] * mean[:, None, :]
    pooled = (cov * n[:, None, None]).sum(0) / n.sum()
    scale = np.sqrt(np.diag(pooled) + np.diag(np.cov(mean.T, bias=True)) + 1e-9)
    mean, cov, pooled = mean / scale, cov / np.outer(scale, scale), pooled / np.outer(scale, scale)
    inverse, logdet = [], []
    for c in (0, 1):
        s = (1 - SHRINK_POOLED) * cov[c] + SHRINK_POOLED * pooled
        s = (1 - SHRINK_IDENTITY) * s + SHRINK_IDENTITY * max(np.trace(s) / D, 1e-3) * np.eye(D)
        factor = np.linalg.cholesky(s)
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * np.log(np.diag(factor)).sum())
    return {"scale": scale, "mean": mean, "inverse": inverse, "logdet": logdet}


def scored(x: DataFrame, model: dict) -> DataFrame:
    def work(batches):
        for b in batches:
            v = np.array([np.frombuffer(r, np.float64) for r in b.column(1).to_pylist()]).reshape(-1, D)
            if "constant" in model:
                s = np.full(len(v), model["constant"])
            else:
                v = v / model["scale"]
                dens = [-0.5 * (((v - model["mean"][c]) @ model["inverse"][c].T) ** 2).sum(1) - 0.5 * model["logdet"][c] for c in (0, 1)]
                s = 1 / (1 + np.exp(-np.clip((dens[1] - dens[0]) / D, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return x.mapInArrow(work, "doc_id long, score double, predicted int")


def op2_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = measured(table(spark, sf_dir, "documents"))
    return scored(x, fit(x, table(spark, sf_dir, "labels"))).select("doc_id", held_out().alias("held_out"), "score", "predicted")
