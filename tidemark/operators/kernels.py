"""Numeric kernels over signals, windows and cohorts: eigenstructure with loadings and intervals, signal geometry, persistence, stability, fleet baseline, trajectories.

Each runs on one group of bounded size: the signals of a window, the windows of a cohort, or a segment of a signal.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z = {0.90: 1.645, 0.95: 1.96, 0.99: 2.576}


# --- eigenstructure ------------------------------------------------------------------------------------------------
def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Columns that are finite and vary, as z-scores with the population's deviation, and which these are."""
    finite = np.isfinite(x).all(0)
    dev = np.where(finite, x.std(0, where=np.isfinite(x)) if len(x) else 0, 0)
    keep = np.flatnonzero(finite & (dev > 1e-15))
    return (x[:, keep] - x[:, keep].mean(0)) / dev[keep], keep


def decomposed(x: np.ndarray) -> dict | None:
    """Descending eigenvalues and vectors of the covariance of z-scores, and what follows; None for fewer than two rows or varying columns."""
    z, keep = scaled(x)
    if len(z) < 2 or len(keep) < 2:
        return None
    v, e = np.linalg.eigh(np.cov(z.T))
    v, e = np.maximum(v[::-1], 0), e[:, ::-1]
    t = v.sum()
    p = v / t
    p = p[p > 1e-15]
    bits = float(-(p * np.log2(p)).sum())
    live = v[v > v[0] * 1e-10]
    return {
        "eigenvalues": v, "vectors": e, "columns": keep, "z": z, "total_variance": float(t), "effective_dim": float(t * t / (v @ v)), "effective_dim_entropy": float(2**bits), "eigenvalue_entropy": bits,
        "eigenvalue_entropy_normalized": bits / np.log2(len(v)), "condition_number": float(v[0] / live[-1]), "ratio_2_1": float(v[1] / v[0]), "ratio_3_1": float(v[2] / v[0]) if len(v) > 2 else np.nan,
        "energy_concentration": float((v[:1].sum()) / t),
    }


def jackknife(x: np.ndarray, level: float = 0.95) -> tuple[float, float, float]:
    """Effective dimension with its leave-one-signal-out interval; NaN bounds for fewer than four signals."""
    whole = decomposed(x)
    if whole is None:
        return np.nan, np.nan, np.nan
    if len(x) < 4:
        return whole["effective_dim"], np.nan, np.nan
    parts = [d["effective_dim"] for i in range(len(x)) if (d := decomposed(np.delete(x, i, 0))) is not None]
    n = len(parts)
    se = float(np.sqrt((n - 1) / n * ((np.array(parts) - np.mean(parts)) ** 2).sum())) if n > 1 else np.nan
    return whole["effective_dim"], whole["effective_dim"] - Z[level] * se, whole["effective_dim"] + Z[level] * se


_SCALARS = "total_variance effective_dim effective_dim_entropy eigenvalue_entropy eigenvalue_entropy_normalized condition_number ratio_2_1 ratio_3_1 energy_concentration".split()
EIGEN = "cohort string, window_index long, n_signals long, " + ", ".join(f"{c} double" for c in _SCALARS) + ", eff_dim_ci_low double, eff_dim_ci_high double, eigenvalues array<double>, columns array<string>, loadings array<array<double>>"


def eigendecomposition(vectors: DataFrame, features: list[str], components: int = 3) -> DataFrame:
    """EIGEN rows by (cohort, window): loadings are of the first components over `columns`, the features that count. Windows without two signals and two varying features give no row."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("signal_id")[features].to_numpy(float)
        d = decomposed(x)
        names = [c.split()[0] for c in EIGEN.split(", ")]
        if d is None:
            return pd.DataFrame([], columns=names)
        _, low, high = jackknife(x)
        row = [pdf["cohort"].iloc[0], int(pdf["window_index"].iloc[0]), len(x), *(d[c] for c in _SCALARS), low, high, d["eigenvalues"].tolist(), [features[i] for i in d["columns"]], d["vectors"][:, :components].T.tolist()]
        return pd.DataFrame([row], columns=names)

    return vectors.select("cohort", "signal_id", "window_index", *features).groupBy("cohort", "window_index").applyInPandas(work, EIGEN)


def continuous(eigen: DataFrame) -> DataFrame:
    """EIGEN rows whose loadings have the signs that agree with the window before; features that one of the windows lacks do not count."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, before = pdf.sort_values("window_index"), None
        out = []
        for columns, loadings in zip(pdf["columns"], pdf["loadings"], strict=True):
            now = {c: np.array([row[i] for row in loadings]) for i, c in enumerate(columns)}
            if before is not None:
                common = [c for c in now if c in before]
                k = min(len(loadings), len(next(iter(before.values()), [])))
                sign = np.ones(len(loadings))
                for j in range(k):
                    sign[j] = -1.0 if sum(now[c][j] * before[c][j] for c in common) < 0 else 1.0
                now = {c: v * sign for c, v in now.items()}
            before = now
            out.append([[float(now[c][j]) for c in columns] for j in range(len(loadings))])
        return pdf.assign(loadings=out)

    return eigen.groupBy("cohort").applyInPandas(work, EIGEN)


GEOMETRY = "cohort string, window_index long, signal_id string, distance double, coherence double, contribution double, residual double, magnitude double, pc0 double, pc1 double, pc2 double"


def signal_geometry(vectors: DataFrame, features: list[str]) -> DataFrame:
    """Each signal against its window's centroid: distance, cosine with the first component, its projection, what the component leaves, size, and projections on three components."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("signal_id")
        names = [c.split()[0] for c in GEOMETRY.split(", ")]
        d = decomposed(pdf[features].to_numpy(float))
        if d is None:
            return pd.DataFrame([], columns=names)
        z = d["z"]
        proj = np.pad(z @ d["vectors"][:, :3], ((0, 0), (0, max(0, 3 - d["vectors"].shape[1]))), constant_values=np.nan)
        size = np.sqrt((z * z).sum(1))
        rest = np.sqrt(np.maximum(size**2 - proj[:, 0] ** 2, 0))
        return pd.DataFrame({"cohort": pdf["cohort"], "window_index": pdf["window_index"], "signal_id": pdf["signal_id"], "distance": size, "coherence": proj[:, 0] / np.where(size > 0, size, np.nan), "contribution": proj[:, 0], "residual": rest, "magnitude": np.sqrt((pdf[features].to_numpy(float)[:, d["columns"]] ** 2).sum(1)), "pc0": proj[:, 0], "pc1": proj[:, 1], "pc2": proj[:, 2]})

    return vectors.select("cohort", "signal_id", "window_index", *features).groupBy("cohort", "window_index").applyInPandas(work, GEOMETRY)


def co_loading(eigen: DataFrame, least: float = 0.3) -> DataFrame:
    """Pairs of features that load by more than `least` on the same of the kept components, and on which."""
    each = eigen.select("cohort", "window_index", "columns", F.posexplode("loadings").alias("component", "loading"))
    each = each.select("cohort", "window_index", "component", F.explode(F.arrays_zip("columns", "loading")).alias("x")).select("cohort", "window_index", "component", F.col("x.columns").alias("feature"), F.col("x.loading").alias("loading")).filter(F.abs("loading") > least)
    b = each.withColumnRenamed("feature", "feature_b").withColumnRenamed("loading", "loading_b")
    both = each.join(b, ["cohort", "window_index", "component"]).filter("feature < feature_b")
    return both.groupBy("cohort", "window_index", F.col("feature").alias("feature_a"), "feature_b").agg(F.sort_array(F.collect_set("component")).alias("components"), F.lit(True).alias("needs_granger"))


def central(df: DataFrame, keys: list[str], order: str, measures: list[str], smooth: int = 1) -> DataFrame:
    """First to third central differences and curvature of each measure along an order (one-sided at the ends), after a centred mean over `smooth` rows."""
    w = W.partitionBy(*keys).orderBy(order)
    half = smooth // 2

    def step(c):
        before, after = F.lag(c).over(w), F.lead(c).over(w)
        return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)

    for m in measures:
        base = f"__{m}"
        df = df.withColumn(base, F.avg(m).over(w.rowsBetween(-half, half)) if smooth > 1 else F.col(m).cast("double"))
        df = df.withColumn(f"{m}_velocity", step(base))
        df = df.withColumn(f"{m}_acceleration", step(f"{m}_velocity"))
        df = df.withColumn(f"{m}_jerk", step(f"{m}_acceleration"))
        df = df.withColumn(f"{m}_curvature", F.abs(f"{m}_acceleration") / F.pow(1 + F.col(f"{m}_velocity") ** 2, 1.5)).drop(base)
    return df


def collapse(df: DataFrame, keys: list[str], order: str, velocity: str, below: float = -0.05, run: int = 3, share: float = 0.3) -> DataFrame:
    """By group: the share of rows whose velocity is below the limit, the start of the first run of `run` such rows, and whether either tells a collapse."""
    w = W.partitionBy(*keys).orderBy(order)
    low = F.coalesce(F.col(velocity) < below, F.lit(False))
    x = df.withColumn("__low", low).withColumn("__run", F.sum(F.when(F.col("__low"), 0).otherwise(1)).over(w))
    runs = x.filter("__low").groupBy(*keys, "__run").agg(F.min(order).alias("start"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= run).groupBy(*keys).agg(F.min("start").alias("onset"))
    all_ = x.groupBy(*keys).agg(F.avg(F.col("__low").cast("int")).alias("share_below"))
    return all_.join(runs, keys, "left").withColumn("collapsing", (F.col("share_below") >= share) | F.col("onset").isNotNull())


def brittleness(eigen: DataFrame) -> DataFrame:
    """Condition number by concentration over temperature (variance by effective dimension), and its rank in the cohort."""
    t = F.when((F.col("effective_dim") > 0) & (F.col("total_variance") > 0), F.col("total_variance") / F.col("effective_dim"))
    rows = eigen.withColumn("effective_temperature", t).withColumn("brittleness", F.try_divide(F.col("condition_number") * F.coalesce("energy_concentration", F.lit(1.0)), "effective_temperature"))
    return rows.select("cohort", "window_index", "condition_number", "energy_concentration", "effective_temperature", "brittleness", F.rank().over(W.partitionBy("cohort").orderBy(F.col("brittleness").desc_nulls_last())).alias("brittleness_rank"))


# --- signals ---------------------------------------------------------------------------------------------------------
STABILITY = "cohort string, signal_id string, segment long, window_end long, amplitude_mean double, amplitude_std double, amplitude_cv double, frequency_mean double, frequency_std double, energy double, rms double, stability double"


def rolling_stability(obs: DataFrame, window: int = 64, stride: int = 32, segment: int = 4096) -> DataFrame:
    """Amplitude and frequency of the analytic signal over windows of a signal, by segments of bounded length; a window needs half of its values."""
    place = F.row_number().over(W.partitionBy("cohort", "signal_id").orderBy("s0")) - 1
    rows = obs.withColumn("k", place).withColumn("segment", F.floor(F.col("k") / segment).cast("long"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("k"), []
        y, k = pdf["value"].to_numpy(float), pdf["k"].to_numpy()
        for end in range(window, len(y) + 1, stride):
            x = y[end - window : end]
            ok = np.isfinite(x)
            if ok.sum() < window / 2:
                continue
            x = np.interp(np.arange(window), np.flatnonzero(ok), x[ok])
            spectrum = np.fft.fft(x - x.mean())
            step = np.zeros(window)
            step[0] = step[window // 2] = 1
            step[1 : window // 2] = 2
            z = np.fft.ifft(spectrum * step)
            amp, freq = np.abs(z), np.diff(np.unwrap(np.angle(z))) / (2 * np.pi)
            cv = amp.std() / amp.mean() if amp.mean() > 0 else np.nan
            out.append([pdf["cohort"].iloc[0], pdf["signal_id"].iloc[0], int(pdf["segment"].iloc[0]), int(k[end - 1]), amp.mean(), amp.std(), cv, freq.mean(), freq.std(), float((x * x).sum()), float(np.sqrt((x * x).mean())), 1 / (1 + cv)])
        return pd.DataFrame(out, columns=[c.split()[0] for c in STABILITY.split(", ")])

    return rows.groupBy("cohort", "signal_id", "segment").applyInPandas(work, STABILITY)


def stable_baseline(y: np.ndarray, share: float = 0.2, stride: float = 0.05) -> tuple[int, int]:
    """[from, to) of the window of `share` of the values that varies least; the first of equal ones."""
    n = max(2, int(len(y) * share))
    best, at = -1.0, 0
    for a in range(0, max(1, len(y) - n + 1), max(1, int(len(y) * stride))):
        score = 1 / (np.nanstd(y[a : a + n]) + 1e-12)
        if score > best:
            best, at = score, a
    return at, at + n


REAL_TIME = "cohort string, s0 double, centroid_distance double, pc1 double, pc2 double, mahalanobis double"


def real_time_geometry(wide: DataFrame, sensors: list[str], least: int = 10) -> DataFrame:
    """Each place of a cohort against the cohort's own stable baseline: distance in z-scores, two projections, and the distance weighted by the first five components' variances."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("s0")
        x = pdf[sensors].ffill().bfill().to_numpy(float)
        a, z = stable_baseline(np.nanmean((x - np.nanmean(x, 0)) / np.where(np.nanstd(x, 0) > 0, np.nanstd(x, 0), 1), axis=1)) if len(x) >= least else (0, len(x))
        base = x[a:z]
        dev = base.std(0)
        keep = dev > 1e-12
        names = [c.split()[0] for c in REAL_TIME.split(", ")]
        if not keep.any() or len(base) < 2:
            return pd.DataFrame({"cohort": pdf["cohort"], "s0": pdf["s0"]}).reindex(columns=names)
        q = (x[:, keep] - base[:, keep].mean(0)) / dev[keep]
        _, s, vt = np.linalg.svd(q[a:z], full_matrices=False)
        p = q @ vt.T
        var = s**2 / max(1, len(base) - 1)
        k = min(5, int((var > 1e-12).sum()))
        return pd.DataFrame({"cohort": pdf["cohort"].to_numpy(), "s0": pdf["s0"].to_numpy(), "centroid_distance": np.sqrt((q * q).sum(1)), "pc1": p[:, 0], "pc2": p[:, 1] if p.shape[1] > 1 else np.nan, "mahalanobis": np.sqrt((p[:, :k] ** 2 / var[:k]).sum(1))})

    return wide.select("cohort", "s0", *sensors).groupBy("cohort").applyInPandas(work, REAL_TIME)


# --- cohorts and the fleet ---------------------------------------------------------------------------------------------
def edges_of_least_tree(x: np.ndarray) -> np.ndarray:
    """Lengths of the minimum spanning tree's edges: where the components of points join as a radius grows."""
    n = len(x)
    if n < 2:
        return np.zeros(0)
    far, out, done = np.full(n, np.inf), [], np.zeros(n, bool)
    at = 0
    for _ in range(n - 1):
        done[at] = True
        far = np.minimum(far, np.sqrt(((x - x[at]) ** 2).sum(1)))
        at = int(np.argmin(np.where(done, np.inf, far)))
        out.append(far[at])
    return np.sort(np.array(out))


PERSISTENCE = "cohort string, window_index long, n_points long, betti_0 long, total_persistence_0 double, max_persistence_0 double, entropy_0 double"


def persistence(vectors: DataFrame, features: list[str], radius: float = 1.0, most: int = 500) -> DataFrame:
    """Components of a window's signals in z-scored feature space: how many at a radius, and how long they last. Of more than `most` signals a sample, by a fixed seed, is taken."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("signal_id")
        if len(pdf) > most:
            pdf = pdf.sample(most, random_state=0)
        z, _ = scaled(pdf[features].to_numpy(float))
        e = edges_of_least_tree(z)
        p = e[e > 0] / e.sum() if e.sum() > 0 else np.zeros(0)
        return pd.DataFrame([[pdf["cohort"].iloc[0], int(pdf["window_index"].iloc[0]), len(pdf), 1 + int((e > radius).sum()), float(e.sum()), float(e.max()) if len(e) else 0.0, float(-(p * np.log(p)).sum())]], columns=[c.split()[0] for c in PERSISTENCE.split(", ")])

    return vectors.select("cohort", "signal_id", "window_index", *features).groupBy("cohort", "window_index").applyInPandas(work, PERSISTENCE)


def fleet_baseline(states: DataFrame, features: list[str], share: float = 0.2, least: int = 3) -> dict:
    """Mean, deviation, first component and effective dimension (e to the entropy) of the first `share` of each cohort's windows, pooled; from sums that meet on the driver."""
    w = W.partitionBy("cohort").orderBy("window_index")
    first = states.withColumn("__k", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy("cohort"))).filter((F.col("__k") <= F.greatest(F.lit(least), F.col("__n") * share)))
    first = first.dropna(subset=features)
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    got = first.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).first()
    cov = np.zeros((len(features),) * 2)
    for i, (a, b) in enumerate(pairs):
        cov[features.index(a), features.index(b)] = cov[features.index(b), features.index(a)] = got[f"c{i}"] or 0.0
    v, e = np.linalg.eigh(cov)
    v = np.maximum(v[::-1], 0)
    p = v[v > 1e-15] / v.sum() if v.sum() > 0 else np.ones(1)
    return {"features": features, "n": got["n"], "mean": [got[f"m{i}"] for i in range(len(features))], "deviation": np.sqrt(np.diag(cov)).tolist(), "component": e[:, -1].tolist(), "effective_dim": float(np.exp(-(p * np.log(p)).sum()))}


def departure(states: DataFrame, baseline: dict) -> DataFrame:
    """Distance of each state from the fleet's baseline mean, and its projection on the baseline's first component."""
    diffs = [F.col(f) - F.lit(m) for f, m in zip(baseline["features"], baseline["mean"], strict=True)]
    return states.withColumn("departure", F.sqrt(sum((d * d for d in diffs), F.lit(0.0)))).withColumn("projection", sum((d * F.lit(c) for d, c in zip(diffs, baseline["component"], strict=True)), F.lit(0.0)))


def trajectory_library(states: DataFrame, feature: str, length: int = 50) -> DataFrame:
    """Cohorts' trajectories of a feature, resampled to a length, in two groups around the farthest pair's medoids: (cohort, group, distance, medoid). One short row a cohort meets on the driver."""
    rows = states.groupBy("cohort").agg(F.array_sort(F.collect_list(F.struct("window_index", feature))).alias("path")).collect()
    names = [r["cohort"] for r in rows]
    x = np.array([np.interp(np.linspace(0, 1, length), np.linspace(0, 1, len(r["path"])), [p[feature] if p[feature] is not None else 0.0 for p in r["path"]]) if r["path"] else np.zeros(length) for r in rows]).reshape(-1, length)
    d = np.sqrt(np.maximum(((x[:, None] - x[None]) ** 2).sum(2), 0)) if len(x) else np.zeros((0, 0))
    if len(x) > 1:
        seeds = list(np.unravel_index(int(np.argmax(d)), d.shape))
        for _ in range(10):
            group = np.argmin(d[:, seeds], axis=1)
            new = [int(np.flatnonzero(group == g)[np.argmin(d[np.ix_(group == g, group == g)].sum(1))]) if (group == g).any() else seeds[g] for g in (0, 1)]
            if new == seeds:
                break
            seeds = new
        group = np.argmin(d[:, seeds], axis=1)
    else:
        seeds, group = [0, 0], np.zeros(len(x), int)
    out = [(names[i], int(group[i]), float(d[i, seeds[group[i]]]), names[seeds[group[i]]]) for i in range(len(x))]
    return states.sparkSession.createDataFrame(out, "cohort string, group int, distance double, medoid string")


def exponent_field(states: DataFrame, features: list[str], steps: int = 25) -> DataFrame:
    """Along a straight path between each two cohorts' mean states: the place, distance from either, and how near the path comes to the ridge where both are as far."""
    means = states.groupBy("cohort").agg(*[F.avg(f).alias(f) for f in features])
    b = means.select(F.col("cohort").alias("cohort_b"), *[F.col(f).alias(f"{f}_b") for f in features])
    both = means.withColumnRenamed("cohort", "cohort_a").join(b, F.col("cohort_a") < F.col("cohort_b"))
    span = F.sqrt(sum(((F.col(f) - F.col(f"{f}_b")) ** 2 for f in features), F.lit(0.0)))
    at = both.withColumn("span", span).withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("t", F.col("step") / (steps - 1))
    return at.select("cohort_a", "cohort_b", "step", "t", (F.col("t") * F.col("span")).alias("from_a"), ((1 - F.col("t")) * F.col("span")).alias("from_b"), (1 - F.abs(2 * F.col("t") - 1)).alias("ridge_strength"))
