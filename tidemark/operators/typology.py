"""Typology of signals: measures of each signal, ten classes by rules over columns, corrections, window sizes, manifests."""

from __future__ import annotations

from math import erfc

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import engines as E

#: Values of a block: the measures of a longer signal are the means over its blocks.
BLOCK = 8192
#: Values that the measures of quadratic time see of a block.
SQUARE = 1000
BY_BLOCK = "turning_point_ratio acf_half_life dominant_frequency spectral_flatness spectral_slope spectral_peak_snr harmonic_noise_ratio hurst perm_entropy sample_entropy lyapunov_proxy determinism_score variance_ratio rolling_var_std arch_pvalue adf_pvalue kpss_pvalue derivative_sparsity zero_run_ratio first_bin_peak".split()


def _spectrum(y: np.ndarray) -> dict:
    """Place of the peak, flatness, slope in log-log, peak over median in dB, harmonics over the rest, and whether the peak is the first bin."""
    p = np.abs(np.fft.rfft((y - y.mean()) * np.hanning(len(y)))) ** 2
    f, p = np.fft.rfftfreq(len(y))[1:], p[1:] + 1e-20
    k = int(np.argmax(p))
    own = sorted({j for m in (1, 2, 3) for j in range((k + 1) * m - 2, (k + 1) * m + 1) if 0 <= j < len(p)})
    rest = p.sum() - p[own].sum()
    return {
        "dominant_frequency": f[k], "spectral_flatness": np.exp(np.log(p).mean()) / p.mean(), "spectral_slope": np.polyfit(np.log(f), np.log(p), 1)[0], "spectral_peak_snr": 10 * np.log10(p[k] / np.median(p)),
        "harmonic_noise_ratio": p[own].sum() / rest if rest > 0 else 1e9, "first_bin_peak": float(k == 0),
    }


def _half_life(x: np.ndarray) -> float:
    f = np.fft.rfft(x, 2 * len(x))
    a = np.fft.irfft(f * np.conj(f))[: len(x)]
    below = np.flatnonzero(a < 0.5 * a[0])
    return float(below[0]) if len(below) else np.nan


def kpss_pvalue(y: np.ndarray) -> float:
    """Of the test of stationarity around a level, between its published critical values."""
    x = y - y.mean()
    n, lags = len(x), int(4 * (len(x) / 100) ** 0.25)
    s = x @ x / n + 2 * sum((1 - i / (lags + 1)) * (x[i:] @ x[:-i]) / n for i in range(1, lags + 1))
    stat = (np.cumsum(x) ** 2).sum() / (n * n * s) if s > 0 else 0.0
    # Critical values at ten, five, two and a half, and one per cent
    return float(np.interp(stat, [0.347, 0.463, 0.574, 0.739], [0.10, 0.05, 0.025, 0.01]))


def measured(y: np.ndarray) -> dict:
    """BY_BLOCK of the values of one block in their order, NaN where it has fewer than 32 or does not vary."""
    out, d = dict.fromkeys(BY_BLOCK, np.nan), np.diff(y)
    if len(d):
        zero = y == 0
        out |= {"derivative_sparsity": (np.abs(d) < 1e-10).mean(), "zero_run_ratio": (zero[1:] & zero[:-1]).mean()}
    if len(y) < 32 or y.std() < 1e-12:
        return out
    short, v, sq = y[:SQUARE], np.array([p.var() for p in np.array_split(y, 10)]), (d - d.mean()) ** 2
    z = np.sqrt(len(sq)) * (np.corrcoef(sq[1:], sq[:-1])[0, 1] if sq.std() > 0 else 0.0)
    return out | _spectrum(y) | {
        "turning_point_ratio": (d[1:] * d[:-1] < 0).mean(), "acf_half_life": _half_life(y - y.mean()), "hurst": E.rescaled_range(y)[0], "perm_entropy": E.permutation_entropy(y), "sample_entropy": E.sample_entropy(short), "lyapunov_proxy": E.rosenstein(short, floor=1e-9)[0],
        "determinism_score": E.determinism(short)[0], "variance_ratio": np.var(y[2:] - y[:-2]) / (2 * np.var(d)) if np.var(d) > 0 else np.nan, "rolling_var_std": v.std() / v.mean(), "arch_pvalue": erfc(abs(z) / np.sqrt(2)), "adf_pvalue": E.adf_stat(short)[1], "kpss_pvalue": kpss_pvalue(y),
    }


def measures(obs: DataFrame) -> DataFrame:
    """One row a signal. Counts, moments, and the means of its quarters are of all its values; BY_BLOCK are means over blocks of BLOCK values, so that a task holds one block at a time."""
    w = W.partitionBy("cohort", "signal_id")
    v = F.col("value")
    rows = obs.filter(v.isNotNull() & ~F.isnan(v)).select("cohort", "signal_id", "s0", "value").withColumn("k", F.row_number().over(w.orderBy("s0")) - 1).withColumn("n", F.count(F.lit(1)).over(w))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        with np.errstate(all="ignore"):
            m = measured(pdf.sort_values("k")["value"].to_numpy(float))
        return pd.DataFrame([[pdf["cohort"].iloc[0], pdf["signal_id"].iloc[0], len(pdf), *(float(m[c]) for c in BY_BLOCK)]], columns=["cohort", "signal_id", "size", *BY_BLOCK])

    blocks = rows.select("cohort", "signal_id", (F.floor(F.col("k") / BLOCK)).alias("block"), "k", "value").groupBy("cohort", "signal_id", "block").applyInPandas(work, "cohort string, signal_id string, size long, " + ", ".join(f"{c} double" for c in BY_BLOCK))
    told = [F.when(~F.isnan(c), F.col(c)) for c in BY_BLOCK]
    blocks = blocks.groupBy("cohort", "signal_id").agg(*[F.try_divide(F.sum(x * F.col("size")), F.sum(F.when(x.isNotNull(), F.col("size")))).alias(c) for c, x in zip(BY_BLOCK, told, strict=True)])
    quarter = [F.avg(F.when(F.floor(F.col("k") * 4 / F.col("n")) == i, v)) for i in range(4)]
    whole = rows.groupBy("cohort", "signal_id").agg(
        F.count(F.lit(1)).alias("n_samples"), F.count_distinct("value").alias("n_unique"), F.min(v == F.floor(v)).alias("is_integer"), F.avg(v).alias("signal_mean"), F.stddev_pop(v).alias("signal_std"), (F.kurtosis(v) + 3).alias("kurtosis"), F.skewness(v).alias("skewness"),
        F.try_divide(F.max(F.abs(v)), F.sqrt(F.avg(v * v))).alias("crest_factor"), F.avg((v == 0).cast("double")).alias("sparsity"), F.array(*quarter).alias("quarters"), (F.max(v) - F.min(v)).alias("extent"),
    )
    q = F.col("quarters")
    rise, fall = [(q[0] < q[1]) & (q[1] < q[2]) & (q[2] < q[3]), (q[0] > q[1]) & (q[1] > q[2]) & (q[2] > q[3])]
    whole = whole.withColumns({"unique_ratio": F.col("n_unique") / F.col("n_samples"), "segment_monotonic": F.coalesce(rise | fall, F.lit(False)), "segment_change": F.try_divide(F.abs(q[3] - q[0]), F.col("extent"))}).drop("quarters", "extent")
    return whole.join(blocks, ["cohort", "signal_id"]).withColumn("is_first_bin_peak", F.coalesce(F.col("first_bin_peak") > 0.5, F.lit(False))).drop("first_bin_peak")


# --- ten classes, by rules over the measures' columns ----------------------------------------------------------------
#: Cut-offs of the classes.
CUT = {
    "constant_std": 1e-10, "constant_cv": 1e-6, "event_sparsity": 0.9, "discrete_ratio": 0.05, "impulsive_kurtosis": 20, "impulsive_crest": 10, "temporal_event_sparsity": 0.8, "temporal_event_kurtosis": 10, "bounded_hurst": 0.95, "bounded_entropy": 0.5, "bounded_variance": 3.0,
    "clean_lyapunov": 0.15, "clean_entropy": 0.6, "clean_sample_entropy": 0.3, "chaotic_lyapunov": 0.01, "chaotic_entropy": 0.35, "chaotic_samples": 500, "chaotic_determinism": 0.3, "trend_hurst": 0.99, "trend_hurst_moderate": 0.85, "trend_acf": 0.10, "trend_sample_entropy": 0.15, "drift_hurst": 0.85, "drift_entropy": 0.5,
    "periodic_snr_sure": 30.0, "periodic_flat_sure": 0.1, "periodic_flat": 0.15, "periodic_snr": 15.0, "periodic_hurst": 0.95, "periodic_turns": 0.95, "quasi_flat": 0.3, "quasi_snr": 10.0, "quasi_entropy": 0.9, "p": 0.05, "walk_low": 0.85, "walk_high": 1.15, "long_memory": 0.65, "anti_persistent": 0.45,
    "simple": 0.3, "complex": 0.7, "harmonic": 3.0, "broadband": 0.8, "red": -0.5, "blue": 0.2,
}


def _get(name: str, default: float) -> Column:
    c = F.col(name)
    return F.coalesce(F.when(~F.isnan(c), c), F.lit(float(default)))


def _known(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(F.col(name))


def _first(*rules: tuple[Column, str], other: str | None) -> Column:
    out = F
    for c, label in rules:
        out = out.when(c, F.lit(label))
    return out.otherwise(F.lit(other))


def classified(m: DataFrame) -> DataFrame:
    """The measures with ten classes; the classes of a constant but continuity, stationarity and temporal are null."""
    k = CUT
    std, mean = _get("signal_std", 0), _get("signal_mean", 0)
    constant = (std < k["constant_std"]) | ((F.abs(mean) > 1e-10) & (std / F.greatest(F.abs(mean), F.lit(1e-10)) < k["constant_cv"]))
    hurst, pe, se, lyap, vr, n = _get("hurst", 0.5), _get("perm_entropy", 0.5), _get("sample_entropy", 1.0), _get("lyapunov_proxy", 0), _get("variance_ratio", 0), F.col("n_samples")
    kurt, crest, sparse, sf, snr = _get("kurtosis", 3), _get("crest_factor", 1), _get("sparsity", 0), _get("spectral_flatness", 0.5), _get("spectral_peak_snr", 0)
    turns, slope, skew, rvs = _get("turning_point_ratio", 0.667), _get("spectral_slope", 0), _get("skewness", 0), _get("rolling_var_std", 0)
    discrete = F.col("is_integer") & (_get("unique_ratio", 1) < k["discrete_ratio"])
    adf, kpss = _known("adf_pvalue") & (_get("adf_pvalue", 1) < k["p"]), _known("kpss_pvalue") & (_get("kpss_pvalue", 0) >= k["p"])
    known = _known("variance_ratio")
    tame = known & (hurst >= k["bounded_hurst"]) & (pe <= k["bounded_entropy"])
    slow = ~_known("acf_half_life") | (_get("acf_half_life", 0) / n > k["trend_acf"])
    m = m.withColumns({
        "continuity": _first((constant, "CONSTANT"), (sparse > k["event_sparsity"], "EVENT"), (discrete, "DISCRETE"), other="CONTINUOUS"),
        "stationarity": _first((constant, "STATIONARY"), ((turns < 0.5) & _known("kpss_pvalue") & ~kpss, "NON_STATIONARY"), (turns < 0.5, "TREND_STATIONARY"), (adf & kpss, "STATIONARY"), (adf, "TREND_STATIONARY"), (kpss, "DIFFERENCE_STATIONARY"), other="NON_STATIONARY"),
    })
    drifting = (hurst >= k["drift_hurst"]) & (pe >= k["drift_entropy"]) & (F.col("stationarity") != "STATIONARY") & ~(known & vr.between(k["walk_low"], k["walk_high"]))
    beat = _get("dominant_frequency", 0) > 0
    sure = (snr > k["periodic_snr_sure"]) & (sf < k["periodic_flat_sure"])
    periodic = beat & (sure | ((sf <= k["periodic_flat"]) & (snr >= k["periodic_snr"]) & (hurst <= k["periodic_hurst"]) & (turns <= k["periodic_turns"])))
    temporal = _first(
        (constant, "CONSTANT"), (discrete, "DISCRETE"), ((kurt > k["impulsive_kurtosis"]) & (crest > k["impulsive_crest"]), "IMPULSIVE"), ((sparse > k["temporal_event_sparsity"]) & (kurt > k["temporal_event_kurtosis"]), "EVENT"),
        (tame & (vr <= k["bounded_variance"]) & (lyap > k["clean_lyapunov"]) & (pe < k["clean_entropy"]) & (se < k["clean_sample_entropy"]), "CHAOTIC"),
        ((n >= k["chaotic_samples"]) & (lyap > k["chaotic_lyapunov"]) & (pe > k["chaotic_entropy"]) & (_get("determinism_score", 1) > k["chaotic_determinism"]), "CHAOTIC"),
        (~tame & ((hurst >= k["trend_hurst"]) | ((hurst > k["trend_hurst_moderate"]) & slow & (se < k["trend_sample_entropy"]))), "TRENDING"), (drifting, "DRIFTING"), (periodic, "PERIODIC"),
        ((sf < k["quasi_flat"]) & (snr > k["quasi_snr"]) & (pe < k["quasi_entropy"]), "QUASI_PERIODIC"), (adf & known & vr.between(k["walk_low"], k["walk_high"]), "STATIONARY"), other="RANDOM",
    )
    rest = {
        "memory": _first((hurst > k["long_memory"], "LONG_MEMORY"), (hurst < k["anti_persistent"], "ANTI_PERSISTENT"), other="SHORT_MEMORY"),
        "complexity": _first((pe < k["simple"], "LOW"), (pe > k["complex"], "HIGH"), other="MEDIUM"),
        "spectral": _first(((_get("harmonic_noise_ratio", 0) > k["harmonic"]) & (snr > 10), "HARMONIC"), (sf > k["broadband"], "BROADBAND"), (slope < k["red"], "RED_NOISE"), (slope > k["blue"], "BLUE_NOISE"), ((snr > 10) & (sf < 0.3), "NARROWBAND"), other="ONE_OVER_F"),
        "determinism": F.when(_known("determinism_score"), _first((_get("determinism_score", 0) > 0.8, "DETERMINISTIC"), (_get("determinism_score", 0) < 0.3, "STOCHASTIC"), other="MIXED")),
        "distribution": _first((kurt > 5, "HEAVY_TAILED"), (F.abs(skew) > 1, "SKEWED"), (kurt < 2.5, "UNIFORM"), other="GAUSSIAN"),
        "amplitude": _first((rvs > 0.5, "HETEROSCEDASTIC"), (rvs > 0.2, "MODULATED"), other="STABLE"),
        "volatility": _first((_get("arch_pvalue", 1) < 0.01, "CLUSTERED"), (rvs > 0.5, "HIGH"), (rvs > 0.2, "MODERATE"), other="LOW"),
    }
    return m.withColumn("temporal", temporal).withColumns({c: F.when(~constant, x) for c, x in rest.items()})


def sparse_kind(m: DataFrame) -> DataFrame:
    """`kind`: constant, binary, discrete, impulsive, event, step, intermittent, or continuous; the first that fits."""
    g, some = _get, F.col("n_unique")
    return m.withColumn("kind", _first(
        ((g("signal_std", 0) < 1e-9) | (some <= 1), "CONSTANT"), (some == 2, "BINARY"), (F.col("is_integer") & ((g("unique_ratio", 1) <= 0.05) | (some <= 50)), "DISCRETE"), ((g("kurtosis", 0) >= 20) & (g("crest_factor", 1) >= 10), "IMPULSIVE"), ((g("sparsity", 0) >= 0.8) & (g("kurtosis", 0) >= 10), "EVENT"),
        ((g("derivative_sparsity", 0) >= 0.9) & (g("unique_ratio", 1) <= 0.1), "STEP"), ((g("zero_run_ratio", 0) >= 0.3) & g("sparsity", 0).between(0.3, 0.8), "INTERMITTENT"), other="CONTINUOUS",
    ))


def corrected(m: DataFrame) -> DataFrame:
    """classified() with `temporal` mended where the first rules are known to err: a peak in the first bin is no period; means of quarters that rise or fall by a fifth of the range are a trend."""
    artifact = (F.col("temporal") == "PERIODIC") & F.col("is_first_bin_peak")
    trend = F.col("temporal").isin("RANDOM", "STATIONARY", "QUASI_PERIODIC") & F.col("segment_monotonic") & (_get("segment_change", 0) >= 0.20) & (_get("hurst", 0.5) >= 0.60)
    integrated = (F.col("temporal") == "RANDOM") & (_get("hurst", 0.5) > 0.85) & (F.col("stationarity") != "STATIONARY")
    mended = F.when(artifact & F.col("segment_monotonic"), "TRENDING").when(artifact, "RANDOM").when(trend, "TRENDING").when(integrated, "DRIFTING").otherwise(F.col("temporal"))
    return m.withColumn("temporal_first", F.col("temporal")).withColumn("temporal", mended).withColumn("was_corrected", F.col("temporal") != F.col("temporal_first"))


#: Pairs of classes that lie next to each other, the measure between them and how near its cut-off is ambiguous.
OVERLAPS = (("LONG_MEMORY", "SHORT_MEMORY", "hurst", CUT["long_memory"], 0.05), ("SHORT_MEMORY", "ANTI_PERSISTENT", "hurst", CUT["anti_persistent"], 0.05), ("LOW", "MEDIUM", "perm_entropy", CUT["simple"], 0.05), ("MEDIUM", "HIGH", "perm_entropy", CUT["complex"], 0.05), ("PERIODIC", "QUASI_PERIODIC", "spectral_flatness", CUT["periodic_flat"], 0.03))


def overlapping(m: DataFrame) -> DataFrame:
    """`secondary`: classes that a signal nearly has, as its measure lies close to the cut-off."""
    near = [F.when(F.abs(_get(c, -9) - at) <= width, F.lit(f"{a}/{b}")) for a, b, c, at, width in OVERLAPS]
    return m.withColumn("secondary", F.array_compact(F.array(*near))).withColumn("confidence", F.when(F.size("secondary") > 0, 0.5).otherwise(1.0))


def class_stability(obs: DataFrame) -> DataFrame:
    """Whether the classes of either half of a signal are the whole's: the share of seven classes that both halves agree with."""
    half = F.ntile(2).over(W.partitionBy("cohort", "signal_id").orderBy("s0"))
    dims = ["temporal", "memory", "complexity", "spectral", "distribution", "amplitude", "volatility"]
    whole = classified(measures(obs)).select("cohort", "signal_id", *dims)
    parts = classified(measures(obs.withColumn("signal_id", F.concat_ws("#", "signal_id", half)))).select("cohort", F.split("signal_id", "#")[0].alias("signal_id"), *[F.col(d).alias(f"{d}_half") for d in dims])
    same = sum((F.col(d).eqNullSafe(F.col(f"{d}_half")).cast("int") for d in dims), F.lit(0)) / len(dims)
    out = whole.join(parts, ["cohort", "signal_id"]).groupBy("cohort", "signal_id").agg(F.avg(same).alias("agreement"))
    return out.withColumn("status", F.when(F.col("agreement") >= 0.8, "STABLE").when(F.col("agreement") >= 0.5, "MARGINAL").otherwise("UNSTABLE"))


# --- window sizes ------------------------------------------------------------------------------------------------------
#: Fixed values: (most samples, window, stride); a shorter signal than the first is one window.
BY_LENGTH = ((128, None, None), (512, 64, 16), (2048, 128, 32), (None, 256, 64))
LEAST_WINDOW, MOST_WINDOW, LEAST_STRIDE, TIMES = 64, 2048, 8, 2.5


def window_by_length(n: int) -> tuple[int, int]:
    for most, window, stride in BY_LENGTH:
        if most is None or n <= most:
            return (n, n) if window is None else (window, stride)
    raise AssertionError


def windows(m: DataFrame) -> DataFrame:
    """`characteristic_time` and its source (memory, period, level length, persistence, turning rate, or a hundredth of the length), `window_size`, `stride`."""
    n = F.col("n_samples").cast("double")
    freq, sparse, hurst, turns = _get("dominant_frequency", 0), _get("derivative_sparsity", 0), _get("hurst", 0.5), _get("turning_point_ratio", 0.667)
    rules = [
        (_get("acf_half_life", 0) > 0, _get("acf_half_life", 0), "acf_half_life"), ((freq > 0) & (1 / F.greatest(freq, F.lit(1e-12)) < n), 1 / F.greatest(freq, F.lit(1e-12)), "dominant_frequency"), (sparse > 0.5, n * sparse * 0.1, "derivative_sparsity"),
        (hurst > 0.8, n * 0.05, "hurst_persistent"), (hurst < 0.3, n * 0.005, "hurst_anti_persistent"), (turns < 0.4, n * 0.03, "turning_point_ratio"), (turns > 0.8, n * 0.005, "turning_point_ratio"),
    ]
    time, source = F, F
    for c, t, name in rules:
        time, source = time.when(c, t), source.when(c, F.lit(name))
    m = m.withColumn("characteristic_time", time.otherwise(n * 0.01)).withColumn("characteristic_source", source.otherwise(F.lit("fallback")))
    part = F.when(F.col("characteristic_time") / n < 0.01, 0.25).when(F.col("characteristic_time") / n > 0.10, 0.75).otherwise(0.50)
    size = F.least(F.least(F.greatest(F.floor(F.col("characteristic_time") * TIMES), F.lit(LEAST_WINDOW)), F.lit(MOST_WINDOW)), F.col("n_samples"))
    m = m.withColumn("window_size", size.cast("long"))
    return m.withColumn("stride", F.least(F.greatest(F.floor(F.col("window_size") * part), F.lit(LEAST_STRIDE)), F.col("window_size")).cast("long"))


def system_window(m: DataFrame, method: str = "max") -> int:
    """One window for all signals of windows(m): by the slowest, the median or the ninetieth percentile of their characteristic times."""
    by = {"max": F.max("characteristic_time"), "median": F.expr("percentile(characteristic_time, 0.5)"), "p90": F.expr("percentile(characteristic_time, 0.9)")}[method]
    t = m.filter("characteristic_time > 0").agg(by).first()[0]
    return LEAST_WINDOW if t is None else int(min(MOST_WINDOW, max(LEAST_WINDOW, t * TIMES)))


#: Engines that a class of signals calls for beside those that all get.
ALWAYS = ("statistics", "trend", "spectral", "complexity", "hurst")
BY_CLASS = {"PERIODIC": ("harmonics", "fundamental_freq", "thd"), "QUASI_PERIODIC": ("harmonics", "frequency_bands"), "CHAOTIC": ("lyapunov", "correlation_dimension", "attractor"), "TRENDING": ("variance_growth", "rate_of_change"), "DRIFTING": ("variance_growth", "adf_stat"), "IMPULSIVE": ("cycle_counting", "peak"), "DISCRETE": ("transition_matrix", "dwell_times", "level_count"), "EVENT": ("mean_time_between", "dwell_times"), "STATIONARY": ("garch",), "RANDOM": ("variance_ratio",), "CONSTANT": ()}


def manifest(m: DataFrame) -> dict:
    """Engines, window and stride of each signal of windows(classified(m)), by cohort; one row a signal meets on the driver."""
    out: dict = {}
    for r in m.select("cohort", "signal_id", "temporal", "window_size", "stride").collect():
        engines = [] if r["temporal"] == "CONSTANT" else sorted({*ALWAYS, *BY_CLASS[r["temporal"]]})
        out.setdefault(r["cohort"], {})[r["signal_id"]] = {"temporal": r["temporal"], "engines": engines, "window": r["window_size"], "stride": r["stride"]}
    return {"version": 1, "cohorts": out, "n_signals": sum(map(len, out.values()))}


def validate_manifest(found: dict) -> list[str]:
    """What is wrong with a manifest; nothing if the list is empty."""
    faults = [] if found.get("cohorts") else ["no cohorts"]
    for cohort, signals in found.get("cohorts", {}).items():
        for name, s in signals.items():
            faults += [f"{cohort}/{name}: unknown engine {e}" for e in s["engines"] if e not in E.ENGINES]
            if not 0 < s["stride"] <= s["window"]:
                faults.append(f"{cohort}/{name}: stride {s['stride']} of window {s['window']}")
    return faults
