import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import typology as T

N = 1200


def signals():
    r, t = np.random.default_rng(3), np.arange(N)
    x = [0.3]
    for _ in range(N - 1):
        x.append(3.99 * x[-1] * (1 - x[-1]))
    return {
        "constant": np.full(N, 5.0), "sine": np.sin(2 * np.pi * t / 25), "noise": r.normal(size=N), "walk": np.cumsum(r.normal(size=N)), "trend": t * 0.01 + r.normal(size=N) * 0.01, "level": r.integers(0, 4, N).astype(float),
        "spike": np.where(t % 400 == 7, 50.0, 0.01 * r.normal(size=N)), "event": np.where(t % 50 == 0, r.uniform(1, 2, N), 0.0), "chaos": np.array(x), "step": np.where(t < N / 2, 1.5, 2.5), "on": np.where((t // 30) % 2 == 0, r.uniform(1, 2, N), 0.0),
    }


@pytest.fixture(scope="module")
def observed(spark):
    rows = [("a", name, float(i), float(v)) for name, y in signals().items() for i, v in enumerate(y)]
    return spark.createDataFrame([*rows, ("a", "noise", -1.0, None), ("a", "few", 0.0, 1.0), ("a", "few", 1.0, 2.0)], "cohort string, signal_id string, s0 double, value double")


@pytest.fixture(scope="module")
def measured(observed):
    return T.measures(observed).cache()


def test_measures_and_classes(measured):
    m = {r["signal_id"]: r for r in T.classified(measured).collect()}
    y = signals()["noise"]
    assert m["noise"]["n_samples"] == N and abs(m["noise"]["signal_std"] - y.std()) < 1e-9 and abs(m["noise"]["kurtosis"] - ((y - y.mean()) ** 4).mean() / y.var() ** 2) < 1e-9
    assert m["few"]["hurst"] is None and m["few"]["temporal"] == "RANDOM"
    assert {k: m[k]["temporal"] for k in ("constant", "sine", "trend", "level", "spike", "event")} == {"constant": "CONSTANT", "sine": "PERIODIC", "trend": "TRENDING", "level": "DISCRETE", "spike": "IMPULSIVE", "event": "EVENT"}
    assert m["noise"]["temporal"] in ("RANDOM", "STATIONARY") and m["chaos"]["temporal"] == "CHAOTIC" and m["noise"]["complexity"] == "HIGH" and m["noise"]["spectral"] != "HARMONIC"
    assert m["constant"]["memory"] is None and m["event"]["continuity"] == "EVENT" and m["level"]["continuity"] == "DISCRETE" and m["walk"]["memory"] == "LONG_MEMORY" and m["walk"]["spectral_slope"] < -1
    assert abs(1 / m["sine"]["dominant_frequency"] - 25) < 0.5


def test_blocks_of_a_long_signal_are_averaged(spark, measured, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 400)
    rows = spark.createDataFrame([("a", "s", float(i), float(v)) for i, v in enumerate(signals()["noise"])], "cohort string, signal_id string, s0 double, value double")
    got, y = T.measures(rows).first(), signals()["noise"]
    parts = [T.measured(y[i : i + 400]) for i in (0, 400, 800)]
    for c in ("hurst", "perm_entropy", "turning_point_ratio"):
        assert abs(got[c] - np.mean([p[c] for p in parts])) < 1e-9
    assert got["n_samples"] == N and abs(got["signal_std"] - y.std()) < 1e-9


def test_sparse_kinds_and_corrections(measured):
    k = {r["signal_id"]: r["kind"] for r in T.sparse_kind(measured).collect()}
    assert k["constant"] == "CONSTANT" and k["step"] == "BINARY" and k["level"] == "DISCRETE" and k["spike"] == "IMPULSIVE" and k["event"] == "EVENT" and k["on"] == "INTERMITTENT" and k["noise"] == "CONTINUOUS"
    base = T.classified(measured).filter("signal_id = 'noise'")
    wrong = base.withColumns({"temporal": F.lit("PERIODIC"), "is_first_bin_peak": F.lit(True)})
    assert T.corrected(wrong).first()["temporal"] == "RANDOM" and T.corrected(wrong.withColumn("segment_monotonic", F.lit(True))).first()["temporal"] == "TRENDING"
    grown = base.withColumns({"temporal": F.lit("RANDOM"), "segment_monotonic": F.lit(True), "segment_change": F.lit(0.3), "hurst": F.lit(0.7)})
    assert T.corrected(grown).first()["temporal"] == "TRENDING" and T.corrected(grown.withColumn("segment_change", F.lit(0.1))).first()["was_corrected"] is False
    near = T.overlapping(base.withColumn("hurst", F.lit(0.64))).first()
    assert "LONG_MEMORY/SHORT_MEMORY" in near["secondary"] and near["confidence"] == 0.5


def test_windows_and_manifest(measured):
    c = T.windows(T.classified(measured))
    w = {r["signal_id"]: r for r in c.collect()}
    assert all(0 < r["stride"] <= r["window_size"] <= r["n_samples"] for r in w.values()) and w["few"]["window_size"] == 2
    assert w["sine"]["characteristic_source"] == "acf_half_life" and w["walk"]["window_size"] > w["noise"]["window_size"] == 64
    assert [T.window_by_length(n) for n in (100, 128, 129, 512, 2048, 9000)] == [(100, 100), (128, 128), (64, 16), (64, 16), (128, 32), (256, 64)]
    assert 64 <= T.system_window(c, "median") <= T.system_window(c) <= 2048
    m = T.manifest(c)
    assert T.validate_manifest(m) == [] and m["cohorts"]["a"]["constant"]["engines"] == [] and "harmonics" in m["cohorts"]["a"]["sine"]["engines"] and m["n_signals"] == 12
    m["cohorts"]["a"]["sine"] |= {"engines": ["none"], "stride": 0}
    assert len(T.validate_manifest(m)) == 2 and T.validate_manifest({}) == ["no cohorts"]


def test_classes_of_halves(observed):
    s = {r["signal_id"]: r for r in T.class_stability(observed.filter("signal_id in ('noise', 'sine')")).collect()}
    assert s["sine"]["agreement"] >= 0.5 and s["noise"]["status"] in ("STABLE", "MARGINAL")
