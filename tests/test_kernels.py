import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidemark.operators import kernels


def vectors(spark, n_windows=6, seed=42):
    r = np.random.default_rng(seed)
    rows = [("a", f"s{i}", w, *map(float, r.normal(size=4)), 1.0, float("nan")) for w in range(n_windows) for i in range(6)]
    return spark.createDataFrame(rows, "cohort string, signal_id string, window_index long, f0 double, f1 double, f2 double, f3 double, flat double, holes double")


FEATURES = ["f0", "f1", "f2", "f3", "flat", "holes"]


def test_effective_dimension_of_known_ensembles():
    r = np.random.default_rng(42)
    one = np.outer(r.normal(size=10), [1, 2, 3])
    d = kernels.decomposed(one)
    assert abs(d["effective_dim"] - 1) < 1e-9 and abs(d["effective_dim_entropy"] - 1) < 1e-6 and d["energy_concentration"] > 0.999
    two = np.c_[r.normal(size=(10, 1)) * [1, 1, 1], r.normal(size=(10, 1)) * [1, 1]]
    assert 1.5 < kernels.decomposed(two)["effective_dim"] < 2.3 and kernels.decomposed(np.ones((5, 4))) is None
    x = r.normal(size=(8, 3))
    d = kernels.decomposed(x)
    assert np.allclose(d["eigenvalues"], np.sort(np.linalg.eigvalsh(np.cov(((x - x.mean(0)) / x.std(0)).T)))[::-1]) and abs(d["total_variance"] - 3 * 8 / 7) < 1e-9
    dim, low, high = kernels.jackknife(x)
    assert low < dim < high and np.isnan(kernels.jackknife(x[:3])[1])


def test_eigendecomposition_continuity_and_signal_geometry(spark):
    e = kernels.eigendecomposition(vectors(spark), FEATURES).toPandas().sort_values("window_index")
    assert len(e) == 6 and all(list(c) == FEATURES[:4] for c in e["columns"]) and (e["eff_dim_ci_low"] < e["effective_dim"]).all()
    c = kernels.continuous(kernels.eigendecomposition(vectors(spark), FEATURES)).toPandas().sort_values("window_index")
    first = [np.array(x[0]) for x in c["loadings"]]
    assert all(a @ b >= 0 for a, b in zip(first, first[1:], strict=False)) and all(np.allclose(np.abs(np.stack(x)), np.abs(np.stack(y))) for x, y in zip(c["loadings"], e["loadings"], strict=True))
    g = kernels.signal_geometry(vectors(spark), FEATURES).toPandas()
    assert len(g) == 36 and np.allclose(g["distance"] ** 2, g["contribution"] ** 2 + g["residual"] ** 2) and g["coherence"].abs().max() <= 1 + 1e-9
    pairs = kernels.co_loading(kernels.eigendecomposition(vectors(spark), FEATURES)).collect()
    assert pairs and all(r["feature_a"] < r["feature_b"] for r in pairs)


def test_central_differences_and_collapse(spark):
    y = [5.0, 5.0, 4.0, 3.0, 2.0, 1.0, 1.0, 1.0]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(y)], "cohort string, window_index long, dim double")
    got = kernels.central(df, ["cohort"], "window_index", ["dim"]).toPandas().sort_values("window_index")
    assert np.allclose(got["dim_velocity"], np.gradient(y)) and np.allclose(got["dim_acceleration"], np.gradient(np.gradient(y)))
    out = kernels.collapse(kernels.central(df, ["cohort"], "window_index", ["dim"]), ["cohort"], "window_index", "dim_velocity").first()
    assert out["onset"] == 1 and out["collapsing"] and abs(out["share_below"] - 5 / 8) < 1e-9
    flat = kernels.collapse(kernels.central(df.withColumn("dim", F.lit(2.0)), ["cohort"], "window_index", ["dim"], smooth=3), ["cohort"], "window_index", "dim_velocity").first()
    assert flat["onset"] is None and not flat["collapsing"]


def test_stability_of_an_oscillation(spark):
    rows = [("a", "x", float(i), float(3 * np.sin(2 * np.pi * i / 16))) for i in range(256)]
    got = kernels.rolling_stability(spark.createDataFrame(rows, "cohort string, signal_id string, s0 double, value double")).toPandas()
    assert len(got) == 7 and np.allclose(got["frequency_mean"], 1 / 16, atol=1e-3) and np.allclose(got["amplitude_mean"], 3, atol=0.05) and (got["stability"] > 0.95).all()


def test_baselines_and_departures(spark):
    r = np.random.default_rng(1)
    y = np.r_[r.normal(size=40) * 5, r.normal(size=30) * 0.1, r.normal(size=30) * 5]
    a, z = kernels.stable_baseline(y)
    assert 38 <= a <= 52 and z - a == 20
    x = r.normal(size=(120, 3))
    x[100:] += 8
    wide = spark.createDataFrame(pd.DataFrame({"cohort": "a", "s0": np.arange(120.0), "u": x[:, 0], "v": x[:, 1], "w": x[:, 2]}))
    g = kernels.real_time_geometry(wide, ["u", "v", "w"]).toPandas().sort_values("s0")
    assert g["mahalanobis"].iloc[:90].mean() * 2 < g["mahalanobis"].iloc[105:].mean() and len(g) == 120
    states = spark.createDataFrame([(c, w, float(w), float(2 * w)) for c in ("a", "b") for w in range(20)], "cohort string, window_index long, p double, q double")
    base = kernels.fleet_baseline(states, ["p", "q"])
    assert base["n"] == 8 and np.allclose(base["mean"], [1.5, 3]) and abs(base["effective_dim"] - 1) < 1e-6
    d = kernels.departure(states, base).filter("window_index = 10 and cohort = 'a'").first()
    assert abs(d["departure"] - np.hypot(8.5, 17)) < 1e-9 and abs(abs(d["projection"]) - d["departure"]) < 1e-9


def test_components_last_as_long_as_the_least_trees_edges(spark):
    x = np.array([[0.0, 0], [0, 1], [5, 0], [5, 1.5]])
    assert np.allclose(kernels.edges_of_least_tree(x), [1, 1.5, 5])
    p = kernels.persistence(vectors(spark), FEATURES).toPandas()
    assert len(p) == 6 and (p["n_points"] == 6).all() and (p["betti_0"] >= 1).all() and (p["max_persistence_0"] <= p["total_persistence_0"]).all()


def test_trajectories_fall_into_two_groups(spark):
    rows = [(f"up{i}", w, float(w + 0.1 * i)) for i in range(3) for w in range(10)] + [(f"down{i}", w, float(-w - 0.1 * i)) for i in range(3) for w in range(8)]
    states = spark.createDataFrame(rows, "cohort string, window_index long, f double")
    got = {r["cohort"]: r["group"] for r in kernels.trajectory_library(states, "f").collect()}
    assert len({got[f"up{i}"] for i in range(3)}) == 1 and got["up0"] != got["down0"] and len({got[f"down{i}"] for i in range(3)}) == 1
    field = kernels.exponent_field(states.filter("cohort in ('up0', 'down0')"), ["f"]).toPandas()
    assert len(field) == 25 and field["ridge_strength"].max() == 1 and field["from_a"].iloc[0] == 0
