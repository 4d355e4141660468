import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import fleet, learning, regimes


def observations(spark):
    r = np.random.default_rng(7)
    shared, rows = np.cumsum(r.normal(size=80)), []
    for c in range(4):
        own = r.normal(size=80)
        for i in range(80):
            rows += [(f"c{c}", "clock", float(i), float(i)), (f"c{c}", "flat", float(i), 3.0), (f"c{c}", "system", float(i), float(shared[i] + 0.9 * r.normal())), (f"c{c}", "own", float(i), float(own[i])), (f"c{c}", "twin", float(i), float(2 * own[i] + 1))]
    return spark.createDataFrame([*rows, ("c0", "own", 5.5, None)], "cohort string, signal_id string, s0 double, value double")


def test_cohort_discovery_and_faults(spark):
    obs = observations(spark)
    k = {r["signal_id"]: r for r in fleet.cohort_discovery(obs).collect()}
    assert {s: k[s]["kind"] for s in k} == {"clock": "CONSTANT", "flat": "CONSTANT", "system": "SYSTEM", "own": "COMPONENT", "twin": "COMPONENT"} and k["own"]["n_pairs"] == 6
    got = {(r["cohort"], r["signal_id"], r["fault"]) for r in fleet.series_faults(obs).collect()}
    assert {("c1", "flat", "constant"), ("c1", "twin", "duplicate")} <= got and not any(s == "system" and f != "orphan" for _, s, f in got)
    c = {r["cohort"]: r for r in fleet.within_coupling(obs).collect()}
    pdf = obs.filter("cohort = 'c0' and value is not null").toPandas().pivot(index="s0", columns="signal_id", values="value")
    pairs = pdf.drop(columns="flat").corr().abs().to_numpy()[np.triu_indices(4, 1)]
    assert abs(c["c0"]["coupling"] - pairs.mean()) < 1e-9


def test_baselines_and_runs(spark):
    g = spark.createDataFrame([("a", i, float(i % 7)) for i in range(20)] + [("b", i, 10.0 + i) for i in range(5)], "cohort string, window_index long, effective_dim double")
    take = lambda **how: sorted((r["cohort"], r["window_index"]) for r in fleet.baseline_rows(g, **how).collect())
    assert take(mode="first") == [("a", 0), ("a", 1), ("b", 0)] and take(mode="last") == [("a", 18), ("a", 19), ("b", 4)] and take(mode="discover") == [("a", 6), ("a", 13), ("b", 4)] and len(take(mode="all")) == 25
    z = fleet.against_baseline(g, ["effective_dim"], mode="reference", reference="b").filter("cohort = 'b' and window_index = 2").first()
    assert abs(z["effective_dim_z"]) < 1e-9
    runs = fleet.compiled_runs({"r1": g.filter("cohort = 'a'"), "r2": g.filter("cohort = 'a'").withColumn("effective_dim", F.col("effective_dim") * 1.005).withColumn("more", F.lit(1))})
    assert runs.columns[0] == "run_id" and runs.count() == 40 and all(r["converged"] in (True, None) for r in fleet.convergence(runs, "effective_dim", ["cohort", "window_index"]).collect())


def test_early_warning(spark):
    r = np.random.default_rng(1)
    rows = [(f"c{c:02}", "s", float(i), float(r.normal() + (0.8 * i if c == 3 else 0))) for c in range(12) for i in range(100)]
    f = fleet.early_fingerprint(spark.createDataFrame(rows, "cohort string, signal_id string, s0 double, value double"))
    assert {x["n_early"] for x in f.collect()} == {20}
    w = {x["cohort"]: x for x in fleet.early_warning(f).collect()}
    assert w["c03"]["level"] == "CRITICAL" and w["c03"]["n_outlying"] >= 3 and sum(x["level"] == "CRITICAL" for x in w.values()) == 1


def test_regimes_by_silhouette(spark):
    r = np.random.default_rng(2)
    rows = [(i, float(m + 0.05 * r.normal()), float(2 * m + 0.05 * r.normal())) for i, m in enumerate(np.repeat([0.0, 5.0, 9.0, 20.0], 40))]
    wide = spark.createDataFrame([*rows, (999, None, 1.0)], "id long, a double, b double")
    k, score = regimes.chosen_k(wide, ["a", "b"])
    assert k == 4 and score > 0.9
    got = {x["id"]: x for x in regimes.detect(wide, ["a", "b"]).collect()}
    assert [got[i]["regime_id"] for i in (0, 45, 90, 150, 999)] == [0, 1, 2, 3, -1] and all(0 <= got[i]["regime_confidence"] <= 1 for i in range(160))
    assert regimes.chosen_k(wide.withColumn("a", F.lit(1.0)).withColumn("b", F.lit(2.0)), ["a", "b"]) == (1, 0.0)
    found = regimes.detect(wide, ["a", "b"], 4)
    mixed = found.withColumn("regime_id", F.when(F.col("regime_id") >= 0, 3 - F.col("regime_id")).otherwise(-1))
    back = {x["id"]: x["regime_id"] for x in regimes.align(mixed, regimes.centres(found, ["a", "b"]), ["a", "b"]).collect()}
    assert back == {i: x["regime_id"] for i, x in got.items()}
    assert {x["regime"] for x in regimes.identify(wide.filter("id = 999"), ["a", "b"]).collect()} == {"none|1.0"}


def test_known_statistics_normalise_other_rows(spark):
    train = spark.createDataFrame([("s", i % 2, float(i)) for i in range(100)] + [("s", 2, 1.0)], "signal_id string, regime_id int, value double")
    test = spark.createDataFrame([("s", 0, 49.0), ("s", 7, 50.0)], "signal_id string, regime_id int, value double")
    z = {x["regime_id"]: x["z"] for x in regimes.normalise(test, known=regimes.statistics(train)).collect()}
    whole = np.array([*range(100), 1.0])
    assert abs(z[0]) < 1e-9 and abs(z[7] - (50 - whole.mean()) / whole.std(ddof=1)) < 1e-9
    assert abs(regimes.centred(train).agg(F.sum("residual")).first()[0]) < 1e-9


@pytest.fixture(scope="module")
def cycles(spark):
    r, rows = np.random.default_rng(5), []
    for u in range(15):
        life = int(r.integers(60, 140))
        rows += [(u, c, float((c / life) ** 2 + 0.03 * r.normal()), float(r.normal())) for c in range(1, life + 1)]
    return learning.with_life(spark.createDataFrame(rows, "unit long, cycle long, wear double, noise double"), cap=60)


def test_features_look_backwards(spark, cycles):
    full = {(x["unit"], x["cycle"]): x for x in learning.cycle_features(cycles, ["wear"]).collect()}
    cut = learning.cycle_features(cycles.filter("cycle <= 40"), ["wear"]).collect()
    assert all(full[x["unit"], x["cycle"]] == x for x in cut) and full[0, 1]["rul"] == 60.0
    g = spark.createDataFrame([(0, 10, 1.0), (0, 20, 2.0)], "unit long, cycle long, dim double")
    w = {x["cycle"]: x["dim"] for x in learning.with_geometry(cycles.filter("unit = 0"), g).collect()}
    assert (w[9], w[10], w[19], w[20], w[50]) == (None, 1.0, 1.0, 2.0, 2.0)


def test_scores_and_folds(spark, cycles):
    p = spark.createDataFrame([(10.0, 20.0), (20.0, 10.0), (5.0, 5.0)], "prediction double, rul double")
    s = learning.scores(p)
    assert abs(s["phm08"] - (math.exp(10 / 13) - 1 + math.exp(1.0) - 1)) < 1e-9 and abs(s["rmse"] - math.sqrt(200 / 3)) < 1e-9 and abs(s["mae"] - 20 / 3) < 1e-9
    by = learning.folds(cycles).groupBy("unit").agg(F.count_distinct("fold").alias("n"))
    assert by.filter("n > 1").isEmpty()
    rows = learning.cycle_features(cycles, ["wear", "noise"], (10,)).cache()
    found = learning.ablation(rows, {"noise": ["noise"], "wear": ["wear", "wear_mean_10", "wear_slope_10"]}, n=3, kind="forest", trees=15)
    assert found[1]["rmse"] < found[0]["rmse"] < 25 and found[1]["n_features"] == 4 and found[0]["n"] == rows.count()
    fitted = learning.model(["noise", "wear_mean_10"], trees=5).fit(rows)
    assert learning.importances(fitted, ["noise", "wear_mean_10"])[0][0] == "wear_mean_10" and learning.last_cycles(fitted.transform(rows)).count() == 15
