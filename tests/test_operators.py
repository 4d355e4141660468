import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import engines as E
from tidemark.operators import graph, interp, kernels, regimes, windows
from tidemark.sources import readers
from tidemark.streaming import analyzer


def series(spark, n=300):
    return spark.range(n).selectExpr("'a' as cohort", "cast(id as double) as s0", "explode(array(struct('x' as signal_id, 2e0 * id as value), struct('y' as signal_id, sin(id / 8) as value), struct('z' as signal_id, 5e0 * id as value))) as s").selectExpr("cohort", "s.signal_id", "s0", "cast(s.value as double) as value")


def test_windows_cover_long_signals_once(spark):
    v = windows.signal_vector(series(spark, 5000), names=("rms", "trend")).filter("signal_id = 'x'").toPandas().sort_values("window_index")
    assert v["window_index"].tolist() == list(range((5000 - 64) // 32 + 1))
    assert np.allclose(v["trend_slope"], 2) and np.allclose(v["signal_0_end"] - v["signal_0_start"], 63)


def test_engines_get_their_declared_windows(spark):
    y = np.random.default_rng(4).normal(size=3000)
    rows = [("a", "x", float(i), float(v)) for i, v in enumerate(y)]
    names = ("hurst", "spectral", "lyapunov")
    v = windows.signal_vector(spark.createDataFrame(rows, readers.OBSERVATIONS), names=names).toPandas().sort_values("window_index")
    for i in (0, 5, 62, 63, 91):  # 62 and 63 look back over the border of a segment
        end = 63 + 32 * i
        assert np.allclose(v.iloc[i, 6:].astype(float), E.vector(y[max(0, end - 255) : end + 1], min(end, 255), 1.0, names), equal_nan=True)
    assert (v["hurst_r2"] < 1 - 1e-9).all()


def test_geometry_of_a_line_of_signals(spark):
    v = windows.signal_vector(series(spark), names=("rms", "peak"))
    e = kernels.eigendecomposition(v, ["rms", "peak"])
    g = e.toPandas()
    assert (g["n_signals"] == 3).all() and (g["effective_dim"] < 1.2).all()
    b = kernels.brittleness(e).toPandas().set_index("window_index").loc[g["window_index"]]
    assert np.allclose(b["brittleness"], g["condition_number"] * g["energy_concentration"] / (g["total_variance"] / g["effective_dim"])) and set(b["brittleness_rank"]) <= set(range(1, len(g) + 1))
    moved = kernels.central(e, ["cohort"], "window_index", ["effective_dim"]).toPandas().sort_values("window_index")
    assert np.allclose(moved["effective_dim_velocity"], np.gradient(g.sort_values("window_index")["effective_dim"]))


def test_ftle_uses_whole_segments_and_sums_them_up(spark):
    y = np.random.default_rng(2).normal(size=1300)
    y[:100] = np.sin(np.arange(100) / 8)
    rows = [("a", "x", float(i), float(v)) for i, v in enumerate(y)]
    got = sorted(windows.ftle(spark.createDataFrame(rows, readers.OBSERVATIONS), 630).collect(), key=lambda r: r["segment"])
    want = [E.rosenstein(y[:630])[0], E.rosenstein(y[630:1260])[0]]
    assert np.allclose([r["ftle"] for r in got[:2]], want) and got[2]["ftle"] is None and want[0] != E.rosenstein(y[230:630])[0]
    assert np.allclose([(r["ftle_mean"], r["ftle_std"]) for r in got], (np.mean(want), np.std(want, ddof=1)))


def test_ftle_embeds_by_itself_and_rolls(spark):
    y = [0.3]
    for _ in range(899):
        y.append(3.99 * y[-1] * (1 - y[-1]))
    y = np.array(y)
    obs = spark.createDataFrame([("a", "x", float(i), float(v)) for i, v in enumerate(y)], readers.OBSERVATIONS)
    told = windows.ftle(obs, dim=None, delay=None).first()
    assert told["dim"] == max(2, E.embedding(y, int(E.mi_delay(y)))) and told["delay"] == E.mi_delay(y) and abs(told["ftle"] - E.rosenstein(y, told["dim"], told["delay"])[0]) < 1e-12
    assert abs(windows.ftle(obs, backward=True).first()["ftle"] - E.rosenstein(y[::-1])[0]) < 1e-12
    got = windows.rolling_ftle(obs, window=100, stride=40, segment=250).toPandas().sort_values("window_index")
    want = [E.rosenstein(y[40 * i : 40 * i + 100])[0] for i in range(21)]
    assert list(got["window_index"]) == list(range(21)) and np.allclose(got["ftle"], want) and np.allclose(got["ftle_velocity"].iloc[1:], np.diff(want)) and np.allclose(got["ftle_acceleration"].iloc[2:], np.diff(want, 2))


def test_granger_finds_the_driver(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=500)
    y = np.r_[0, 0, x[:-2]] + 0.1 * r.normal(size=500)
    rows = [("a", s, float(i), float(v)) for s, z in (("x", x), ("y", y)) for i, v in enumerate(z)]
    got = {r["source"]: r["f_statistic"] for r in windows.granger(spark.createDataFrame(rows, readers.OBSERVATIONS)).collect()}
    assert got["x"] > 100 > got["y"]


def test_granger_drops_missing_values_pair_by_pair_and_picks_the_lag(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=400)
    y = np.r_[0, 0, 0, x[:-3]] + 0.1 * r.normal(size=400)
    rows = [("a", s, float(i), float(v)) for s, z in (("x", x), ("y", y), ("short", x[:15])) for i, v in enumerate(z)]
    rows += [("a", "sparse", float(i), float(x[i]) if i % 3 else None) for i in range(400)] + [("a", "x", float(2000 + i), float(x[i])) for i in range(60)]
    obs = spark.createDataFrame(rows, readers.OBSERVATIONS)
    got = {(r["block"], r["source"], r["target"]): r for r in windows.granger(obs).collect()}
    assert len(got) == 2 * 4 * 3
    b = got[0, "x", "y"]
    assert (b["n"], b["best_lag"]) == (400, 3) and b["f_statistic"] > 1000 and b["p_value"] < 1e-12
    assert got[0, "y", "x"]["p_value"] > 0.001 and got[0, "x", "sparse"]["n"] == 266
    for k in ((0, "short", "x"), (1, "x", "y")):
        assert got[k]["f_statistic"] is None and got[k]["p_value"] is None and got[k]["best_lag"] == 0
    assert got[0, "short", "x"]["n"] == 15 and got[1, "x", "y"]["n"] == 0
    fit = windows._granger(x, y, 3)
    assert fit[2] == 3 and windows._granger(x, y, 2)[0] < 10


def test_tail_of_the_f_distribution():
    for f, a, b, p in ((4.0, 2, 10, (1 + 0.8) ** -5), (1.0, 7, 7, 0.5), (161.4476387975881, 1, 1, 0.05), (3.0, 2, 2000, (1 + 3 / 1000) ** -1000)):
        assert windows._f_tail(f, a, b) == pytest.approx(p, rel=1e-9)
    assert windows._f_tail(0.0, 3, 9) == 1


def test_rolling_spearman(spark):
    p = spark.range(40).selectExpr("'a' as cohort", "'x' as signal_a", "'y' as signal_b", "cast(id as double) as s0", "cast(id as double) as va", "cast(-id * id as double) as vb")
    assert {round(r["spearman"], 9) for r in windows.rolling_spearman(p).collect()} == {-1.0}


def test_components(spark):
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    e = spark.createDataFrame([(i, i + 1) for i in range(50) if i != 20] + [(60, 60)], "a long, b long")
    got = {r["id"]: r["component"] for r in graph.components(e).collect()}
    assert got == {i: 0 if i <= 20 else 21 for i in range(51)}


def test_regimes(spark):
    w = spark.range(90).selectExpr("id", "cast(id % 3 * 100 as double) as s", "cast(id as double) as t").unionByName(spark.sql("select 99L as id, cast(null as double) as s, 1.0d as t"))
    got = {(r["s"], r["regime_id"]) for r in regimes.detect(w, ["s"]).collect()}
    assert got == {(0.0, 0), (100.0, 1), (200.0, 2), (None, -1)}


def test_asof_and_interpolation(spark):
    left = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("a", 2.5), ("a", 9.0), ("b", 1.0)], "k string, t double")
    right = spark.createDataFrame([("a", 1.0, 10.0), ("a", 3.0, 30.0)], "k string, t double, v double")
    assert {(r["k"], r["t"]): r["v_asof"] for r in interp.asof(left, right, ["k"], "t", "v").collect()} == {("a", 0.0): None, ("a", 1.0): 10, ("a", 2.5): 10, ("a", 9.0): 30, ("b", 1.0): None}
    assert {(r["k"], r["t"]): r["v_at"] for r in interp.interpolate(left, right, ["k"], "t", "v").collect()} == {("a", 0.0): 10, ("a", 1.0): 10, ("a", 2.5): 25, ("a", 9.0): 30, ("b", 1.0): None}


def test_readers(spark, tmp_path):
    (tmp_path / "log.txt").write_text("1 1 0.1 0.2 0.3 5 6\n1 2 0.1 0.2 0.3 7 8\n\n")
    got = readers.run_log(spark, str(tmp_path / "log.txt"), sensors=2).filter("signal_id = 'sensor_2'").orderBy("s0").collect()
    assert [(r["cohort"], r["s0"], r["value"]) for r in got] == [("engine_1", 0, 6), ("engine_1", 1, 8)]
    dirty = spark.createDataFrame([(None, "x", 0.0, float("nan")), ("", "x", 1.0, float("inf")), ("c", "x", 1.0, 2.0), ("c", "x", 1.0, 2.0)], "entity_id string, signal_id string, I double, value double")
    assert sorted((r["cohort"], r["s0"], r["value"] is None) for r in readers.clean(dirty, "dom").collect()) == [("c", 1, False), ("dom", 0, True), ("dom", 1, True)]
    readers.write(readers.clean(dirty, "dom"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    assert readers.markdown(spark.range(1)).startswith("| id |")


def test_formats_converters_and_checks(spark, tmp_path):
    import struct

    (tmp_path / "t.csv").write_text("ts,unit,a,b\n0,u1,1.5,2\n1,u1,2.5,3\n")
    (tmp_path / "log").write_text(" ".join(["1", "1", *["0.5"] * 24]) + "\n")
    assert readers.detect_format(spark, str(tmp_path / "t.csv")) == "csv" and readers.detect_format(spark, str(tmp_path / "log")) == "run_log"
    info = readers.file_info(spark, str(tmp_path / "t.csv"))
    assert info["n_rows"] == 2 and info["numeric"] == ["ts", "a", "b"] and readers.preview(spark, str(tmp_path / "t.csv"), 1)[0]["a"] == 1.5
    assert readers.detect_index(readers.load(spark, str(tmp_path / "t.csv")))[0]["column"] == "ts"
    long_ = readers.wide(readers.load(spark, str(tmp_path / "t.csv")), ["a", "b"], "unit", "ts")
    assert [tuple(r) for r in readers.pivoted(long_, ["a", "b"]).orderBy("s0").collect()] == [("u1", 0.0, 1.5, 2.0), ("u1", 1.0, 2.5, 3.0)]

    class Doubles(readers.Converter):
        pattern = "*.dbl"

        def rows(self, data, name):
            for i, v in enumerate(struct.unpack(f"<{len(data) // 8}d", data)):
                yield name.removesuffix(".dbl"), "x", float(i), v

    (tmp_path / "m.dbl").write_bytes(struct.pack("<3d", 1, 2, 3))
    assert sorted(tuple(r) for r in readers.convert(spark, str(tmp_path), Doubles()).collect()) == [("m", "x", 0.0, 1.0), ("m", "x", 1.0, 2.0), ("m", "x", 2.0, 3.0)]
    o = readers.oscillator(spark, 500)
    assert o.count() == 2000 and {r["signal_id"]: r["faults"] for r in readers.validated(o).collect()}["x"] == []
    bad = spark.createDataFrame([("a", "x", 0.0, 1.0), ("a", "x", 0.0, 1.0), ("a", "x", 1.0, None)], readers.OBSERVATIONS)
    assert readers.validated(bad).collect()[0]["faults"] == ["nulls", "repeated_places", "constant", "short"]


def streamed(spark, frame, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stateful_analyser_and_windows_on_a_stream(spark, tmp_path):
    pts = spark.range(260).select(F.lit("k").alias("key"), F.sin(F.col("id") / 5).alias("a"), F.cos(F.col("id") / 3).alias("b"), F.sin(F.col("id") / 5).alias("c"), F.timestamp_seconds(F.col("id") * 60).alias("ts"))
    pts.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in"))
    got = streamed(spark, analyzer.analyse(stream, "key", ["a", "b"], "ts"), "analysed")
    rows = got.orderBy("n").collect()
    assert [r["n"] for r in rows] == list(range(1, 261))  # a row for each point
    assert rows[8]["effective_dim"] is None and 1.5 < rows[-1]["effective_dim"] <= 2.01 and rows[-1]["stage"] == "full_analysis" and rows[-1]["spectral_entropy"] < 0.5
    assert [r["n"] for r in rows if r["exponent"] is not None] == [200, 250]  # by a counter of its own
    last = analyzer.status(got).collect()[0]
    assert last["n"] == 260 and last["n_rows"] == 260 and analyzer.history(got, 10).count() == 10
    one = streamed(spark, analyzer.analyse(stream, "key", ["a", "c"], "ts"), "collapsed").orderBy("n").collect()
    assert one[20]["raised"] == ["CRITICAL effective_dimension"] and one[20]["alerts"] == ["CRITICAL effective_dimension"] and one[5]["alerts"] == []
    assert analyzer.warnings(1.8, 0.5) == ["WARNING effective_dimension", "WARNING divergence"]
    sent = []
    analyzer.deliver(stream.select("key", "a"), sent.append, str(tmp_path / "sent")).awaitTermination()
    assert len(sent) == 260 and sent[0]["key"] == "k"
    assert streamed(spark, analyzer.windowed(stream, "ts", ["key"], "a"), "hours").count() >= 1


def test_alerts_age(spark, tmp_path):
    flat = [(float(i), 1.0, 1.0) for i in range(20)] + [(1000.0 + i, float(np.sin(i)), float(np.cos(2.7 * i))) for i in range(120)]
    pts = spark.createDataFrame([("k", t, float(a + 0.01 * np.sin(t)), float(b + 0.01 * np.sin(t))) for t, a, b in flat], "key string, t double, a double, b double")
    pts.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = streamed(spark, analyzer.analyse(spark.readStream.schema(pts.schema).parquet(str(tmp_path / "in")), "key", ["a", "b"], "t"), "aged").orderBy("n").collect()
    assert "CRITICAL effective_dimension" in rows[15]["alerts"] and not any("CRITICAL" in a and t["at"] > 1300 for t in rows for a in t["alerts"])


def test_ingest_resumes_from_its_checkpoint(spark, tmp_path):
    schema = "signal_id string, value double"
    new = lambda k: spark.createDataFrame([(f"s{k}", float(k))], schema).write.mode("append").parquet(str(tmp_path / "in"))
    new(1)
    spark.createDataFrame([], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for k in (2, 3):
        analyzer.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
        new(k)
    analyzer.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(r["signal_id"] for r in got.collect()) == ["s1", "s2", "s3"] and "week" in got.columns


def test_partitions_overlap_and_are_numbered_anew(spark):
    a = spark.createDataFrame([("x", float(i), float(i)) for i in range(5)], "k string, s0 double, v double")
    b = spark.createDataFrame([("x", float(i), 10.0 + i) for i in (7, 8)], "k string, s0 double, v double")
    got = analyzer.overlapped(analyzer.reindexed(b, ["k"], "s0"), a, ["k"], "s0", 2)
    assert sorted((r["s0"], r["v"]) for r in got.collect()) == [(-2.0, 3.0), (-1.0, 4.0), (0.0, 17.0), (1.0, 18.0)]


@pytest.mark.parametrize("n, name", [(0, "initializing"), (10, "computing_eigenstructure"), (60, "analyzing_dynamics"), (150, "computing_complexity"), (999, "full_analysis")])
def test_stage(n, name):
    assert analyzer.stage(n) == name


def test_memory_of_the_driver_is_given_back_now_and_then(spark, monkeypatch):
    """A write gives memory back, the next one within SPARE_S seconds does not; a JVM without the command is no error."""
    from tidemark import store

    monkeypatch.setattr(store, "_spared", [-1e9])
    assert store.written(spark.range(3), "spared").count() == 3 and store._spared[0] > 0 and not store.spare(spark)
