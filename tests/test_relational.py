import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import relational
from tidemark.sources import transforms


def obs(spark, rows):
    return spark.createDataFrame(rows, "cohort string, signal_id string, s0 double, value double")


def test_reaxis(spark):
    df = obs(spark, [("a", "load", 0.0, 5.0), ("a", "load", 1.0, 3.0), ("a", "load", 2.0, 5.0), ("a", "x", 0.0, 10.0), ("a", "x", 1.0, 11.0), ("a", "x", 2.0, None), (None, "load", 0.0, 1.0), (None, "x", 0.0, 7.0)])
    got = {(r["cohort"], r["signal_id"], r["s0"]): r["value"] for r in relational.reaxis(df, "load").collect()}
    assert got == {("a", "x", 3.0): 11.0, ("a", "x", 5.0): 10.0, ("a", "x", 5.5): None, ("a", "time", 3.0): 1.0, ("a", "time", 5.0): 0.0, ("a", "time", 5.5): 2.0, (None, "x", 1.0): 7.0, (None, "time", 1.0): 0.0}
    for axis, name in (("none", "time"), ("load", "x"), ("x", "time")):
        with pytest.raises(ValueError):
            relational.reaxis(df, axis, name)


def test_groups_and_defaults(spark):
    df = spark.createDataFrame([("a", 1, 2), ("a", 2, 2), ("a", 3, 1), ("a", 4, 1), ("b", 1, None)], "g string, o int, v int")
    assert [tuple(r) for r in relational.mode(df, ["g"], "v").collect()] == [("a", 1, 2)]
    assert {r["g"]: r["first_values"] for r in relational.first_values(df, ["g"], "o", "v", 3).collect()} == {"a": [2, 2, 1], "b": [None]}
    assert sorted((r["g"], r["o"]) for r in relational.tail(df, ["g"], "o", 2).collect()) == [("a", 3), ("a", 4), ("b", 1)]
    assert relational.or_default(df, g="none").count() == 5 and [tuple(r) for r in relational.or_default(df.filter("v > 9"), g="none").collect()] == [("none", None, None)]
    other = spark.createDataFrame([(" A", 10), ("c", 3)], "g string, w int")
    assert {(r["g"], r["w"]) for r in relational.lookup(df, other, "g").collect()} == {("a", 10), ("b", None)} and relational.lookup(df, other, "g").count() == 5
    names = spark.createDataFrame([("inlet_temp_c",), ("shaft_RPM",), ("acc_x",), ("whatever",)], "n string")
    assert [r[0] for r in names.select(relational.unit_by_name(F.col("n"))).collect()] == ["degC", "rpm", "g", None]


def test_layouts_and_recordings(spark, tmp_path):
    wide = spark.createDataFrame([("b1", 5, 1.0, 2.0), ("b1", 9, 3.0, 4.0), ("b2", 1, 5.0, None)], "entity_id string, I int, acc_x double, acc_y double")
    got = {(r["cohort"], r["signal_id"], r["s0"]): r["value"] for r in transforms.transformed(wide, transforms.LAYOUTS["bearing"]).collect()}
    assert got == {("b1", "acc_x", 0.0): 1.0, ("b1", "acc_y", 0.0): 2.0, ("b1", "acc_x", 1.0): 3.0, ("b1", "acc_y", 1.0): 4.0, ("b2", "acc_x", 0.0): 5.0, ("b2", "acc_y", 0.0): None}
    assert transforms.transformed(wide, transforms.LAYOUTS["testbed"]).count() == 6
    with pytest.raises(ValueError):
        transforms.transformed(wide, transforms.LAYOUTS["turbofan"])
    r = np.random.default_rng(0)
    for c in ("one", "two"):
        (tmp_path / c).mkdir()
        for k in range(2):
            (tmp_path / c / f"acc_{k}.csv").write_text("\n".join(f"0{';' if c == 'two' else ','}{v}" for v in (k + 1) * np.sin(np.arange(256) * 0.1) + 0.01 * r.normal(size=256)))
    (tmp_path / "two" / "acc_9.csv").write_text("broken")
    got = {(x["cohort"], x["signal_id"], x["s0"]): x["value"] for x in transforms.recordings(spark, str(tmp_path), {"h": 1}, rate=1000.0, high=100.0).collect()}
    assert len(got) == 5 * 6 and abs(got["one", "rms_h", 0.0] - 0.7) < 0.03 and abs(got["two", "peak_h", 1.0] - 2) < 0.05 and got["two", "rms_h", 2.0] is None
    assert got["one", "hf_energy_ratio_h", 0.0] < 0.01 and 10 < got["one", "spectral_centroid_h", 0.0] < 25
