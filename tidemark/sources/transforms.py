"""Public data sets as observations: wide tables by a layout, folders of recordings by features of each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from . import readers


@dataclass(frozen=True)
class Layout:
    """Columns of a wide table: cohort and axis (None: one cohort, rows numbered in the order of `order`), signals (None: all other numeric ones)."""

    cohort: str | None = None
    axis: str | None = None
    signals: tuple[str, ...] | None = None
    order: tuple[str, ...] | None = None


#: Layouts of public data sets.
LAYOUTS = {
    "bearing": Layout("entity_id", "I", ("acc_x", "acc_y")),
    "testbed": Layout("entity_id", "I"),
    "portfolio": Layout(order=("date",)),
    "turbofan": Layout("unit_id", "cycle", tuple(f"sensor_{i}" for i in range(1, 22))),
}
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def transformed(df: DataFrame, layout: Layout) -> DataFrame:
    """Observations of a wide table. Places of a cohort are numbered from 0 in the order of the axis, so that gaps in it close."""
    if missing := [c for c in (layout.cohort, layout.axis, *(layout.signals or ()), *(layout.order or ())) if c and c not in df.columns]:
        raise ValueError(f"the table lacks {', '.join(missing)}")
    kept = {layout.cohort, layout.axis, *(layout.order or ())}
    signals = [*(layout.signals or [c for c, t in df.dtypes if c not in kept and (t in NUMERIC or t.startswith("decimal"))])]
    if not signals:
        raise ValueError("no numeric column is left as a signal")
    return readers.wide(df, signals, layout.cohort, order=[layout.axis] if layout.axis else [*(layout.order or signals)])


FEATURES = ("rms", "peak", "kurtosis", "crest_factor", "spectral_centroid", "hf_energy_ratio")


def recording_features(x: np.ndarray, rate: float, high: float) -> tuple[float, ...]:
    """FEATURES of one channel of a recording; NaN where there is nothing to tell."""
    x = x[np.isfinite(x)]
    if len(x) < 2:
        return (float("nan"),) * len(FEATURES)
    rms, peak, dev = float(np.sqrt((x * x).mean())), float(np.abs(x).max()), x.std()
    p, f = np.abs(np.fft.rfft(x)) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
    kurtosis = float((((x - x.mean()) / dev) ** 4).mean() - 3) if dev > 0 else float("nan")
    total = p.sum()
    return rms, peak, kurtosis, peak / rms if rms > 0 else float("nan"), float(f @ p / total) if total > 0 else float("nan"), float(p[f >= high].sum() / total) if total > 0 else float("nan")


def recordings(spark: SparkSession, folder: str, channels: dict[str, int], pattern: str = "*.csv", rate: float = 25600.0, high: float = 5000.0) -> DataFrame:
    """Observations of a tree folder/cohort/recording: for each recording and channel (name -> column) its FEATURES. The place is the recording's rank in its cohort by name; a file that cannot be read gives nulls."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder).select("path", "content")
    names = [f"{f}_{c}" for c in channels for f in FEATURES]

    def work(frames):
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                *_, cohort, name = path.split("/")
                try:
                    text = bytes(content).decode()
                    data = np.array([[float(v) for v in line.replace(";", ",").split(",")] for line in text.splitlines() if line.strip()])
                    told = [v for c in channels.values() for v in recording_features(data[:, c], rate, high)]
                except (ValueError, IndexError):
                    told = [float("nan")] * len(names)
                rows.append([cohort, name, *told])
            yield pd.DataFrame(rows, columns=["cohort", "recording", *names])

    wide = files.mapInPandas(work, "cohort string, recording string, " + ", ".join(f"`{n}` double" for n in names))
    return readers.wide(wide, names, "cohort", order=["recording"])
