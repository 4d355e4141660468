"""Views as declarative SQL texts that depend on each other.

A view's text refers to other views and base tables as `@name`. `text(name, dialect)` renders a view with everything
below it as common table expressions in dependency order; an unknown name or a cycle is an error at once, so no view
is silently missing. Catalyst inlines the expressions, prunes unused columns down to the scan and reuses exchanges.
The `duckdb` dialect is what the results are checked against.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .. import store

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
VIEWS: dict[str, str] = {}
#: DuckDB texts written apart from the views' own, straight from the definition; the others are rendered from the views.
ORACLES: dict[str, str] = {}

_REF = re.compile(r"@(\w+)")


def view(name: str, sql: str) -> None:
    if name in VIEWS:
        raise ValueError(f"view {name} is defined twice")
    VIEWS[name] = sql.strip()


def oracle(name: str, sql: str) -> None:
    ORACLES[name] = sql.strip()


def order(name: str, texts: dict[str, str] = VIEWS) -> list[str]:
    """The views below a view and itself, each after what it depends on."""
    done: list[str] = []
    open_: set[str] = set()

    def visit(n: str) -> None:
        if n in done or n in TABLES:
            return
        if n in open_:
            raise ValueError(f"view {n} depends on itself")
        if n not in texts:
            raise KeyError(f"no view or table {n}")
        open_.add(n)
        for ref in dict.fromkeys(_REF.findall(texts[n])):
            visit(ref)
        open_.discard(n)
        done.append(n)

    visit(name)
    return done


def translate(sql: str, dialect: str) -> str:
    """The few forms that differ: #list(x, sep) ordered string aggregation, #series(a, b, step, name) rows, #each(a, b, ...) a row for each number, #round(x; digits) a double's rounding.

    DuckDB rounds the product with a power of ten, Spark the shortest decimal; where a half is not a double, e.g. 0.2621435,
    the two go apart, and so would ranks. Spark gets DuckDB's law; a product that would overflow leaves x as it is.
    """
    sql = re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", sql)  # double literals; a decimal one would round quotients
    if dialect == "spark":
        sql = re.sub(r"#list\(([^;]+);\s*('[^']*')\)", r"listagg(distinct \1, \2) within group (order by \1)", sql)
        sql = re.sub(r"#series\(([^;]+);([^;]+);([^;)]+)\)", r"explode(sequence(\1,\2,\3))", sql)
        sql = re.sub(r"#each\(([^)]+)\)", r"explode(array(\1))", sql)
        sql = re.sub(r"#round\(([^;]+); (\d+)\)", r"case when abs(cast(\1 as double)) < 1e290 then round(cast(\1 as double) * 1e\2, 0) / 1e\2 else cast(\1 as double) end", sql)
        return sql.replace("#string", "string").replace("#isnan", "isnan")
    sql = re.sub(r"#list\(([^;]+);\s*('[^']*')\)", r"string_agg(distinct \1, \2 order by \1)", sql)
    sql = re.sub(r"#series\(([^;]+);([^;]+);([^;)]+)\)", r"unnest(generate_series(\1,\2,\3))", sql)
    sql = re.sub(r"#each\(([^)]+)\)", r"unnest([\1])", sql)
    sql = re.sub(r"#round\(([^;]+); (\d+)\)", r"round(cast(\1 as double), \2)", sql)
    return sql.replace("#string", "varchar").replace("#isnan", "isnan")


def text(name: str, dialect: str = "spark", base: str = "{}", given: tuple[str, ...] = ()) -> str:
    """Complete SQL of a view; `base` turns a table's name into what the FROM clause needs. Views in `given` are tables."""
    texts = VIEWS | ORACLES if dialect == "duckdb" else VIEWS
    texts = texts | {n: f"select * from {base.format('given_' + n)}" for n in given}
    names = order(name, texts)
    put = lambda m: m[1] if m[1] in VIEWS else base.format(m[1])
    parts = [f"{n} as (\n{_REF.sub(put, translate(texts[n], dialect))}\n)" for n in names]
    return "with " + ",\n".join(parts) + f"\nselect * from {name}"


#: Views with a row for each signal, pair, window or group, which many others stand on. A session writes each once for a
#: version of the tables; rows of observations are never stored, so filters and columns still reach their scan.
STORED = set(
    "signal_windows cohort_geometry cohort_vector cohort_pairwise ftle_rolling velocity_field breaks signal_features physics baselines v_deviation_scores v_geometry_dynamics v_brittleness "
    "v_derivative_stats v_lagged_correlation v_correlation_matrix v_granger_proxy v_transfer_entropy_proxy v_derivative_correlation v_partial_correlation_proxy v_mutual_info_proxy v_regime_stats v_shannon_entropy v_signal_class v_signal_typology "
    "signal_statistics signal_temporal signal_derivatives typology pairwise_windowed cohort_information_flow v_canary_sequence v_signal_profile v_signal_departure signal_analysis v_first_deviation v_metric_lead_times signal_baselines drift_segments".split()
)


def _made_here():
    """A function made inside another goes to Python workers whole, so they need not find the library."""

    def duckdb_hash(*keys: str | None) -> int | None:
        """The low 48 bits of DuckDB's hash of strings, whose upper bits deal the partitions of its windows into bins; null with a null."""
        if None in keys:
            return None
        mask, by, out = (1 << 64) - 1, 0xD6E8FEB86659FD93, None
        for key in keys:
            b = key.encode()
            h = 0xE17A1465 ^ len(b) * 0xC6A4A7935BD1E995 & mask
            for i in range(0, len(b), 8):
                h = (h ^ int.from_bytes(b[i : i + 8], "little")) * by & mask
            for _ in range(2):
                h = (h ^ h >> 32) * by & mask
            h ^= h >> 32
            out = h if out is None else (out ^ out >> 32) * by & mask ^ h
        return out & (1 << 48) - 1

    return duckdb_hash


duckdb_hash = _made_here()


def run(spark: SparkSession, sf_dir: str, name: str, given: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view over the tables of sf_dir. `given` puts frames in the place of views below it, e.g. the output of a numeric
    kernel in the place of its relational form; then nothing is stored."""
    below = order(name)
    if given is None:
        tables = sorted({t for n in below for t in _REF.findall(VIEWS[n]) if t in TABLES})
        key = (sf_dir, *(store.version(spark, f"{sf_dir}/{t}.parquet") for t in tables))
        given = {n: store.once(spark, key, n, lambda n=n: run(spark, sf_dir, n)) for n in below if n in STORED and n != name}
    texts = VIEWS | {n: f"select * from tm_given_{n}" for n in given}
    names = order(name, texts)
    for n in given.keys() & set(names):
        given[n].createOrReplaceTempView(f"tm_given_{n}")
    used = {t for n in names for t in _REF.findall(texts[n]) if t in TABLES}
    prefix = "tm_" + format(abs(hash(sf_dir)) % 10**8, "08d") + "_"
    for t in used:
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(prefix + t)
    if any("duckdb_hash(" in texts[n] for n in names):
        spark.udf.register("duckdb_hash", duckdb_hash, "long")
    put = lambda m: m[1] if m[1] in texts else prefix + m[1]
    parts = [f"{n} as (\n{_REF.sub(put, translate(texts[n], 'spark'))}\n)" for n in names]
    return spark.sql("with " + ",\n".join(parts) + f"\nselect * from {name}")


# Expressions that mean the same in both dialects.
def ladder(x: str, op: str, *steps: tuple[float, str], other: str) -> str:
    """The label of the first step whose value x compares to; `other` beyond the last and for null."""
    return "case " + " ".join(f"when {x} {op} {v} then '{label}'" for v, label in steps) + f" else '{other}' end"


def first_of(*steps: tuple[str, str], other: str) -> str:
    """The label of the first condition that holds."""
    return "case " + " ".join(f"when {c} then '{label}'" for c, label in steps) + f" else '{other}' end"


def rank(by: str, within: str = "", down: bool = True, digits: int = 6) -> str:
    """rank() by a rounded number, as both engines' sums differ in the last bits; nulls last."""
    part = f"partition by {within} " if within else ""
    return f"rank() over ({part}order by #round({by}; {digits}) {'desc' if down else 'asc'} nulls last)"


def share(by: str, within: str = "", digits: int = 6) -> str:
    """percent_rank() by a rounded number, nulls first."""
    part = f"partition by {within} " if within else ""
    return f"percent_rank() over ({part}order by #round({by}; {digits}) nulls first)"


def div(a: str, b: str) -> str:
    return f"(({a}) / nullif({b}, 0))"


def corr(x: str, y: str) -> str:
    """Pearson correlation, null for a constant side."""
    return f"(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0))"


def quantile(q: float, x: str) -> str:
    return f"percentile_cont({q}) within group (order by {x})"


def r(x: str, digits: int = 6) -> str:
    return f"round(cast({x} as double), {digits})"


def moments(x: str) -> tuple[str, str]:
    """Bias-corrected sample skewness and excess kurtosis of x around its mean, from power sums of the centred x."""
    n, m2, m3, m4 = f"count({x})", f"(sum({x} * {x}) / count({x}))", f"(sum({x} * {x} * {x}) / count({x}))", f"(sum({x} * {x} * {x} * {x}) / count({x}))"
    skew = f"case when {n} > 2 then sqrt(1.0 * {n} * ({n} - 1)) / ({n} - 2) * {m3} / nullif(pow({m2}, 1.5), 0) end"
    kurt = f"case when {n} > 3 then ({n} - 1.0) / (({n} - 2.0) * ({n} - 3.0)) * (({n} + 1.0) * ({m4} / nullif({m2} * {m2}, 0) - 3.0) + 6.0) end"
    return skew, kurt
