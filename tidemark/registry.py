"""All registered queries of the core library and their DuckDB texts."""

from __future__ import annotations

from .operators import queries as operators
from .plans import dag


def _query(name: str):
    def query(spark, sf_dir):
        return dag.run(spark, sf_dir, name)

    query.__name__ = name
    return query


QUERIES: dict = {name: _query(name) for name in dag.VIEWS} | operators.QUERIES
ORACLE: dict[str, str] = {name: dag.text(name, "duckdb") for name in dag.VIEWS} | operators.ORACLE
