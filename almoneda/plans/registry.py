"""Queries by name, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with the DuckDB SQL for its rows where SQL can say it."""

    def register(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


from almoneda.plans import browse, facet, graph, ingest, scalar, search, sources, state, texts  # noqa: E402, F401  they register their queries
