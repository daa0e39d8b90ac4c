"""The register of queries, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with SQL of the same meaning for DuckDB."""

    def register(f: Query) -> Query:
        if f.__name__ in _queries:
            raise ValueError(f"two queries are called {f.__name__}")
        _queries[f.__name__] = f
        if sql is not None:
            _sql[f.__name__] = sql
        return f

    return register


def _load() -> None:
    from yieldloom.plans import catalog, inputs, reports, stores  # noqa: F401 (they register their queries)


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)


def pct(part: str, base: str, digits: int = 2) -> str:
    scale = 10**digits
    return f"CASE WHEN ({base}) > 0 THEN CAST(((CAST({part} AS BIGINT)) * {200 * scale} + CAST({base} AS BIGINT)) // (2 * CAST({base} AS BIGINT)) AS DOUBLE) / {scale} ELSE 0.0 END"


def big(expression: str) -> str:
    return f"CAST({expression} AS BIGINT)"


def n(condition: str) -> str:
    return f"CAST(count(*) FILTER (WHERE {condition}) AS BIGINT)"
