"""Queries over the driver's tables and the SQL that they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator that files a query under ``name``, with its SQL if there is any."""

    def add(fn: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return add


def tasks_for(spark: SparkSession, amount: int, each: int) -> int:
    """How many tasks share ``amount`` rows or bytes: the session's shuffle width, or more where a task would have more than ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-amount // each))


def _load() -> None:
    from repolens.plans import code_queries, graph_queries, search_queries, text_queries  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
