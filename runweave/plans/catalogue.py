"""Every registered query with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runweave.sources.fixtures import Fixtures, with_relations

_QUERIES: dict[str, Callable[[Fixtures], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, needs: str = "", recursive: str = ""):
    """Register a query under a name; sql follows the relations it needs."""

    def add(f: Callable[[Fixtures], DataFrame]) -> Callable[[Fixtures], DataFrame]:
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = with_relations(needs, sql, recursive) if needs or recursive else sql
        return f

    return add


def text_time(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return {k: (lambda spark, sf, f=f: f(Fixtures(spark, sf))) for k, f in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)


def _load() -> None:
    from . import event_queries, graph_queries, log_queries, patch_queries, run_queries, scalar_queries, signal_queries, stream_queries  # noqa: F401
