"""Query name -> callable, and query name -> the SQL that states its result."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
_MODULES = ("catalogue_queries", "search_queries", "table_queries", "text_queries", "analytics_queries", "ingest_queries")


def query(sql: str | None = None):
    """Register the function under its name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _all() -> None:
    for m in _MODULES:
        import_module(f"{__package__}.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _all()
    return QUERIES


def oracle_sql() -> dict[str, str]:
    _all()
    return SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    _all()
    return QUERIES["hybrid_search"](spark, sf_dir)
