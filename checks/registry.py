"""name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    assert name not in QUERIES, name
    QUERIES[name] = fn
    if sql is not None:
        SQL[name] = sql
