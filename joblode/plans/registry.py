"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from joblode.plans.adapters import duck

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and SQL that gives the same rows in DuckDB."""

    def register(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = duck(sql)
        return f

    return register
