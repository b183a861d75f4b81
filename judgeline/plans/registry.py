"""Registered queries and, where SQL can say the same, the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from judgeline.plans.sqlparts import with_parts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, tuple[str, str]] = {}


def query(name: str, parts: str = "", sql: str | None = None):
    """Decorator: register a query under ``name`` with its SQL (built on the named parts)."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = (parts, sql)
        return fn

    return add


def oracle() -> dict[str, str]:
    return {name: with_parts(parts, sql) for name, (parts, sql) in _SQL.items()}
