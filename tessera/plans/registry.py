"""Queries by name, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def with_(*parts: str, recursive: bool = False) -> str:
    """A WITH clause of the given common table expressions, each once."""
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(dict.fromkeys(parts)) + "\n"
