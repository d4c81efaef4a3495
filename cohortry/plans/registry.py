"""Named queries and the plain SQL each one must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

def rounded(expr: str, digits: int = 6) -> str:
    """SQL twin of ``functions.columns.r6``."""
    return f"(round(({expr}) + 1e-10, {digits}) + 0.0)"


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query under ``name`` with its oracle SQL (None: no SQL form)."""

    def wrap(fn: Query) -> Query:
        if name in QUERIES:
            raise KeyError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap
