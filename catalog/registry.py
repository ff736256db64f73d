"""Query registry: a name, a Spark function and, where SQL can say it, the same query in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

DIGITS = 8


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"Query registered twice: {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r8(column: Column | str, alias: str | None = None, digits: int = DIGITS) -> Column:
    """Rounded for comparison between engines that add doubles in different orders."""
    col = F.col(column) if isinstance(column, str) else column
    name = alias or (column if isinstance(column, str) else None)
    rounded = F.round(col, digits)
    return rounded.alias(name) if name else rounded


def long(column: Column | str, alias: str | None = None) -> Column:
    col = F.col(column) if isinstance(column, str) else column
    name = alias or (column if isinstance(column, str) else None)
    return col.cast("long").alias(name) if name else col.cast("long")
