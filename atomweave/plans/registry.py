"""Registered queries and their equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, *views: str, extra: dict[str, str] | None = None):
    """Register a query; ``sql`` is completed with the named views."""
    def register(function):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = fx.with_views(sql, *views, extra=extra)
        return function
    return register


def r(value: Column | str, digits: int = 6) -> Column:
    """Rounded value without negative zero, for comparison between engines."""
    return F.round(F.col(value) if isinstance(value, str) else value, digits) + F.lit(0.0)


def rr(columns: list[str], digits: int = 6) -> list[Column]:
    return [r(c, digits).alias(c) for c in columns]


def q(expression: str, digits: int = 6) -> str:
    """The same rounding in SQL."""
    return f"(round({expression}, {digits}) + 0.0::DOUBLE)"


def qq(columns: list[str], digits: int = 6) -> str:
    return ", ".join(f"{q(c, digits)} AS {c}" for c in columns)
