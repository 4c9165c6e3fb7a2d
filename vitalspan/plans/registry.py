"""Registry of named queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalspan.plans.views import with_views

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    run: Query
    sql: str | None
    covers: str
    raw: str | None = None  # the SQL without the views it reads


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query; ``covers`` lists the operator ids of the blueprint it exercises."""
    def register(fn: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(name)
        ENTRIES[name] = Entry(fn, None if sql is None else with_views(sql), covers, sql)
        return fn
    return register


def r6(x) -> Column:
    """Rounded to six decimals for comparison with the oracle."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6)


def q6(expr: str, alias: str) -> str:
    """The same rounding in SQL, without negative zero."""
    return f"(round({expr}, 6) + 0) AS {alias}"


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def longs(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})
