"""The registry of queries and of the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL if there is one."""

    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _six_places(c: str) -> Column:
    """A double at six places as DuckDB rounds it: the millionfold to a whole number, which alone tells what becomes of a half (0.0628125 times a million is no half)."""
    near = F.round(F.col(c) * 1e6, 0) / 1e6
    return F.when(F.abs(near) < float("inf"), near).otherwise(F.col(c))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_six_places(c).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes])
