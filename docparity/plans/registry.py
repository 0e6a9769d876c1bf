"""Where queries register themselves: a name, the Spark plan, and SQL that must give the same rows, if there is such SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def r6(*names: str) -> list[Column]:
    return [F.round(n, 6).alias(n) for n in names]


def r6_sql(*names: str) -> str:
    return ", ".join(f'round("{n}", 6) AS "{n}"' for n in names)
