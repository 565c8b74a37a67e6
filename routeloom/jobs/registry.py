"""The table of queries: each with a function over the given tables and SQL that must agree with it."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from .session import materialize, small_tasks

Query = Callable[[SparkSession, str], DataFrame]
ALL: dict[str, tuple[Query, str | None]] = {}


def shuffled(fn: Query, write: bool = True) -> Query:
    """``fn`` without Spark's own broadcasts, which would grow with the tables and pass through the driver.

    A result that is still to be joined is written under the same setting, but for those
    (``write``: false) that are too long for it and say how they join.
    """

    @wraps(fn)
    def run(spark: SparkSession, d: str) -> DataFrame:
        with small_tasks(spark, d):
            found = fn(spark, d)
            joins = write and "Join" in found._jdf.queryExecution().analyzed().toString()
            return materialize(found, "result") if joins else found

    return run


def query(name: str, oracle: str | None, write: bool = True):
    def add(fn: Query) -> Query:
        ALL[name] = (shuffled(fn, write), oracle)
        return fn

    return add


def euc(a: str, b: str) -> str:
    return f"CAST(trunc(sqrt(({a}.x - {b}.x) * ({a}.x - {b}.x) + ({a}.y - {b}.y) * ({a}.y - {b}.y)) + 0.5) AS BIGINT)"


def pair_sql(table: str, length: str) -> str:
    return f"pairs AS (SELECT a.id AS id, b.id AS nbr, {length} AS len, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM {table} a JOIN {table} b ON a.id <> b.id)"


KNN = "SELECT id, nbr, len, r AS rank FROM (SELECT id, nbr, len, CAST(row_number() OVER (PARTITION BY id ORDER BY len, nbr) AS INT) AS r FROM pairs) WHERE r <= {k}"
