"""Where the query modules register what `__spark_entry__` exposes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def stamp_col(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def counts_text(counts: str) -> Column:
    """A count map as `TYPE=n,...` in key order, which flat results can hold."""
    entries = F.array_sort(F.map_entries(counts))
    pairs = F.transform(
        entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return F.coalesce(F.array_join(pairs, ","), F.lit(""))


def big(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]
