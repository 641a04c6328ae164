"""The registry of queries: a Spark function and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sessionloom.plans.shape import tidy, tidy_sql


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, longs: str = "", doubles: str = "", texts: str = ""):
    """Register a query; its result is tidied, and so is the SQL body's."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        text = None if sql is None else tidy_sql(sql, longs, doubles, texts)
        QUERIES[name] = Query(lambda spark, d: tidy(fn(spark, d)), text)
        return fn

    return add
