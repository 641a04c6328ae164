"""The given tables as interactions, labels, vectors, and neighbour tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sessionloom.constants import EVENT_TYPES
from sessionloom.operators import embeddings, metrics
from sessionloom.sources import interactions

DAY, WEEK = 86400, 7 * 86400


@dataclass(frozen=True)
class Dates:
    """Whole days (UTC) around a table's events: those before ``cut`` are known, the last week from ``cut`` on
    is to be predicted, and the test window is the known week before it."""

    start: int
    end: int

    @property
    def cut(self) -> int:
        return self.end - WEEK

    @property
    def test_from(self) -> int:
        return self.cut - WEEK


_DATES: dict[tuple[str, str], Dates] = {}


def dates(spark: SparkSession, d: str) -> Dates:
    """From the first and last event; looked up once per application and folder, so that filters on it reach the scan."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _DATES:
        first, last = events(spark, d).agg(F.min("ts"), F.max("ts")).first()
        _DATES[key] = Dates((first or 0) // DAY * DAY, ((last or 0) // DAY + 1) * DAY)
    return _DATES[key]


def events(spark: SparkSession, d: str) -> DataFrame:
    return interactions.from_event_stream(spark, f"{d}/events.parquet")


def known(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).filter(F.col("ts") < dates(spark, d).cut)


def test(spark: SparkSession, d: str) -> DataFrame:
    at = dates(spark, d)
    return events(spark, d).filter(F.col("ts").between(at.test_from, at.cut - 1))


def labels(spark: SparkSession, d: str) -> DataFrame:
    return metrics.ground_truth(events(spark, d).filter(F.col("ts") >= dates(spark, d).cut), EVENT_TYPES)


def order_lines(spark: SparkSession, d: str) -> DataFrame:
    return interactions.from_order_lines(
        spark.read.parquet(f"{d}/lineitem.parquet"), spark.read.parquet(f"{d}/orders.parquet"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """The given vectors; a vector's number serves as item or session number."""
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def neighbours(spark: SparkSession, d: str, k: int, metric: str, wanted: DataFrame | None = None) -> DataFrame:
    """Neighbours of all vectors, or of those that stand for a ``wanted`` item (aid), among all of them."""
    asked = None if wanted is None else wanted.select(F.col("aid").cast("long").alias("id"))
    return embeddings.nearest_items(vectors(spark, d), k, metric, wanted=asked).select("aid", "neighbor", "rank")


def session_recs(spark: SparkSession, d: str, k: int = 30, wanted: DataFrame | None = None) -> DataFrame:
    """Recommended items for all vectors as sessions, or for those that stand for a ``wanted`` session, out of all vectors."""
    v = vectors(spark, d)
    users = v if wanted is None else v.join(wanted.select(F.col("session").alias("id")).distinct(), "id", "left_semi")
    return embeddings.recommend(users, v, k).select("session", "aid", "rank")


def scores(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet")
