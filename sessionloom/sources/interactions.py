"""Loading interaction events: session, aid, ts (epoch seconds), type (0/1/2), event_id."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sessionloom.constants import EVENT_TYPES
from sessionloom.functions.expressions import epoch_seconds

SCHEMA = T.StructType([
    T.StructField("session", T.LongType()),
    T.StructField("aid", T.IntegerType()),
    T.StructField("ts", T.LongType()),
    T.StructField("type", T.IntegerType()),
    T.StructField("event_id", T.LongType()),
])

# Event names of the click-stream table and the type code each stands for.
STREAM_LABELS = {"view": 0, "click": 0, "signup": 1, "purchase": 2}


def encode_type(name: Column, labels: dict[str, int] = EVENT_TYPES) -> Column:
    """Type code of an event name; null for a name without a code."""
    table = F.create_map(*[F.lit(x) for pair in labels.items() for x in pair])
    return F.try_element_at(table, name).cast("int")


def read_interactions(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """All Parquet parts of one or more segments, with the schema enforced at the scan."""
    parts = [spark.read.schema(SCHEMA).parquet(p) for p in paths]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def from_event_stream(spark: SparkSession, path: str, labels: dict[str, int] = STREAM_LABELS) -> DataFrame:
    """Interactions of a click-stream table whose item number is in a JSON property.

    The label filter reaches the Parquet scan; names outside the map are no interactions.
    """
    raw = spark.read.parquet(path)
    return raw.filter(F.col("event_type").isin(*labels)).select(
        F.col("user_id").cast("long").alias("session"),
        F.get_json_object("props", "$.k").cast("int").alias("aid"),
        epoch_seconds("ts").alias("ts"),
        encode_type(F.col("event_type"), labels).alias("type"),
        F.col("event_id").cast("long").alias("event_id"),
    )


# Return flags of order lines and the type code each stands for.
ORDER_LINE_LABELS = {"N": 0, "R": 1, "A": 2}

#: Order lines that a task joins.
TASK_LINES = 500_000


def from_order_lines(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Interactions of customers with parts: one per order line.

    The tie-break is the struct of keys, since no single column is unique. Lines and orders
    meet on the order key, where every order has few lines, so the join cannot skew. It gets as
    many partitions as the lines ask for, since a task sorts both sides.
    """
    tasks = -(-lines.count() // TASK_LINES)
    if tasks > 1:
        lines, orders = lines.repartition(tasks, "l_orderkey"), orders.repartition(tasks, "o_orderkey")
    return lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).select(
        F.col("o_custkey").alias("session"),
        F.col("l_partkey").cast("int").alias("aid"),
        epoch_seconds("o_orderdate").alias("ts"),
        encode_type(F.col("l_returnflag"), ORDER_LINE_LABELS).alias("type"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("event_id"),
    )
