"""Sessions as sequences: gaps, neighbours, lists, counts, id profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.constants import HOT_ROWS
from sessionloom.functions import expressions as X
from sessionloom.operators import ordering


def real_sessions(events: DataFrame, time_gap_hours: float = 2.0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Number the visits inside each session: a gap above the limit starts the next one.

    Adds day of month, hour, the session's event count and ``rs`` (0 for the first visit).
    """
    sizes = ordering.key_sizes(events, ["session"])
    gapped = ordering.adjacent(events, ["session"], {"prev_ts": "ts"}, -1, hot_rows=hot_rows, sizes=sizes)
    starts = F.coalesce((F.col("ts") - F.col("prev_ts")) / 3600.0 > time_gap_hours, F.lit(False))
    numbered = ordering.running_counts(gapped, ["session"], ordering.ORDER, {"rs": starts}, hot_rows, sizes)
    counted = sizes.select("session", F.col("n").alias("num_events"))
    return (
        ordering.spread_join(numbered, counted, ["session"], salt_by=["event_id"], hot_rows=hot_rows, sizes=sizes)
        .drop("prev_ts")
        .withColumns({"day": X.day_of_month(), "hour": X.hour_of_day()})
    )


def calendar(events: DataFrame) -> DataFrame:
    return events.withColumns({"weekday": X.weekday(), "hour": X.hour_of_day(), "day": X.day_of_month()})


def rebased(events: DataFrame) -> DataFrame:
    """ts counted from the frame's first event, and the frame's span T in days."""
    limits = X.bounds(events)
    return events.withColumns({"ts": F.col("ts") - limits["lo"], "span_days": X.span_days(limits)})


def next_items(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Consecutive item pairs (aid, aid_next) of each session, with the place of the first."""
    return ordering.adjacent(events, ["session"], {"aid_next": "aid"}, 1, hot_rows=hot_rows).filter(
        F.col("aid_next").isNotNull()
    ).select("session", "ts", "event_id", "aid", "aid_next")


def tail_holdout(pairs: DataFrame, holdout: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mark the newest ``holdout`` pairs of the whole frame as validation."""
    newest = pairs.withColumns({"_all": F.lit(0), "_age": -F.col("ts")})
    order = ["_age", "event_id"]
    placed = ordering.positions(newest, ["_all"], order, "_pos", hot_rows)
    return placed.withColumn("is_valid", F.col("_pos") <= holdout).drop("_all", "_age", "_pos")


def item_counts(events: DataFrame, ones: bool = False) -> DataFrame:
    """Events per (session, aid); with ``ones`` every seen pair counts 1."""
    n = F.lit(1).cast("long") if ones else F.count("*")
    return events.groupBy("session", "aid").agg(n.alias("cc"))


def id_profile(events: DataFrame, column: str) -> DataFrame:
    return events.agg(
        F.min(column).cast("long").alias("min_id"),
        F.max(column).cast("long").alias("max_id"),
        F.countDistinct(column).alias("n_ids"),
    )


def offset_ids(counts: DataFrame) -> DataFrame:
    """session and aid counted from their smallest value."""
    low = counts.agg(F.struct(F.min("session").alias("s"), F.min("aid").alias("a")).alias("m")).scalar()
    return counts.withColumns({"session": F.col("session") - low["s"], "aid": F.col("aid") - low["a"]})


def compact_ids(events: DataFrame, column: str = "aid", hot_rows: int = HOT_ROWS) -> DataFrame:
    """Map each id to its place from 0 in the sorted distinct ids."""
    ids = events.select(column).distinct().withColumn("_all", F.lit(0))
    return ordering.positions(ids, ["_all"], [column], "_pos", hot_rows).select(
        column, (F.col("_pos") - 1).alias("compact_id"))


def event_chunks(events: DataFrame, chunk: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Ordered item and type lists of each session, in chunks of bounded length.

    Chunk 0 is the whole list of every session up to ``chunk`` events; longer sessions go on
    in chunks 1, 2, ..., so no row and no task ever holds an unbounded session.
    """
    placed = ordering.positions(events, ["session"], hot_rows=hot_rows).withColumn(
        "chunk", F.expr(f"(pos - 1) div {chunk}"))
    ordered = F.sort_array(F.collect_list(F.struct("pos", "aid", "type")))
    return placed.groupBy("session", "chunk").agg(ordered.alias("e")).select(
        "session", "chunk",
        F.transform("e", lambda x: x["aid"]).alias("aids"),
        F.transform("e", lambda x: x["type"]).alias("types"),
    )


def event_positions(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The long form of the session lists: session, pos from 1, aid, type, one row per event whatever the length."""
    return ordering.positions(events, ["session"], hot_rows=hot_rows).select("session", "pos", "aid", "type")


def list_to_rows(lists: DataFrame, column: str, name: str = "aid") -> DataFrame:
    """One row per list element with its rank from 1."""
    keys = [c for c in lists.columns if c != column]
    return lists.select(*keys, F.posexplode(column).alias("_p", name)).select(
        *keys, (F.col("_p") + 1).alias("rank"), name)


def lists_to_rows(lists: DataFrame, columns: list[str]) -> DataFrame:
    """Explode several lists in lock-step, keeping the rank from 1."""
    keys = [c for c in lists.columns if c not in columns]
    return lists.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("_p", "_z")).select(
        *keys, (F.col("_p") + 1).alias("rank"), *[F.col("_z")[c].alias(c) for c in columns])
