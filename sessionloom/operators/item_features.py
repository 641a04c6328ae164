"""Item features, keyed by aid.

All of them come from one aggregation in two steps: per (aid, session), then per aid. The
first step is what makes distinct sessions countable without expanding the rows once per
distinct aggregate, and it shrinks a hot item to its sessions before the second shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.constants import EVENT_TYPES, HOT_ROWS
from sessionloom.functions import expressions as X
from sessionloom.operators import ordering

DAYS = range(7)


def per_pair_sums(events: DataFrame, keys: list[str]) -> DataFrame:
    """Sums per (aid, session) that merge into any coarser key. ts is counted from the frame's start."""
    limits = X.bounds(events)
    marked = events.withColumns({"day": X.weekday(), "hour": X.hour_of_day(), "rel": F.col("ts") - limits["lo"]})
    return marked.groupBy(*keys).agg(
        F.count("*").alias("n"),
        *[X.count_where(X.type_is(e)).alias(f"n_{e}") for e in EVENT_TYPES],
        F.sum("type").alias("type_sum"), F.min("type").alias("type_min"), F.max("type").alias("type_max"),
        F.sum("day").alias("day_sum"), F.max("day").alias("day_max"),
        F.sum("hour").alias("hour_sum"), F.max("hour").alias("hour_max"),
        F.sum("rel").alias("ts_sum"), F.min("rel").alias("ts_min"), F.max("rel").alias("ts_max"),
        *X.square_sums("rel", "ts"),
        *[X.count_where(F.col("day") == d).alias(f"day_{d}") for d in DAYS],
        F.min(F.struct("ts", "event_id", "type")).alias("first_event"),
    )


def merge_sums(pairs: DataFrame, key: str, span: Column) -> DataFrame:
    """Per key: the merged sums, how many distinct partners it has (of each event type), and the span."""
    return pairs.withColumn("span", span).groupBy(key).agg(
        F.max("span").alias("span"),
        F.sum("n").alias("n"), F.count("*").alias("uniq"),
        *[F.sum(f"n_{e}").alias(f"n_{e}") for e in EVENT_TYPES],
        *[X.count_where(F.col(f"n_{e}") > 0).alias(f"uniq_{e}") for e in EVENT_TYPES],
        F.sum("type_sum").alias("type_sum"), F.min("type_min").alias("type_min"), F.max("type_max").alias("type_max"),
        F.sum("day_sum").alias("day_sum"), F.max("day_max").alias("day_max"),
        F.sum("hour_sum").alias("hour_sum"), F.max("hour_max").alias("hour_max"),
        F.sum("ts_sum").alias("ts_sum"), F.min("ts_min").alias("ts_min"), F.max("ts_max").alias("ts_max"),
        *X.merged_square_sums("ts"),
        *[F.sum(f"day_{d}").alias(f"day_{d}") for d in DAYS],
        F.min("first_event").alias("first_event"),
    )


def common_columns(key: str, partner: str) -> dict[str, Column]:
    """Columns that item and session features share, by output name."""
    n, span = F.col("n"), F.col("span")
    out = {
        f"{key}_{partner}_count": X.divide(n, span),
        f"{key}_{partner}_nunique": X.divide(F.col("uniq"), span),
        f"{key}_type_mean": F.col("type_sum") / n,
        f"{key}_type_min": F.col("type_min"),
        f"{key}_type_max": F.col("type_max"),
        f"{key}_day_mean": F.col("day_sum") / n,
        f"{key}_day_max": F.col("day_max"),
        f"{key}_hour_mean": F.col("hour_sum") / n,
        f"{key}_hour_max": F.col("hour_max"),
    }
    for d in DAYS:
        out[f"{key}_inter_day_{d}"] = X.divide(F.col(f"day_{d}"), span)
    for e in EVENT_TYPES:
        out[f"{key}_{partner}_count_{e}"] = X.divide(F.col(f"n_{e}"), span)
        out[f"{key}_{partner}_nunique_{e}"] = X.divide(F.col(f"uniq_{e}"), span)
    return out


def time_columns(key: str, missing: float) -> dict[str, Column]:
    n, total = F.col("n"), F.col("ts_sum")
    return {
        f"{key}_ts_min": F.col("ts_min"),
        f"{key}_ts_max": F.col("ts_max"),
        f"{key}_ts_mean": total / n,
        f"{key}_ts_std": F.coalesce(X.deviation(n, total, "ts"), F.lit(missing)),
    }


def type_shares(intended: bool = False) -> dict[str, Column]:
    """aid_percent_count_*.

    The published feature divides by the count of the type of the item's earliest event, and
    counts carts and orders only if that earliest event is one; ``intended`` gives the share
    of each type in all events instead.
    """
    if intended:
        return {f"aid_percent_count_{e}": F.col(f"n_{e}") / F.col("n") for e in EVENT_TYPES}
    first = F.col("first_event")["type"]
    of_first = F.coalesce(*[F.when(first == t, F.col(f"n_{e}")) for e, t in EVENT_TYPES.items()])
    out = {"aid_percent_count_clicks": X.divide(F.col("n_clicks"), of_first)}
    for e in ("carts", "orders"):
        out[f"aid_percent_count_{e}"] = F.when(first == EVENT_TYPES[e], X.divide(F.lit(1), of_first)).otherwise(0.0)
    return out


def item_basic(events: DataFrame, last_week: bool = False, intended_shares: bool = False) -> DataFrame:
    """Counts, weekday histogram, type shares and per-type counts of each item, per day of the frame."""
    columns = common_columns("aid", "session") | type_shares(intended_shares)
    if last_week:
        columns |= time_columns("aid", -1.0)
    sums = merge_sums(per_pair_sums(events, ["aid", "session"]), "aid", X.span_days(X.bounds(events)))
    return sums.select("aid", *[c.cast("double").alias(name) for name, c in columns.items()])


def item_last_week(events: DataFrame) -> DataFrame:
    """item_basic with time columns, over the test window only, prefixed LW_."""
    basic = item_basic(events, last_week=True)
    return basic.select("aid", *[F.col(c).alias(f"LW_{c}") for c in basic.columns if c != "aid"])


def item_window_times(events: DataFrame, date_cut: int) -> DataFrame:
    """Mean, deviation (null for one event), first and last time of events from a date on."""
    recent = events.filter(F.col("ts") >= date_cut)
    limits = X.bounds(recent)
    rel = recent.select("aid", (F.col("ts") - limits["lo"]).alias("rel"))
    sums = rel.groupBy("aid").agg(
        F.count("*").alias("n"), F.sum("rel").alias("s"), F.min("rel").alias("lo"), F.max("rel").alias("hi"),
        *X.square_sums("rel", "ts"))
    return sums.select(
        "aid", (F.col("s") / F.col("n")).alias("aid_LW_ts_mean"),
        X.deviation(F.col("n"), F.col("s"), "ts").alias("aid_LW_ts_std"),
        F.col("lo").alias("aid_LW_ts_min"), F.col("hi").alias("aid_LW_ts_max"))


def pair_gaps(events: DataFrame, prefix: str, with_std: bool, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per event: the gap to the previous event of the same (session, aid), over the pair's time statistics.

    Undefined quotients (the first event, a zero denominator) are 0.
    """
    limits = X.bounds(events)
    rel = events.select("session", "aid", "event_id", (F.col("ts") - limits["lo"]).alias("ts"))
    stats = [F.count("*").alias("n"), F.sum("ts").alias("s"), F.min("ts").alias("lo"), F.max("ts").alias("hi")]
    pairs = rel.groupBy("session", "aid").agg(*stats, *X.square_sums("ts", "sq"))
    pairs = pairs.withColumn("std", X.deviation(F.col("n"), F.col("s"), "sq"))
    gaps = ordering.adjacent(rel, ["session", "aid"], {"prev_ts": "ts"}, -1, hot_rows=hot_rows, sizes=pairs)
    gap = F.col("ts") - F.col("prev_ts")
    out = {f"{prefix}_ts_diff_avg": X.divide(gap, F.col("s") / F.col("n"))}
    if with_std:
        out[f"{prefix}_ts_diff_std"] = X.divide(gap, F.col("std"))
    out[f"{prefix}_ts_diff_min"] = X.divide(gap, F.col("lo"))
    out[f"{prefix}_ts_diff_max"] = X.divide(gap, F.col("hi"))
    joined = ordering.spread_join(
        gaps, pairs, ["session", "aid"], salt_by=["event_id"], hot_rows=hot_rows, sizes=pairs)
    return joined.select("session", "aid", "event_id", *[c.alias(name) for name, c in out.items()])


def first_gap_zero(keyed: DataFrame, prefix: str, with_std: bool) -> DataFrame:
    """The per-key form of pair_gaps.

    It keeps each key's first event, which has no previous one, so every column is 0 by
    definition; models trained with these columns expect them to be present.
    """
    names = ["avg", "std", "min", "max"] if with_std else ["avg", "min", "max"]
    return keyed.withColumns({f"{prefix}_ts_diff_{s}": F.lit(0.0) for s in names})


def item_table(events: DataFrame, since: int) -> DataFrame:
    """All item features: over the whole frame, and over events from ``since`` on (-1 where absent)."""
    basic = first_gap_zero(item_basic(events), "aid", with_std=False)
    recent = item_last_week(events.filter(F.col("ts") >= since))
    return basic.join(recent, "aid", "left").na.fill(-1.0)
