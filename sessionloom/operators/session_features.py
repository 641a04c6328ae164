"""Session features, keyed by session (and the uncalled per-event variants)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.constants import EVENT_TYPES, HOT_ROWS
from sessionloom.functions import expressions as X
from sessionloom.operators import ordering
from sessionloom.operators.item_features import (
    common_columns, first_gap_zero, merge_sums, pair_gaps, per_pair_sums, time_columns)
from sessionloom.sources.tables import cut_lineage


def session_basic(events: DataFrame) -> DataFrame:
    """Counts, times, weekday histogram, type shares and per-type counts of each session."""
    columns = common_columns("session", "aid") | time_columns("session", 0.0)
    columns["session_length_ts"] = X.divide(F.col("ts_max") - F.col("ts_min"), F.col("span"))
    for e in EVENT_TYPES:
        columns[f"session_percent_count_{e}"] = F.col(f"n_{e}") / F.col("n")
    sums = merge_sums(per_pair_sums(events, ["session", "aid"]), "session", X.span_days(X.bounds(events)))
    return sums.select("session", *[c.cast("double").alias(name) for name, c in columns.items()])


def session_gaps(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Row form of the gap features (see pair_gaps)."""
    return pair_gaps(events, "session", with_std=True, hot_rows=hot_rows)


def session_table(events: DataFrame) -> DataFrame:
    return first_gap_zero(session_basic(events), "session", with_std=True)


def first_event_delays(events: DataFrame) -> DataFrame:
    """Time from the first click to the first cart, click to order, cart to order; 0 if one is missing."""
    firsts = events.groupBy("session").agg(
        *[F.min(F.when(F.col("type") == t, F.col("ts"))).alias(name)
          for name, t in (("click", 0), ("cart", 1), ("order", 2))])
    return firsts.select("session", *[
        F.coalesce(F.col(b) - F.col(a), F.lit(0)).cast("double").alias(f"session_{a}_{b}_ts_diff")
        for a, b in (("click", "cart"), ("click", "order"), ("cart", "order"))])


FUNNEL_TYPES = {"click": 0, "cart": 1, "order": 2}


def of_event(events: DataFrame, event: str) -> DataFrame:
    """The events of one type, or all of them for ``all``."""
    return events if event == "all" else events.filter(F.col("type") == FUNNEL_TYPES[event])


def session_funnel(events: DataFrame, event: str, by_span: bool = True, hot_rows: int = HOT_ROWS) -> DataFrame:
    """First and last place of an item among its session's events, over the span T (or the session length)."""
    span = X.span_days(X.bounds(events))
    chosen = of_event(events, event)
    placed = ordering.positions(chosen, ["session"], hot_rows=hot_rows)
    pairs = placed.groupBy("session", "aid").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    if not by_span:
        lengths = chosen.groupBy("session").agg(F.count("*").alias("len"))
        pairs = ordering.spread_join(pairs, lengths, ["session"], salt_by=["aid"], hot_rows=hot_rows)
    norm = span if by_span else F.col("len")
    return pairs.select("session", "aid", *[
        X.divide(F.col(c), norm).alias(f"inter_percent_aid_{event}_{c}_occ") for c in ("first", "last")])


def time_weighted_count(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Largest of (events of the pair + ts / last ts of the session), per (session, aid).

    The pair's count is constant, so only the pair's last time stamp is needed.
    """
    limits = X.bounds(events)
    rel = events.select("session", "aid", (F.col("ts") - limits["lo"]).alias("rel"))
    pairs = rel.groupBy("session", "aid").agg(F.count("*").alias("n"), F.max("rel").alias("last"))
    ends = pairs.groupBy("session").agg(F.max("last").alias("end"), F.count("*").alias("n"))
    met = ordering.spread_join(pairs, ends.drop("n"), ["session"], salt_by=["aid"], hot_rows=hot_rows, sizes=ends)
    return met.select(
        "session", "aid", (F.col("n") + X.divide(F.col("last"), F.col("end"))).alias("num_inter_on_aid_ts_sum"))


def session_clock(events: DataFrame, absolute: bool = False, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Per event: time-of-day statistics and weekday / hour histograms of its session.

    The published feature reads weekday and hour from time stamps counted from the frame's
    first event; ``absolute`` reads them from the real ones.
    """
    limits = X.bounds(events)
    span = X.span_days(limits)
    clock = events if absolute else events.withColumn("ts", F.col("ts") - limits["lo"])
    clock = clock.withColumns({"day": X.weekday(), "hour": X.hour_of_day()}).withColumn(
        "hm", F.col("hour") * 100 + F.expr("(cast(pmod(ts, 3600) div 60 as int) * 100) div 60").cast("int"))
    per_session = clock.withColumn("span", span).groupBy("session").agg(
        F.avg("hm").alias("hm_mean"), F.coalesce(F.stddev_samp("hm"), F.lit(0.0)).alias("hm_std"),
        *[X.divide(X.count_where(F.col("day") == d), F.max("span")).alias(f"day{d}cnt") for d in range(7)],
        *[X.divide(X.count_where(F.col("hour") == h), F.max("span")).alias(f"hour{h}cnt") for h in range(24)],
    )
    rows = clock.select("session", "aid", "ts", "type", "event_id", "day", "hour", "hm")
    return ordering.spread_join(rows, per_session, ["session"], salt_by=["event_id"], hot_rows=hot_rows)


def percentile(df: DataFrame, keys: list[str], value: str, n: float, bins: int = 256, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact n-th percentile per key with linear interpolation, as ``percentile_n``; nulls do not count.

    No row is ever ordered: the values between the bounds of a wanted rank are counted in ``bins`` equal
    stretches, and the stretch that holds the rank, cut to its least and largest value, gives the next
    bounds, until they are one value. A key's two ranks are sought side by side.
    """
    rows = cut_lineage(df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_w")))
    sizes = cut_lineage(rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("_w").alias("_all"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    at = (F.col("_all") - 1) * F.lit(n / 100.0)
    wanted = cut_lineage(sizes.select(*keys, "_lo", "_hi", F.explode(F.array(
        F.struct(F.lit("low").alias("_end"), (F.floor(at) + 1).alias("_rank")),
        F.struct(F.lit("high").alias("_end"), (F.ceil(at) + 1).alias("_rank")))).alias("w")).select(*keys, "_lo", "_hi", "w.*"))
    low, high, v = (F.col(c).cast("double") for c in ("_lo", "_hi", "_v"))
    bin_ = F.least(F.floor((v - low) / (high - low) * bins), F.lit(bins - 1))
    upto = W.partitionBy(*keys, "_end").orderBy("_bin").rowsBetween(W.unboundedPreceding, W.currentRow)
    while True:
        open_ = wanted.filter(F.col("_lo") < F.col("_hi"))
        if open_.isEmpty():
            break
        inside = ordering.spread_join(rows, open_, keys, salt_by=["_v"], hot_rows=hot_rows, sizes=sizes.select(*keys, "n")).filter(
            F.col("_v").between(F.col("_lo"), F.col("_hi")))
        counted = inside.withColumn("_bin", bin_).groupBy(*keys, "_end", "_rank", "_bin").agg(
            F.sum("_w").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).withColumn("_upto", F.sum("_n").over(upto))
        holds = (F.col("_upto") >= F.col("_rank")) & (F.col("_upto") - F.col("_n") < F.col("_rank"))
        found = counted.filter(holds).select(*keys, "_lo", "_hi", "_end", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank"))
        wanted = cut_lineage(wanted.filter(F.col("_lo") == F.col("_hi")).unionByName(found))
    ends = wanted.groupBy(*keys).agg(F.max(F.when(F.col("_end") == "low", F.col("_lo"))).alias("_low"),
                                     F.max(F.when(F.col("_end") == "high", F.col("_lo"))).alias("_high"))
    between = F.col("_low") + (F.col("_high") - F.col("_low")) * (at - F.floor(at))
    return ends.join(sizes.select(*keys, "_all"), keys).select(*keys, between.cast("double").alias(f"percentile_{n:g}"))
