"""Interaction features, keyed by (session, aid).

The published features repeat per-event values over each pair and then keep one row. Every
one of them is a function of per-pair sums, per-session maxima and the place of an event in
its session, so one ranked pass and one aggregation per pair give all 72 columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.constants import EVENT_TYPES, HOT_ROWS
from sessionloom.functions import expressions as X
from sessionloom.operators import ordering

# Name in the features -> type code (None: every event).
KINDS: dict[str, int | None] = {"all": None, "click": 0, "cart": 1, "order": 2}


def _of(kind: str) -> Column:
    code = KINDS[kind]
    return F.lit(True) if code is None else F.col("type") == code


def _ranked(events: DataFrame, hot_rows: int) -> DataFrame:
    """Place of each event in its session, among all events and among those of each type."""
    limits = X.bounds(events)
    return ordering.running_counts(
        events.select("session", "aid", "ts", "type", "event_id"),
        ["session"], ordering.ORDER, {f"pos_{k}": _of(k) for k in KINDS}, hot_rows,
    ).withColumn("rel", F.col("ts") - limits["lo"])


def _pair_sums(ranked: DataFrame) -> DataFrame:
    aggs = []
    for k in KINDS:
        rel, pos = F.when(_of(k), F.col("rel")), F.when(_of(k), F.col(f"pos_{k}"))
        aggs += [
            X.count_where(_of(k)).alias(f"n_{k}"),
            F.sum(rel).alias(f"ts_sum_{k}"), F.min(rel).alias(f"ts_min_{k}"), F.max(rel).alias(f"ts_max_{k}"),
            *X.square_sums(f"(case when {_sql(k)} then rel end)", k),
            F.sum(pos).alias(f"pos_sum_{k}"), F.min(pos).alias(f"pos_min_{k}"), F.max(pos).alias(f"pos_max_{k}"),
        ]
    return ranked.groupBy("session", "aid").agg(*aggs)


def _sql(kind: str) -> str:
    return "true" if KINDS[kind] is None else f"type = {KINDS[kind]}"


def interaction_basic(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Time-weighted counts, funnel places and rates of each pair, for all events and per type."""
    pairs = _pair_sums(_ranked(events, hot_rows))
    ends = pairs.groupBy("session").agg(
        F.count("*").alias("n"),
        *[F.max(f"ts_max_{k}").alias(f"end_{k}") for k in KINDS],
        *[F.sum(f"n_{k}").alias(f"len_{k}") for k in KINDS])
    ends = ends.withColumn("span", X.span_days(X.bounds(events)))
    span = F.col("span")
    joined = ordering.spread_join(pairs, ends, ["session"], salt_by=["aid"], hot_rows=hot_rows, sizes=ends)

    out: dict[str, Column] = {}
    for k in KINDS:
        n, total, end = F.col(f"n_{k}"), F.col(f"ts_sum_{k}"), F.col(f"end_{k}")
        tsw = "inter" if k == "all" else k
        seen = n > 0
        weighted = {
            "max": n + X.divide(F.col(f"ts_max_{k}"), end),
            "mean": n + X.divide(X.divide(total, n), end),
            "std": F.when(n > 1, X.divide(X.deviation(n, total, k), end)).otherwise(0.0),
        }
        for stat, value in weighted.items():
            out[f"num_{tsw}_on_aid_tsw_{stat}"] = F.when(seen, X.divide(value, span))
        out[f"inter_aid_{k}_first_occ_ts"] = F.col(f"ts_min_{k}")
        out[f"inter_aid_{k}_last_occ_ts"] = F.col(f"ts_max_{k}")
        out[f"inter_aid_{k}_avg_occ_ts"] = F.try_divide(total, n)
        length = F.col(f"len_{k}")
        out[f"inter_percent_aid_{k}_first_occ"] = F.try_divide(F.col(f"pos_min_{k}"), length)
        out[f"inter_percent_aid_{k}_last_occ"] = F.try_divide(F.col(f"pos_max_{k}"), length)
        out[f"inter_percent_aid_{k}_avg_occ"] = F.try_divide(F.try_divide(F.col(f"pos_sum_{k}"), n), length)
        out[f"inter_percent_{tsw}_aid"] = X.divide(n, span)
    return joined.select("session", "aid", *[
        F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in out.items()])


def interaction_hours(events: DataFrame, intended: bool = False) -> DataFrame:
    """Distinct count (per day of the span), mean, min and max of weekday and hour of each pair.

    The published per-type blocks see only the pair's first event; ``intended`` lets them see
    all events. Distinct days and hours are bits of a mask, which merges map-side.
    """
    marked = events.withColumns({
        "day": X.weekday(), "hour": X.hour_of_day(), "span": X.span_days(X.bounds(events))})
    kinds: dict[str, Column] = {"all": F.lit(True)}
    if intended:
        kinds |= {e: F.col("type") == t for e, t in EVENT_TYPES.items()}
    aggs = [F.min(F.struct("ts", "event_id", "type", "day", "hour")).alias("first"), F.max("span").alias("span")]
    for e, cond in kinds.items():
        for u in ("day", "hour"):
            value = F.when(cond, F.col(u))
            mask = F.when(cond, F.call_function("shiftleft", F.lit(1), F.col(u)))
            aggs += [F.bit_count(F.bit_or(mask)).alias(f"{e}_{u}_nunique"), F.avg(value).alias(f"{e}_{u}_mean"),
                     F.min(value).alias(f"{e}_{u}_min"), F.max(value).alias(f"{e}_{u}_max")]
    pairs = marked.groupBy("session", "aid").agg(*aggs)
    out: dict[str, Column] = {}
    for e in ("all", *EVENT_TYPES):
        for u in ("day", "hour"):
            if e in kinds:
                values = [F.col(f"{e}_{u}_{s}") for s in ("nunique", "mean", "min", "max")]
            else:
                mine = F.col("first")["type"] == EVENT_TYPES[e]
                first = F.when(mine, F.col("first")[u])
                values = [F.when(mine, F.lit(1)), first, first, first]
            values[0] = X.divide(values[0], F.col("span"))
            for s, v in zip(("nunique", "mean", "min", "max"), values):
                out[f"inter_{e}_{u}_{s}"] = F.coalesce(v.cast("double"), F.lit(0.0))
    return pairs.select("session", "aid", *[c.alias(name) for name, c in out.items()])


def interaction_times(events: DataFrame, event: str) -> DataFrame:
    """Flag, first time, duration and mean time of one event type on each pair."""
    limits = X.bounds(events)
    rel = events.withColumn("rel", F.col("ts") - limits["lo"]).filter(F.col("type") == EVENT_TYPES[event])
    return rel.groupBy("session", "aid").agg(
        F.lit(1).alias(f"inter_item_{event}"),
        F.min("rel").alias(f"{event}_first_ts"),
        (F.max("rel") - F.min("rel")).alias(f"{event}_last_ts"),
        F.avg("rel").alias(f"{event}_avg_ts"))


def events_before(events: DataFrame, first: int, second: int, strict: bool = False,
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """Pairs of one event of type ``first`` and one of type ``second`` on the same (session, aid).

    The published count has no order test, so it is the product of two counts. ``strict``
    counts only pairs whose first event is earlier: for each second event, the number of
    earlier first events is a running count, so no pair is ever materialised.
    """
    name = f"num_{first}_before_{second}"
    if not strict:
        both = events.filter(F.col("type").isin(first, second)).groupBy("session", "aid").agg(
            X.count_where(F.col("type") == first).alias("a"), X.count_where(F.col("type") == second).alias("b"))
        return both.filter("a > 0 and b > 0").select("session", "aid", (F.col("a") * F.col("b")).alias(name))
    # At equal times the second type sorts first, so it sees only strictly earlier events.
    marked = events.filter(F.col("type").isin(first, second)).withColumn(
        "_late", (F.col("type") == first).cast("int"))
    seen = ordering.running_counts(
        marked, ["session", "aid"], ["ts", "_late", "event_id"], {"_before": F.col("type") == first}, hot_rows)
    return seen.filter(F.col("type") == second).groupBy("session", "aid").agg(
        F.sum("_before").alias(name)).filter(F.col(name) > 0)


def interaction_table(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """All interaction features of the frame, one row per (session, aid)."""
    return interaction_basic(events, hot_rows).join(interaction_hours(events), ["session", "aid"], "left")
