"""Co-visitation matrices: which items are met together in a session, top N per item.

Pairs come from the last 30 events of a session, so a session yields at most 870 pairs whatever
its size. They are found inside the session's row, without a self-join or a sort. Pair weights
are sums of integers and become a weight once at the end, so ranks do not depend on the order of
addition.

A task's rows are bounded: sessions are counted first, and each of the three shuffles (session,
item pair, item) gets as many partitions as its rows ask for. A partition measured in bytes would
hold a hundred times its size in pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom import constants as C
from sessionloom.operators import ordering


@dataclass(frozen=True)
class PairRule:
    """How pairs of one matrix are chosen and weighted.

    ``terms`` maps a name to an integer column over the kept pair (x_ts, y_ts, y_type);
    ``weight`` turns the sums of those terms and the number of pairs ``n`` into the weight.
    """

    window: int
    weight: Callable[[], Column]
    terms: Mapping[str, Callable[[], Column]] = field(default_factory=dict)
    types: tuple[int, ...] | None = None
    tail: int = C.PAIR_TAIL


def clicks_rule(anchors: tuple[int, int] = C.CLICK_ANCHORS) -> PairRule:
    """All events within a day; a pair weighs 1 to 4 by how recent it is."""
    lo, hi = anchors
    return PairRule(
        window=C.CLICK_WINDOW,
        terms={"age": lambda: F.col("x_ts") - lo},
        weight=lambda: F.col("n") + 3.0 * F.col("age") / float(hi - lo),
    )


def cart_orders_rule(type_weights: Mapping[int, float] = C.TYPE_WEIGHTS) -> PairRule:
    """All events within a day; a pair weighs by what was done with the second item."""
    def of_type(t: int) -> Callable[[], Column]:
        return lambda: (F.col("y_type") == t).cast("long")

    def weight() -> Column:
        total = F.lit(0.0)
        for t, w in sorted(type_weights.items()):
            total = total + F.col(f"n_{t}") * float(w)
        return total

    return PairRule(
        window=C.CART_ORDER_WINDOW,
        terms={f"n_{t}": of_type(t) for t in sorted(type_weights)},
        weight=weight,
    )


def buy_to_buy_rule() -> PairRule:
    """Carts and orders within a week; every pair weighs 1."""
    return PairRule(window=C.BUY_WINDOW, types=(1, 2), weight=lambda: F.col("n").cast("double"))


RULES: dict[str, Callable[..., PairRule]] = {
    "clicks": clicks_rule,
    "cart_orders": cart_orders_rule,
    "buy_to_buy": buy_to_buy_rule,
}


#: Rows and possible pairs of a task.
TASK_ROWS, TASK_PAIRS = 250_000, 2_000_000


def session_tail(events: DataFrame, n: int = C.PAIR_TAIL) -> DataFrame:
    """The n newest events of each session, newest first."""
    newest = W.partitionBy("session").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return events.withColumn("tail_pos", F.row_number().over(newest)).filter(F.col("tail_pos") <= n)


def _kept(events: DataFrame, rule: PairRule) -> DataFrame:
    if rule.types is not None:
        events = events.filter(F.col("type").isin(*rule.types))
    return events.select("session", "aid", "ts", "type", "event_id")


def _tasks(sizes: DataFrame, tail: int) -> tuple[int, int]:
    """Partitions that hold about TASK_ROWS events, and TASK_PAIRS pairs if all events lie in the window; the largest session."""
    kept = F.least("n", F.lit(tail))
    rows, pairs, largest = sizes.agg(F.sum("n"), F.sum(kept * (kept - 1)), F.max("n")).first()
    return max(1, -(-(rows or 0) // TASK_ROWS), -(-(pairs or 0) // TASK_PAIRS)), largest or 0


def _session_pairs(events: DataFrame, rule: PairRule, hot_rows: int) -> tuple[DataFrame, int]:
    """The pairs with ``_part``, by which they lie together, and the number of partitions they need.

    The tail of a session above ``hot_rows`` is cut before its shuffle.
    """
    events = _kept(events, rule)
    sizes = ordering.key_sizes(events, ["session"])
    tasks, largest = _tasks(sizes, rule.tail)
    hot = ordering.hot_keys(sizes, ["session"], hot_rows) if largest > hot_rows else None
    if hot is not None:
        keys = hot[0].select("session")
        cut = session_tail(events.join(keys, "session", "left_semi"), rule.tail).drop("tail_pos")
        events = events.join(keys, "session", "left_anti").unionByName(cut)
    part = F.pmod(F.xxhash64("session"), F.lit(16 * tasks)).cast("int")
    dealt = events.withColumn("_part", part).repartition(tasks, "_part")
    newest = W.partitionBy("_part", "session").orderBy(F.col("ts").desc(), F.col("event_id").desc())
    tail = dealt.withColumn("tail_pos", F.row_number().over(newest)).filter(F.col("tail_pos") <= rule.tail)
    lists = tail.groupBy("_part", "session").agg(F.collect_list(F.struct("ts", "event_id", "aid", "type")).alias("t"))

    def met(x: Column) -> Column:
        near = F.filter("t", lambda y: (x["aid"] != y["aid"]) & (F.abs(x["ts"] - y["ts"]) < rule.window))
        return F.transform(near, lambda y: F.struct(
            x["aid"].alias("aid_x"), y["aid"].alias("aid_y"), x["ts"].alias("x_ts"), y["ts"].alias("y_ts"),
            x["event_id"].alias("x_event_id"), y["event_id"].alias("y_event_id"), y["type"].alias("y_type")))

    # In falling order the newest pair of two items is the first one with them.
    listed = lists.select("_part", "session", F.sort_array(F.flatten(F.transform("t", met)), asc=False).alias("p"))
    newest_only = F.filter("p", lambda x, i: (i == 0) | (F.col("p")[i - 1]["aid_x"] != x["aid_x"])
                           | (F.col("p")[i - 1]["aid_y"] != x["aid_y"]))
    pairs = listed.select("_part", "session", F.inline(newest_only))
    return pairs.select("_part", "session", "aid_x", "aid_y", "x_ts", "y_ts", "y_type"), tasks


def session_pairs(events: DataFrame, rule: PairRule, hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """One row per (session, aid_x, aid_y): the newest pair of the two items inside the window.

    Newest means by x's time, then y's time, then their event ids.
    """
    return _session_pairs(events, rule, hot_rows)[0].drop("_part")


def pair_weights(pairs: DataFrame, rule: PairRule) -> DataFrame:
    """Weight of each item pair over all sessions."""
    return (
        pairs.groupBy("aid_x", "aid_y")
        .agg(F.count("*").alias("n"), *[F.sum(c()).alias(name) for name, c in rule.terms.items()])
        .select("aid_x", "aid_y", rule.weight().alias("wgt"))
    )


def top_neighbours(weights: DataFrame, top_n: int) -> DataFrame:
    """The top_n heaviest neighbours of each item; ties go to the smaller item."""
    best = W.partitionBy("aid_x").orderBy(F.col("wgt").desc(), F.col("aid_y"))
    return weights.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_n)


def covisitation(events: DataFrame, rule: PairRule | str, top_n: int, hot_rows: int = C.HOT_ROWS) -> DataFrame:
    """Matrix (aid_x, aid_y, wgt, rank) of a rule, given by name or as a value.

    Sums of pairs are made before and behind the shuffle by pair, and the neighbours are cut before
    and behind the shuffle by item, so neither a frequent pair nor a popular item fills a task.
    """
    if isinstance(rule, str):
        rule = RULES[rule]()
    pairs, tasks = _session_pairs(events, rule, hot_rows)
    own = pairs.groupBy("_part", "aid_x", "aid_y").agg(
        F.count("*").alias("n"), *[F.sum(c()).alias(name) for name, c in rule.terms.items()])
    cell = F.pmod(F.xxhash64("aid_x", "aid_y"), F.lit(16 * tasks)).cast("int")
    met = own.drop("_part").withColumn("_cell", cell).repartition(tasks, "_cell").groupBy("_cell", "aid_x", "aid_y").agg(
        *[F.sum(name).alias(name) for name in ("n", *rule.terms)])
    weights = met.select("_cell", "aid_x", "aid_y", rule.weight().alias("wgt"))
    first = W.partitionBy("_cell", "aid_x").orderBy(F.col("wgt").desc(), F.col("aid_y"))
    near = weights.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= top_n)
    return top_neighbours(near.select("aid_x", "aid_y", "wgt").repartition(tasks, "aid_x"), top_n)
