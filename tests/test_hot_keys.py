"""Cutting hot keys must not change any result."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import candidates as ca
from sessionloom.operators import covisitation as cv
from sessionloom.operators import factors, interaction_features, item_features, ordering, session_features, sessions
from sessionloom.operators import stratify, training
from tests.conftest import same

WHOLE = {
    "real_sessions": lambda e, h: sessions.real_sessions(e, 0.5, hot_rows=h),
    "next_items": lambda e, h: sessions.next_items(e, hot_rows=h),
    "event_chunks": lambda e, h: sessions.event_chunks(e, 7, hot_rows=h),
    "compact_ids": lambda e, h: sessions.compact_ids(e, "event_id", hot_rows=h),
    "tail_holdout": lambda e, h: sessions.tail_holdout(sessions.next_items(e), 9, hot_rows=h),
    "recency_score": lambda e, h: ca.recency_score(e, 0.1, hot_rows=h),
    "pair_gaps": lambda e, h: item_features.pair_gaps(e, "aid", True, hot_rows=h),
    "funnel": lambda e, h: session_features.session_funnel(e, "all", hot_rows=h),
    "clock": lambda e, h: session_features.session_clock(e, hot_rows=h),
    "percentile": lambda e, h: session_features.percentile(e, ["session"], "ts", 40, hot_rows=h),
    "interaction_basic": lambda e, h: interaction_features.interaction_basic(e, hot_rows=h),
    "before": lambda e, h: interaction_features.events_before(e, 0, 1, strict=True, hot_rows=h),
    "fold_deal": lambda e, h: training.fold_deal(e, 3, hot_rows=h),
    "early_stop": lambda e, h: training.early_stop_set(e, 4, hot_rows=h),
    "stratified": lambda e, h: stratify.stratified_folds(e, "event_id", ["type"], 3, hot_rows=h),
    "repeated": lambda e, h: stratify.repeated_folds(e, "event_id", ["type"], 3, 2, hot_rows=h),
    "split": lambda e, h: stratify.stratified_split(e, "event_id", ["type"], 0.3, hot_rows=h),
    "context_pairs": lambda e, h: factors.context_pairs(e, 3, hot_rows=h),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_slices_change_nothing(events, name):
    same(WHOLE[name](events, 5), WHOLE[name](events, 10**9))


def test_positions_match_a_plain_window(spark, events):
    from pyspark.sql import Window as W

    want = events.withColumn("pos", F.row_number().over(W.partitionBy("session").orderBy("ts", "event_id")))
    same(ordering.positions(events, ["session"], hot_rows=3).withColumn("pos", F.col("pos").cast("int")), want)


def test_adjacent_matches_lag(events):
    from pyspark.sql import Window as W

    order = W.partitionBy("session").orderBy("ts", "event_id")
    want = events.withColumn("before", F.lag("aid").over(order))
    same(ordering.adjacent(events, ["session"], {"before": "aid"}, -1, hot_rows=4), want)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_matches_join(events, how):
    right = events.select("aid").distinct().filter("aid < 9").withColumn("x", F.col("aid") * 2)
    got = ordering.spread_join(events, right, ["aid"], how, salt_by=["event_id"], hot_rows=3)
    same(got, events.join(right, "aid", how))


@pytest.mark.parametrize("size", [6, 30])
def test_suggestions(events, size):
    """With 6 candidates most histories are long, with 30 nearly all are short."""
    tables = {n: ca.matrix_neighbours(cv.covisitation(events, n, 10)) for n in cv.RULES}
    spec = ca.carts_spec(size, 8, 4).only(*tables)
    same(ca.suggest(events, tables, spec, hot_rows=4), ca.suggest(events, tables, spec))


def test_a_burst_is_cut_by_rows(spark):
    """One event early, the rest within a second: slices hold about as many rows each."""
    rows = [(1, 5, 0, 0, 0)] + [(1, k % 7, 1_700_000_000, 0, k) for k in range(1, 10_001)]
    events = spark.createDataFrame(rows, "session long, aid int, ts long, type int, event_id long").repartition(6)
    _, hot, _ = ordering._parted(events, ["session"], ordering.ORDER, 100, None)
    sizes = [r["count"] for r in hot.groupBy("_slice").count().collect()]
    assert sum(sizes) == 10_001 and max(sizes) <= 200
    got = ordering.positions(events, ["session"], hot_rows=100).select("event_id", "pos").collect()
    assert all(r["pos"] == r["event_id"] + 1 for r in got)


def test_no_hot_key_is_a_plain_window(events):
    plan = ordering.positions(events, ["session"])._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" not in plan and "Join" not in plan
