"""Hand-computed frames for the cases where the meaning is easy to get wrong."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import expressions as X
from sessionloom.operators import candidates as ca
from sessionloom.operators import covisitation as cv
from sessionloom.operators import interaction_features as xf
from sessionloom.operators import item_features as af
from sessionloom.operators import metrics as mt
from sessionloom.operators import session_features as sf
from sessionloom.operators import sessions, training

SCHEMA = "session long, aid int, ts long, type int, event_id long"
DAY = 86400
T0 = 1_700_000_000


def frame(spark, rows):
    """Rows (session, aid, ts, type); the event number is the place in the list."""
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA)


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_pair_window_is_strict(spark):
    e = frame(spark, [(1, 10, T0, 0), (1, 11, T0 + DAY, 0), (2, 10, T0, 0), (2, 12, T0 + DAY - 1, 0)])
    pairs = {(r.aid_x, r.aid_y) for r in cv.session_pairs(e, cv.clicks_rule()).collect()}
    assert pairs == {(10, 12), (12, 10)}


def test_newest_pair_decides_the_weight(spark):
    """The second item was clicked, then ordered; the order is the newest pair."""
    e = frame(spark, [(1, 10, T0, 0), (1, 11, T0 + 5, 0), (1, 11, T0 + 9, 2)])
    wgt = as_dict(cv.covisitation(e, cv.cart_orders_rule({0: 1, 1: 5, 2: 2}), 5), "aid_x", "aid_y")
    assert wgt[(10, 11)].wgt == 2.0
    assert wgt[(11, 10)].wgt == 1.0


def test_only_the_newest_thirty_events_pair(spark):
    e = frame(spark, [(1, k, T0 + k, 0) for k in range(40)])
    seen = {r.aid_x for r in cv.session_pairs(e, cv.clicks_rule()).collect()}
    assert seen == set(range(10, 40))


def test_click_weight_grows_with_time(spark):
    lo, hi = T0, T0 + 1000
    e = frame(spark, [(1, 1, lo, 0), (1, 2, hi, 0)])
    wgt = as_dict(cv.covisitation(e, cv.clicks_rule((lo, hi)), 5), "aid_x", "aid_y")
    assert (wgt[(1, 2)].wgt, wgt[(2, 1)].wgt) == (1.0, 4.0)


def test_buys_ignore_clicks(spark):
    e = frame(spark, [(1, 1, T0, 0), (1, 2, T0, 1), (1, 3, T0 + 6 * DAY, 2)])
    assert {(r.aid_x, r.aid_y) for r in cv.covisitation(e, "buy_to_buy", 5).collect()} == {(2, 3), (3, 2)}


def test_visits_split_at_gaps_above_the_limit(spark):
    e = frame(spark, [(1, 1, T0, 0), (1, 1, T0 + 7200, 0), (1, 1, T0 + 7200 + 7201, 0)])
    rows = sorted(sessions.real_sessions(e).collect(), key=lambda r: r.ts)
    assert [r.rs for r in rows] == [0, 0, 1]
    assert {r.num_events for r in rows} == {3}


def test_type_share_of_an_item_first_seen_in_a_cart(spark):
    e = frame(spark, [(1, 7, T0, 1), (2, 7, T0 + 1, 1), (3, 7, T0 + 2, 0), (3, 8, T0 + DAY, 0)])
    row = as_dict(af.item_basic(e), "aid")[(7,)]
    assert row.aid_percent_count_clicks == 0.5
    assert row.aid_percent_count_carts == 0.5
    assert row.aid_percent_count_orders == 0.0
    row = as_dict(af.item_basic(e, intended_shares=True), "aid")[(7,)]
    assert row.aid_percent_count_carts == pytest.approx(2 / 3)


def test_single_event_deviation_and_duration(spark):
    e = frame(spark, [(1, 7, T0, 0), (2, 7, T0 + DAY, 0), (2, 8, T0 + 2 * DAY, 1)])
    row = as_dict(sf.session_basic(e), "session")[(1,)]
    assert (row.session_ts_std, row.session_length_ts) == (0.0, 0.0)
    assert as_dict(af.item_basic(e, last_week=True), "aid")[(8,)].aid_ts_std == -1.0
    times = as_dict(xf.interaction_times(e, "carts"), "session", "aid")[(2, 8)]
    assert (times.carts_first_ts, times.carts_last_ts) == (2 * DAY, 0)


def test_deviation_is_exact_for_close_times(spark):
    """A deviation of one second among times far from the start must not drown in rounding."""
    far = 40 * DAY
    e = frame(spark, [(1, 1, T0, 0), *[(2, 2, T0 + far + k % 3, 0) for k in range(300)]])
    row = as_dict(sf.session_basic(e), "session")[(2,)]
    assert row.session_ts_std == pytest.approx(math.sqrt(200 / 299), rel=1e-12)


def test_first_day_is_monday(spark):
    e = frame(spark, [(1, 1, 1704067200, 0), (1, 1, 1704067200 - 1, 0)])
    rows = {r.ts: (r.wd, r.h, r.d) for r in e.select(
        "ts", X.weekday().alias("wd"), X.hour_of_day().alias("h"), X.day_of_month().alias("d")).collect()}
    assert rows == {1704067200: (0, 0, 1), 1704067199: (6, 23, 31)}


def test_per_type_hours_see_only_the_first_event(spark):
    e = frame(spark, [(1, 5, T0, 0), (1, 5, T0 + 3600, 1), (1, 6, T0 + DAY, 0)])
    row = as_dict(xf.interaction_hours(e), "session", "aid")[(1, 5)]
    assert row.inter_carts_hour_mean == 0.0 and row.inter_clicks_hour_nunique == 1.0
    row = as_dict(xf.interaction_hours(e, intended=True), "session", "aid")[(1, 5)]
    assert row.inter_carts_hour_nunique == 1.0


def test_before_counts_all_pairs_unless_strict(spark):
    e = frame(spark, [(1, 5, T0 + 9, 0), (1, 5, T0, 0), (1, 5, T0, 1), (1, 5, T0 + 3, 1)])
    assert xf.events_before(e, 0, 1).first()["num_0_before_1"] == 4
    assert xf.events_before(e, 0, 1, strict=True).first()["num_0_before_1"] == 1


def test_frame_without_span_gives_zero_rates(spark):
    e = frame(spark, [(1, 5, T0, 0), (2, 5, T0, 1)])
    assert af.item_basic(e).first()["aid_session_count"] == 0.0
    assert xf.interaction_basic(e).first()["num_inter_on_aid_tsw_max"] == 0.0


# Candidates ------------------------------------------------------------------

def table(spark, rows):
    return spark.createDataFrame(rows, "aid int, neighbor int, rank int")


def ranked(df, session):
    rows = sorted((r for r in df.collect() if r.session == session), key=lambda r: r["rank"])
    return [(r.aid, round(r.rec, 6)) for r in rows]


def test_short_history_then_votes_then_popular(spark):
    e = frame(spark, [(1, 1, T0, 0), (1, 2, T0 + 1, 0), (2, 50, T0, 0), (2, 51, T0, 0), (3, 50, T0, 0)])
    tables = {
        "clicks": table(spark, [(1, 9, 1), (1, 8, 2), (2, 9, 1), (2, 1, 2)]),
        "cart_orders": table(spark, [(1, 9, 1), (2, 7, 1)]),
    }
    spec = ca.clicks_spec(7, 5, 5).only("clicks", "cart_orders")
    got = ranked(ca.suggest(e, tables, spec), 1)
    # History newest first; 9 has three of the most votes; then ties in the order of their
    # source, seed and rank; then popular clicks not there yet.
    assert got == [(2, 1.5), (1, 1.5), (9, 1.0), (8, round(1 / 3, 6)), (7, round(1 / 3, 6)), (50, 0.0), (51, 0.0)]


def test_buys_vote_twice_for_carts(spark):
    e = frame(spark, [(1, 1, T0, 0), (1, 2, T0 + 1, 1)])
    tables = {"buy_to_buy": table(spark, [(1, 8, 1), (2, 9, 1)])}
    spec = ca.carts_spec(4, 5, 5).only("buy_to_buy")
    assert ranked(ca.suggest(e, tables, spec), 1) == [(2, 1.5), (1, 1.5), (9, 1.0), (8, 0.5)]


def test_item_without_neighbours_gets_only_popular(spark):
    e = frame(spark, [(1, 1, T0, 0), (2, 3, T0, 0)])
    spec = ca.clicks_spec(5, 5, 5).only("clicks")
    assert ranked(ca.suggest(e, {"clicks": table(spark, [(77, 78, 1)])}, spec), 1) == [(1, 1.5), (3, 0.0)]


def test_long_history_ranks_by_recency_and_type(spark):
    e = frame(spark, [(1, 1, T0, 1), (1, 2, T0 + 1, 0), (1, 3, T0 + 2, 0)])
    spec = ca.clicks_spec(2, 5, 5).only("clicks")
    got = ranked(ca.suggest(e, {"clicks": table(spark, [(1, 9, 1)])}, spec), 1)
    # Weights 2^0.1 - 1, 2^0.55 - 1, 2^1 - 1; the first is a cart and counts five times.
    assert got == [(3, 1.5), (2, 1.5)]
    heavy = ca.clicks_spec(2, 5, 5, type_weights={0: 1.0, 1: 20.0, 2: 1.0}).only("clicks")
    assert ranked(ca.suggest(e, {"clicks": table(spark, [(1, 9, 1)])}, heavy), 1) == [(1, 1.5), (3, 1.5)]


def test_session_recommendations_skip_history(spark):
    e = frame(spark, [(1, 1, T0, 0)])
    recs = spark.createDataFrame([(1, a, r) for r, a in enumerate([1, 20, 21, 22, 23], 1)], "session long, aid int, rank int")
    spec = ca.carts_spec(6, 5, 5).only("clicks", "session_recs")
    got = ranked(ca.suggest(e, {"clicks": table(spark, [(9, 9, 1)])}, spec, recs), 1)
    assert got == [(1, 1.5), (20, 1.0), (21, 1.0), (22, 1.0)]


def test_share_limits_voted_items(spark):
    e = frame(spark, [(1, 1, T0, 0), (2, 60, T0, 0), (2, 61, T0 + 1, 0)])
    tables = {"clicks": table(spark, [(1, 9, 1), (1, 8, 2), (1, 7, 3)])}
    spec = ca.clicks_spec(4, 5, 5, share=0.5).only("clicks")
    assert ranked(ca.suggest(e, tables, spec), 1) == [(1, 1.5), (9, 1.0), (60, 0.0), (61, 0.0)]


# Recall ------------------------------------------------------------------------

def test_recall_counts_unpredicted_sessions_and_caps_the_denominator(spark):
    labels = spark.createDataFrame(
        [(1, "carts", list(range(25))), (2, "carts", [1, 2]), (3, "clicks", [1])],
        "session long, type string, ground_truth array<int>")
    predicted = spark.createDataFrame([(1, list(range(20))), (3, [1])], "session long, labels array<int>")
    row = mt.recall(labels, predicted, "carts").first()
    assert (row.hits, row.truths, row.recall) == (20, 22, pytest.approx(20 / 22))


def test_submission_names_and_order(spark):
    predicted = spark.createDataFrame([(12, [5, 3])], "session long, labels array<int>")
    rows = mt.submission({"clicks": predicted, "orders": predicted}).collect()
    assert [(r.session_type, r.labels) for r in rows] == [("12_clicks", "5 3"), ("12_orders", "5 3")]


# Training ------------------------------------------------------------------------

def test_model_columns():
    names = training.feature_names()
    assert len(names) == len(set(names)) == 165


def test_rank_weight_ends(spark):
    df = spark.createDataFrame([(1,), (60,)], "rank int").select(X.rank_weight(F.col("rank"), 60).alias("w"))
    assert [round(r.w, 9) for r in df.collect()] == [1.0, round(math.sqrt(2) - 1, 9)]


def test_folds_keep_sessions_whole_and_even(events):
    folds = training.fold_deal(events, 5).collect()
    sizes = [sum(r.fold == f for r in folds) for f in range(5)]
    assert len(folds) == len({r.session for r in folds}) and max(sizes) - min(sizes) <= 1


def test_sampling_keeps_all_positives(events):
    rows = events.withColumn("target", (F.col("type") == 2).cast("int"))
    kept = training.sample_negatives(rows, 0.3)
    assert kept.filter("target = 1").count() == rows.filter("target = 1").count()
    assert 0 < kept.filter("target = 0").count() < rows.filter("target = 0").count()
