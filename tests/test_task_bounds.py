"""Tasks of co-visitation and suggestion hold a bounded number of rows, with the same results."""

from __future__ import annotations

import re
from collections import Counter

import pytest

from sessionloom.operators import candidates as ca
from sessionloom.operators import covisitation as cv
from sessionloom.sources import interactions
from tests.conftest import same


def partitions(df, keys: str) -> set[int]:
    """The partition counts of the plan's shuffles by these columns."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return {int(n) for n in re.findall(rf"hashpartitioning\({keys}, (\d+)\)", plan)}


def by_hand(rows, rule, types) -> dict:
    """The newest pair of each two items inside each session's window, without Spark."""
    sessions: dict = {}
    for session, aid, ts, type_, event in rows:
        if types is None or type_ in types:
            sessions.setdefault(session, []).append((ts, event, aid, type_))
    found: dict = {}
    for session, events in sessions.items():
        tail = sorted(events, key=lambda e: e[:2], reverse=True)[:rule.tail]
        for x in tail:
            for y in tail:
                if None not in (x[2], y[2]) and x[2] != y[2] and abs(x[0] - y[0]) < rule.window:
                    key, new = (session, x[2], y[2]), (x[0], y[0], x[1], y[1], y[3])
                    found[key] = max(found.get(key, new), new)
    return found


@pytest.fixture
def odd(spark):
    """Null sessions and items, repeats of whole rows, one long session, one second for many events."""
    rows = [(s if s else None, None if (s * k) % 13 == 5 else (k * k + s) % 17, 1_700_000_000 + (k // 3) * 20_000 * (1 + s % 3), (k + s) % 3, 100 * s + k)
            for s in range(9) for k in range(14)]
    rows += [(50, k % 23, 1_700_000_000 + k // 40, k % 3, 5_000 + k) for k in range(200)]
    rows += rows[20:40]
    return rows, spark.createDataFrame(rows, "session long, aid int, ts long, type int, event_id long").repartition(3)


@pytest.mark.parametrize("name", list(cv.RULES))
@pytest.mark.parametrize("hot_rows", [100, 10_000])
def test_pairs_are_those_found_by_hand(odd, name, hot_rows):
    rows, events = odd
    rule = cv.RULES[name]()
    found = cv.session_pairs(events, rule, hot_rows=hot_rows).collect()
    expected = by_hand(rows, rule, rule.types)
    assert len(found) == len(expected) > 100
    for r in found:
        ts_x, ts_y, _, _, y_type = expected[(r.session, r.aid_x, r.aid_y)]
        assert (r.x_ts, r.y_ts, r.y_type) == (ts_x, ts_y, y_type)


@pytest.mark.parametrize("name", list(cv.RULES))
def test_pairs_of_more_events_take_more_tasks(odd, events, name, monkeypatch):
    for frame in (odd[1], events):
        whole = cv.covisitation(frame, name, 4)
        assert not partitions(whole, r"_part#\d+")  # one task has no hash
        rule = cv.RULES[name]()
        kept = frame if rule.types is None else frame.filter(frame["type"].isin(*rule.types))
        sizes = Counter(r["session"] for r in kept.collect())
        possible = sum(min(n, 30) * (min(n, 30) - 1) for n in sizes.values())
        with monkeypatch.context() as m:
            m.setattr(cv, "TASK_PAIRS", 800)
            cut = cv.covisitation(frame, name, 4, hot_rows=50)
            assert partitions(cut, r"_part#\d+") == partitions(cut, r"_cell#\d+") == partitions(cut, r"aid_x#\d+") == {-(-possible // 800)}
            same(whole, cut)


def test_votes_of_more_events_take_more_tasks(events, monkeypatch):
    tables = {n: ca.matrix_neighbours(cv.covisitation(events, n, 10)) for n in cv.RULES}
    spec = ca.carts_spec(8, 5, 5).only(*tables)
    whole = ca.suggest(events, tables, spec)
    monkeypatch.setattr(ca, "TASK_MARKS", 1000)
    cut = ca.suggest(events, tables, spec)
    assert -(-events.count() * (1 + 5 * 5) // 1000) in partitions(cut, r"session#\d+L?, part#\d+")
    same(whole, cut)


def test_join_of_more_order_lines_takes_more_tasks(spark, monkeypatch):
    lines = spark.createDataFrame([(k // 3 if k % 7 else None, k, k % 3, k % 5, "NRA"[k % 3]) for k in range(60)],
                                  "l_orderkey long, l_partkey long, l_linenumber int, l_suppkey long, l_returnflag string")
    orders = spark.sql("SELECT id AS o_orderkey, id % 4 AS o_custkey, timestamp_seconds(id * 90000) AS o_orderdate FROM range(18)")
    whole = interactions.from_order_lines(lines, orders)
    monkeypatch.setattr(interactions, "TASK_LINES", 8)
    cut = interactions.from_order_lines(lines, orders)
    assert partitions(cut, r"l_orderkey#\d+L?") == {8} and not partitions(whole, r"l_orderkey#\d+L?") & {8}
    same(whole, cut)
