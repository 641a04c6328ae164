"""Folds by size and by label against dealing one after the other."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from sessionloom.functions import expressions as X
from sessionloom.operators import stratify as st
from sessionloom.operators import training as tr


@given(hs.lists(hs.integers(-50, 50), min_size=1, max_size=7), hs.integers(1, 9), hs.integers(0, 60))
def test_shares_are_those_of_one_after_the_other(loads, size, count):
    want, now = [0] * len(loads), list(loads)
    for _ in range(count):
        i = now.index(min(now))
        now[i] += size
        want[i] += 1
    assert tr.shares_of(loads, size, count) == want


@pytest.mark.parametrize("quotas", [[3, 3, 3], [9, 1], [0, 5, 2, 0], [7], [1, 0, 0, 90], [10**9, 3 * 10**9]])
def test_places_meet_quotas_evenly(spark, quotas):
    n = sum(quotas)
    bin_ = tr.evenly(F.col("id"), [F.lit(q) for q in quotas], F.lit(n))
    if n > 1000:  # large numbers stay exact: a stretch far inside has its share up to one
        got = Counter(r["b"] for r in spark.range(n - 4001, n - 1).select(bin_.alias("b")).collect())
        assert abs(got[0] - 1000) <= 1
        return
    got = [r["b"] for r in spark.range(n).orderBy("id").select(bin_.alias("b")).collect()]
    assert [got.count(k) for k in range(len(quotas))] == quotas
    for at in range(0, n - n // 3):  # any third holds about a third of each bin
        for k, q in enumerate(quotas):
            assert abs(got[at:at + n // 3].count(k) - q * (n // 3) / n) <= len(quotas)


def greedy(sizes, folds):
    loads, out = [0] * folds, Counter()
    for s in sorted(sizes, reverse=True):
        f = loads.index(min(loads))
        loads[f] += s
        out[(f, s)] += 1
    return out


@pytest.mark.parametrize("folds,hot", [(5, 10**6), (3, 20), (1, 50)])
def test_folds_by_size(spark, folds, hot):
    rng = np.random.default_rng(folds)
    sizes = [int(x) for x in rng.zipf(1.6, 300) % 200 + 1] + [500, 500, 1] * 3
    rows = [(i,) for i, s in enumerate(sizes) for _ in range(s)]
    got = tr.fold_by_size(spark.createDataFrame(rows, "session long").repartition(3), folds, hot).collect()
    assert {r["session"]: r["size"] for r in got} == dict(enumerate(sizes)) and len(got) == len(sizes)
    assert Counter((r["fold"], r["size"]) for r in got) == greedy(sizes, folds)


def dealt_by_hand(rows, labels, weights, order):
    """id -> fold: rarest label first, its rows one after the other in the order of label vectors."""
    whole, fold = sum(weights), {}
    left = list(labels)
    while True:
        waiting = {c: [i for i in rows if i not in fold and rows[i][c]] for c in left}
        left = [c for c in left if waiting[c]]
        label = min(left, key=lambda c: (len(waiting[c]), labels.index(c)), default=None)
        mine = waiting[label] if label else [i for i in rows if i not in fold]
        held = [i for i in rows if not label or rows[i][label]]
        loads = [whole * sum(fold.get(i) == f for i in held) - len(held) * w for f, w in enumerate(weights)]
        quotas = [0] * len(weights)
        for _ in mine:
            f = loads.index(min(loads))
            loads[f] += whole
            quotas[f] += 1
        mine.sort(key=lambda i: ([rows[i][c] for c in labels], order[i], i))
        for pos, i in enumerate(mine):
            count, p = len(mine), pos
            for f, q in enumerate(quotas):
                before, until = -(-p * q // count) if count else 0, -(-(p + 1) * q // count) if count else 0
                if until > before or f == len(quotas) - 1:
                    fold[i] = f
                    break
                p, count = p - before, count - q
        if label is None:
            return fold


@pytest.fixture(scope="module")
def labelled(spark):
    """Eight labels of falling frequency: most vectors are unique; some rows have no label."""
    rng = np.random.default_rng(3)
    rows = {i: {f"m{k}": int(rng.random() < 0.6 / (1 + k / 4)) for k in range(8)} for i in range(400)}
    for i in range(0, 400, 29):
        rows[i] = dict.fromkeys(rows[i], 0)
    frame = spark.createDataFrame([(i, *r.values()) for i, r in rows.items()], "id long, " + ", ".join(f"m{k} int" for k in range(8))).repartition(4)
    order = {r["id"]: r["h"] for r in frame.select("id", X.spread(F.col("id"), 0).alias("h")).collect()}
    return frame, rows, order


LABELS = [f"m{k}" for k in range(8)]


def shares(rows, fold, weights):
    worst = 0.0
    for c in [*LABELS, None]:
        own = [i for i in rows if c is None or rows[i][c]]
        for f, w in enumerate(weights):
            worst = max(worst, abs(sum(fold[i] == f for i in own) - len(own) * w / sum(weights)))
    return worst


@pytest.mark.parametrize("weights,hot", [([1] * 4, 10**6), ([800, 200], 60)])
def test_rounds_by_label(labelled, weights, hot):
    frame, rows, order = labelled
    got = st._dealt_by_label(frame, "id", LABELS, weights, X.spread(F.col("id"), 0), [], hot).collect()
    assert {r["id"]: r["fold"] for r in got} == dealt_by_hand(rows, LABELS, weights, order)


@pytest.mark.parametrize("folds", [5])
def test_folds_by_label(labelled, folds):
    frame, rows, _ = labelled
    got = {r["id"]: r["fold"] for r in st.label_folds(frame, "id", LABELS, folds).collect()}
    by_vector = {r["id"]: r["fold"] for r in st.stratified_folds(frame, "id", LABELS, folds).collect()}
    assert len(got) == len(rows) and shares(rows, got, [1] * folds) < 2 < shares(rows, by_vector, [1] * folds)


def test_repeated_folds_and_split_by_label(labelled):
    frame, rows, _ = labelled
    repeats = defaultdict(dict)
    for r in st.repeated_label_folds(frame, "id", LABELS, 5, 2).collect():
        repeats[r["repeat"]][r["id"]] = r["fold"]
    assert len(repeats) == 2 and repeats[0] != repeats[1]
    assert all(len(x) == 400 and shares(rows, x, [1] * 5) < 2 for x in repeats.values())
    split = {r["id"]: int(r["is_test"]) for r in st.label_split(frame, "id", LABELS, 0.2).collect()}
    assert len(split) == 400 and shares(rows, split, [800, 200]) < 2


def test_no_rows_to_deal(spark):
    none = spark.createDataFrame([], "id long, a int, b int")
    assert st.label_folds(none, "id", ["a", "b"]).count() == 0
    assert tr.fold_by_size(spark.createDataFrame([], "session long")).count() == 0
    nulls = spark.createDataFrame([(1, None, 0), (2, None, None)], "id long, a int, b int")
    assert sorted(r["fold"] for r in st.label_folds(nulls, "id", ["a", "b"], 2).collect()) == [0, 1]
