"""Neighbour search and fitted models, against brute force and by their properties."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sessionloom.operators import embeddings as em
from sessionloom.operators import factors as fa
from sessionloom.operators import neighbours as nb
from sessionloom.plans.pipelines import SETUPS


def frame(spark, m, ids=None):
    ids = range(len(m)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(x) for x in v]) for i, v in zip(ids, m)], "id long, vec array<double>")


def brute(m, k, cost):
    out = {}
    for i in range(len(m)):
        order = sorted((round(cost(m[i], m[j]), 12), j) for j in range(len(m)) if j != i)
        out[i] = [j for _, j in order[:k]]
    return out


def lists(df):
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r[0], r["rank"])):
        out.setdefault(r[0], []).append(r[1])
    return out


@pytest.fixture(scope="module")
def points():
    """60 points, a third of them copies of one."""
    m = np.random.default_rng(3).normal(size=(60, 5))
    m[20:40] = m[20]
    return m


def euclid(a, b):
    return float(np.sqrt(((a - b) ** 2).sum()))


def angle(a, b):
    return -float((a * b).sum() / np.sqrt((a * a).sum()) / np.sqrt((b * b).sum()))


@pytest.mark.parametrize("metric,cost", [("euclidean", euclid), ("cosine", angle)])
def test_nearest_items_are_exact(spark, points, metric, cost):
    got = lists(em.nearest_items(frame(spark, points), 7, metric, block_rows=16, hot_rows=8))
    assert got == brute(points, 7, cost)


def test_recommendations_skip_seen(spark, points):
    rng = np.random.default_rng(5)
    users, items = rng.normal(size=(9, 5)), points
    seen = [(u, int(i)) for u in range(9) for i in rng.choice(60, 12, replace=False)]
    seen_df = spark.createDataFrame(seen, "session long, aid long")
    got = lists(em.recommend(frame(spark, users), frame(spark, items), 6, seen_df, block_rows=8))
    for u in range(9):
        order = sorted((round(-float((users[u] * items[i]).sum()), 12), i) for i in range(60) if (u, i) not in seen)
        assert got[u] == [i for _, i in order[:6]]


def test_approximate_items_find_most_neighbours(spark):
    m = np.random.default_rng(1).normal(size=(400, 8))
    m[300:350] = m[300]
    exact = brute(m, 10, angle)
    got = lists(em.similar_items(frame(spark, m), 10, trees=24, leaf=50, hot_rows=100))
    found = [len(set(got[i]) & set(exact[i])) / 10 for i in range(400)]
    assert np.mean(found) > 0.8
    assert all(len(got[i]) == 10 for i in range(400))
    assert got[349] == exact[349]


def test_the_shipped_forest_finds_most_neighbours(spark):
    """The parameters of the end-to-end job, with leaves of an eighth of the items, grown in cells by Spark first."""
    setup = SETUPS["0val"]
    m = np.random.default_rng(4).normal(size=(8_200, 32))
    got = em.similar_items(frame(spark, m), 20, setup.trees, setup.leaf, cell_rows=3000).cache()
    assert got.groupBy("aid").count().filter("count = 20").count() == len(m)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    some = list(range(0, len(m), 100))
    mine = lists(got.filter(F.col("aid") % 100 == 0))
    recall = [len(set(mine[i]) & set(np.argsort(-(unit @ unit[i]))[1:21].tolist())) / 20 for i in some]
    assert np.mean(recall) > 0.9


@pytest.mark.parametrize("cell_rows", [10**6, 120, 20])
def test_forests_are_grown_at_every_size(spark, cell_rows):
    """Leaves hold their share, every item has mates enough, and cells are cut by Spark until a task can take them."""
    m = np.random.default_rng(6).normal(size=(500, 6))
    met = nb.forest(frame(spark, m), 10, 4, 30, cell_rows=cell_rows).collect()
    assert len(met) == 4 * 500
    leaves = {}
    for r in met:
        leaves.setdefault((r["tree"], r["cell"], r["leaf"]), []).append(r["id"])
        assert len(r["near"]) == 10 and r["id"] not in [n["neighbor"] for n in r["near"]]
    assert all(11 <= len(x) <= 30 + 10 * (cell_rows < 100) for x in leaves.values())
    assert len(leaves) >= 4 * 17
    cells = nb.cells(frame(spark, m), 4, cell_rows).collect()
    sizes = {}
    for r in cells:
        sizes.setdefault((r["tree"], r["cell"]), []).append(r["id"])
    assert max(map(len, sizes.values())) <= cell_rows and len(cells) == 2000
    with pytest.raises(ValueError):
        em.similar_items(frame(spark, m), 10, leaf=10)


def test_cells_of_hostile_vectors(spark):
    """One-hot vectors, a long line, and a few far points still fall apart into cells."""
    rows = list(np.eye(60)) + [np.r_[i, np.zeros(59)] for i in range(2, 200)] + [np.full(60, 1e6), np.full(60, -1e6)]
    got = nb.cells(frame(spark, np.array(rows)), 2, 16).groupBy("tree", "cell").count().collect()
    assert max(r["count"] for r in got) <= 16 and sum(r["count"] for r in got) == 2 * len(rows)


def test_few_items(spark):
    for n in (0, 1, 3):
        m = np.random.default_rng(n).normal(size=(n, 4))
        some = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id long, vec array<double>")
        for got in (em.similar_items(some, 2, trees=2, leaf=5), em.nearest_items(some, 2), em.nearest_items(some, 2, "cosine")):
            assert sorted(r["aid"] for r in got.collect()) == sorted(i for i in range(n) for _ in range(min(2, n - 1)))
        assert em.recommend(some, some, 2).count() == n * min(n, 2)


def grouped(n=1200, seed=2):
    """Twelve tight groups far from each other."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8)) * 20
    return centres[rng.integers(0, 12, n)] + rng.normal(size=(n, 8)) * 0.1


def blocks_met(met):
    return {(r["q"], r["c"]) for r in met.filter("c is not null").select("q", "c").collect()}


@pytest.mark.parametrize("metric,cost", [("euclidean", euclid), ("cosine", angle)])
def test_far_blocks_are_not_met(spark, metric, cost):
    m = grouped()
    points = frame(spark, m)
    found, met = nb._neighbours(points, 6, metric, 64)
    blocks = met.select("q").distinct().count()
    later = blocks_met(met)
    assert blocks >= 12 and len(later) + nb.FIRST_BLOCKS * blocks < blocks * blocks / 2
    some = range(0, len(m), 40)
    got = lists(em.nearest_items(points, 6, metric, block_rows=64))
    for i in some:
        order = sorted((round(cost(m[i], m[j]), 12), j) for j in range(len(m)) if j != i)
        assert got[i] == [j for _, j in order[:6]]


def test_blocks_of_small_norm_are_not_met(spark):
    """Items of falling norm: exact lists, from fewer blocks than there are; seen items stay out."""
    rng = np.random.default_rng(9)
    users, items = rng.normal(size=(70, 6)), rng.normal(size=(900, 6)) * (np.arange(900, 0, -1)[:, None] / 100) ** 3
    seen = [(u, int(i)) for u in range(70) for i in rng.choice(300, 40, replace=False)]
    bars = spark.createDataFrame(seen, "id long, bar long")
    found, met = nb._recommended(frame(spark, users), frame(spark, items), 5, bars, 32)
    blocks = met.select("q").distinct().count()
    assert len(blocks_met(met)) + nb.FIRST_BLOCKS * blocks < blocks * -(-900 // 32) * 0.7
    got = {}
    for r in found.orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["neighbor"])
    for u in range(70):
        order = sorted((round(-float((users[u] * items[i]).sum()), 12), i) for i in range(900) if (u, i) not in seen)
        assert got[u] == [i for _, i in order[:5]]


def test_pruned_search_equals_all_pairs_of_blocks(spark):
    m = np.random.default_rng(12).normal(size=(300, 5))
    m[7] = 0
    points = frame(spark, m)
    itself = points.select("id", F.col("id").alias("bar"))
    for metric in ("euclidean", "cosine"):
        whole = {(r["id"], r["neighbor"], r["rank"]) for r in em.block_search(points, points, 5, metric, itself, 32).collect()}
        some, _ = nb._neighbours(points, 5, metric, 32)
        assert {(r["id"], r["neighbor"], r["rank"]) for r in some.collect()} == whole


def test_affinity_is_the_dot_product(spark):
    u, v = frame(spark, [[1.0, 2.0]]), frame(spark, [[3.0, 4.0], [5.0, -1.0]])
    pairs = spark.createDataFrame([(0, 0), (0, 1), (7, 1)], "session long, aid long")
    got = {(r.session, r.aid): r.u2i for r in em.affinity(pairs, u, v).collect()}
    assert got == {(0, 0): 11.0, (0, 1): 3.0}


def test_components_are_centred_and_uncorrelated(spark):
    rng = np.random.default_rng(2)
    m = rng.normal(size=(80, 4)) * [5, 2, 1, 0.1] + [10, -3, 0, 1]
    rows = em.principal_components(frame(spark, m), 2).toPandas().sort_values("aid")
    got = rows[["aid_pca_0", "aid_pca_1"]].to_numpy()
    centred = m - m.mean(axis=0)
    values = np.sort(np.linalg.eigvalsh(np.cov(centred.T)))[::-1][:2]
    assert np.allclose(got.mean(axis=0), 0, atol=1e-9)
    assert np.allclose(np.cov(got.T), np.diag(values), atol=1e-8)


# Fitted models -------------------------------------------------------------------

def clustered(spark):
    """Two groups of ten items that only follow items of their own group."""
    rng = np.random.default_rng(0)
    rows = []
    for _ in range(1500):
        g = int(rng.integers(2)) * 10
        a, b = rng.choice(10, 2, replace=False)
        rows.append((g + int(a), g + int(b)))
    return spark.createDataFrame(rows, "aid long, aid_next long")


@pytest.mark.parametrize("blocks", [1, 4])
def test_next_item_vectors_tell_groups_apart(spark, blocks):
    pairs = clustered(spark)
    other = pairs.withColumn("aid_next", F.pmod(F.col("aid_next") + 10, F.lit(20)))
    p = replace(fa.NEXT_ITEM, width=8, epochs=6, blocks=blocks)
    vectors = fa.next_item_factors(pairs, p)
    assert vectors.count() == 20
    assert em.pair_accuracy(pairs, other, vectors).first()["accuracy"] > 0.9


def test_fitting_is_repeatable(spark):
    p = replace(fa.NEXT_ITEM, width=4, epochs=2, blocks=2)
    first, second = (
        {r.id: r.vec for r in fa.next_item_factors(clustered(spark).repartition(n), p).collect()} for n in (2, 5))
    assert first.keys() == second.keys()
    assert all(np.allclose(first[i], second[i]) for i in first)


@pytest.mark.parametrize("blocks", [1, 3])
def test_bpr_ranks_seen_items_first(spark, blocks):
    rng = np.random.default_rng(4)
    rows = sorted({(s, int(i) + 10 * (s % 2)) for s in range(40) for i in rng.choice(10, 5)})
    seen = spark.createDataFrame(rows, "session long, aid long")
    users, items = fa.bpr(seen, replace(fa.BPR, width=8, epochs=10, blocks=blocks))
    got = lists(em.recommend(users, items, 5, seen))
    own = [np.mean([(i >= 10) == bool(s % 2) for i in got[s]]) for s in range(40)]
    assert np.mean(own) > 0.8


def test_every_two_blocks_share_one_task_per_pass(spark):
    blocks = 6
    ids = spark.range(blocks).select(F.col("id").cast("int").alias("b"))
    met = []
    for task_of in fa._rounds(blocks, shared=True):
        tasks: dict[int, list[int]] = {}
        for r in ids.select("b", task_of(F.lit(0), F.col("b")).alias("t")).collect():
            tasks.setdefault(r.t, []).append(r.b)
        met += [tuple(sorted(t)) for t in tasks.values()]
    assert len(met) == len(set(met)) == blocks + blocks * (blocks - 1) // 2
    assert all(len(t) <= 2 for t in met)


def test_word2vec_groups_items_met_together(spark):
    rng = np.random.default_rng(6)
    rows, e = [], 0
    for s in range(120):
        for k in range(12):
            rows.append((s, int(rng.integers(8)) + 8 * (s % 2), 1000 * s + k, 0, e))
            e += 1
    events = spark.createDataFrame(rows, "session long, aid int, ts long, type int, event_id long")
    vectors = fa.word2vec(events, p=replace(fa.WORD2VEC, width=8, epochs=8, blocks=2))
    got = lists(em.nearest_items(vectors, 5, "cosine"))
    assert np.mean([(j >= 8) == (i >= 8) for i, near in got.items() for j in near]) > 0.9


def _plain_ranking(every, past, n_left, a, b, p, moment):
    """The ranking steps, pair by pair in batches, as they are meant."""
    rng = np.random.default_rng((p.seed, *moment))
    seen = set(zip(a.tolist(), b.tolist()))
    steps = np.cumsum(np.bincount(b, minlength=len(every) - n_left) / len(b))
    for _ in range(p.passes):
        order = rng.permutation(len(a))
        for s in range(0, len(order), p.batch):
            some, grad = order[s:s + p.batch], {}
            drawn = np.minimum(np.searchsorted(steps, rng.random(len(some)), side="right"), len(steps) - 1)
            for i, o in zip(some, drawn):
                if (a[i], o) in seen:
                    continue
                u, v, w = a[i], n_left + b[i], n_left + o
                wrong = 1 / (1 + np.exp((every[u] * (every[v] - every[w])).sum()))
                for row, g in ((u, -wrong * (every[v] - every[w])), (v, -wrong * every[u]), (w, wrong * every[u])):
                    grad[row] = grad.get(row, 0) + g
            for row, g in grad.items():
                grad[row] = g + p.regularization * every[row]
            for row, g in grad.items():
                past[row] += g * g
                every[row] -= p.learning_rate * g / np.sqrt(past[row] + 1e-8)
                if row < n_left:
                    every[row, -1] = 1.0
    return every


@pytest.mark.parametrize("sessions,items,share", [(40, 12, 0.4), (6, 50, 0.2), (3, 4, 1.0)])
def test_ranking_steps_are_those_of_the_pairs(sessions, items, share):
    rng = np.random.default_rng(sessions)
    a, b = np.nonzero(rng.random((sessions, items)) < share)
    every = ((rng.random((sessions + items, 7)) - 0.5) * 0.3).astype(np.float32)
    every[:sessions, -1] = 1.0
    vectors = pd.DataFrame({"side": [0] * sessions + [1] * items, "id": [*range(sessions), *range(items)], "block": 0,
                            "vec": list(every), "acc": list(np.zeros_like(every))})
    p = replace(fa.BPR, width=6, passes=3, batch=5)
    got = fa._train_task(vectors, pd.DataFrame({"a": a, "b": b, "n": 1.0}), p, False, (1, 2))
    want = _plain_ranking(every.astype(float), np.zeros(every.shape), sessions, a, b, p, (1, 2))
    assert np.abs(np.stack(got["vec"]) - want).max() < 1e-3


def test_a_ranking_batch_touches_its_own_rows_only():
    """A session without pairs in a batch costs nothing and stays as it is, so batches cost the same in blocks of any size."""
    every = np.full((5, 3), 0.5, np.float32)
    vectors = pd.DataFrame({"side": [0, 0, 0, 1, 1], "id": [1, 2, 3, 1, 2], "block": 0, "vec": list(every), "acc": list(np.zeros((5, 3), np.float32))})
    got = fa._train_task(vectors, pd.DataFrame({"a": [1, 2], "b": [1, 2], "n": 1.0}), replace(fa.BPR, width=2, passes=4), False, (0, 0))
    assert np.stack(got["vec"])[2].tolist() == [0.5, 0.5, 0.5]
    assert np.isfinite(np.stack(got["vec"])).all() and np.stack(got["vec"])[0, -1] == 1.0


@pytest.mark.parametrize("metric,cost", [("euclidean", euclid), ("cosine", angle)])
def test_only_wanted_items_get_lists(spark, points, metric, cost):
    """Among them a copy of others, one repeated, and an id that no vector has."""
    wanted = spark.createDataFrame([(3,), (25,), (25,), (59,), (700,)], "id long")
    got = lists(em.nearest_items(frame(spark, points), 7, metric, block_rows=16, hot_rows=8, wanted=wanted))
    want = brute(points, 7, cost)
    assert got == {i: want[i] for i in (3, 25, 59)}
    assert em.nearest_items(frame(spark, points), 7, metric, wanted=wanted.limit(0)).count() == 0


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot"])
def test_search_below_a_known_cost_measures_few(metric, monkeypatch):
    """Queries with a kth cost, with none yet, and with more than k rows below it find what the whole search finds below it."""
    rng = np.random.default_rng(8)
    q, c = rng.normal(size=(30, 6)), rng.normal(size=(200, 6))
    c[50:90] = c[50]
    bar = (np.array([0, 1]), np.array([3, 50]))
    whole = nb._nearest(np.arange(30), q, np.arange(200), c, 9, metric, bar)
    most = whole.groupby("id")["cost"].nth(3).to_numpy().copy()
    most[5], most[6], most[7] = np.inf, whole["cost"].max() + 1, whole["cost"].min() - 1
    measured, costs = [], nb._costs
    monkeypatch.setattr(nb, "_costs", lambda a, b, m: measured.append(len(a)) or costs(a, b, m))
    some = nb._nearest(np.arange(30), q, np.arange(200), c, 9, metric, bar, most)
    for x in (some, whole):
        x.drop(x.index[x["cost"].to_numpy() > most[x["id"]]], inplace=True)
    assert some.reset_index(drop=True).equals(whole.reset_index(drop=True))
    assert sum(measured) < 30 * 9


def hostile():
    """Tight groups far from the origin, copies, zeros, and numbers that 32 bits do not tell apart or do not hold."""
    rng = np.random.default_rng(21)
    m = rng.normal(size=(260, 6))
    m[:60] = 1000 + rng.normal(size=(60, 6)) * 1e-5
    m[60:110] = -3e4 + rng.normal(size=(50, 6))
    m[110] = 0
    m[111:121] = m[130]
    return m


@pytest.mark.parametrize("metric", ["euclidean", "cosine", "dot"])
@pytest.mark.parametrize("scale", [1.0, 1e18, 1e-22])
def test_groups_of_queries_find_what_all_pairs_find(metric, scale):
    """Block by block, with costs known from the first of them, barred pairs and a merge now and then."""
    rng = np.random.default_rng(22)
    m = hostile() * scale
    who, bar = rng.integers(0, 260, 900), rng.integers(0, 260, 900)
    who, bar = np.concatenate([who, np.arange(260)]), np.concatenate([bar, np.arange(260)])
    ids, k = np.arange(260), 7
    want = nb._nearest(ids, m, ids, m, k, metric, (who, bar))
    told, parts = [], np.array_split(np.arange(260), 4)
    for own in parts:
        mine = np.isin(who, own)
        first = nb._search((own, m[own], who[mine], bar[mine]), (parts[0], m[parts[0]]), k, metric)
        told.append((own, m[own], who[mine], bar[mine], nb._places(own, first["id"]), first["neighbor"].to_numpy(), first["cost"].to_numpy(), [0]))
    group = nb._Group(told, k, metric)
    for name, own in enumerate(parts):
        points = nb._unit(m[own]) if metric == "cosine" else m[own]
        centre = points.mean(0)
        group.meet(name, own, m[own], centre, float(np.sqrt(((points - centre) ** 2).sum(1)).max()) * (1 + 1e-9),
                   float(np.sqrt((points * points).sum(1)).max()) * (1 + 1e-9))
    got = pd.concat(group.result(), ignore_index=True)
    assert got.equals(want.sort_values(["id", "cost", "neighbor"], ignore_index=True))


def test_queries_are_moved_once_however_many_blocks_they_meet(spark, monkeypatch):
    """Vectors without structure: what lies between first and later blocks grows with the vectors, not with pairs of blocks."""
    m = np.random.default_rng(23).normal(size=(1200, 16))
    monkeypatch.setattr(nb, "GROUP_BLOCKS", 3)
    found, met = nb._neighbours(frame(spark, m), 5, "euclidean", 32)
    blocks = met.select("q").distinct().count()
    assert len(blocks_met(met)) > blocks * blocks / 2
    assert met.selectExpr("sum(length(pack))").first()[0] < 1200 * (16 * 8 + 5 * 24 + 24) + blocks * 2000
    got = lists(found.select("id", "neighbor", "rank"))
    assert all(got[i] == x for i, x in brute(m[:], 5, euclid).items())


def test_mates_of_many_trees_are_told_apart_without_comparing_all(spark, monkeypatch):
    """Repeats are left out of a sorted list, side by side; array_distinct compares pairs of numbers each with each."""
    monkeypatch.delattr(nb.F, "array_distinct")
    m = np.random.default_rng(31).normal(size=(300, 6))
    found = em.similar_items(frame(spark, m), 10, trees=8, leaf=300)
    assert lists(found) == brute(m, 10, angle)  # one leaf a tree: all mates come eight times
