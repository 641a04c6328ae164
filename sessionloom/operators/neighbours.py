"""Neighbour search among vectors: exact with pruned blocks, and approximate by a forest.

Vectors lie in cells of a partition tree that Spark grows level by level: cells that are too large are
halved up to six times at once, along lines through vectors of a bounded sample of the cell, until
all cells fit a task. Nothing about it is gathered on the driver or broadcast; planes meet the rows of
their cell in chunks.

Exact search makes one cell a block, with its centre and radius. A block of queries first meets the few
corpus blocks with the smallest lower bound; a query then goes on only to blocks whose lower bound does not
exceed its kth cost so far. Inner products are bounded by norms: blocks of items stand in falling norm.
A group of query blocks lies in one task, which takes the corpus blocks that any of them still has to meet one
by one, the nearest first; a product of 32-bit numbers with a bound of its error leaves the few pairs to be measured.
Where nothing can be pruned, as between vectors without structure, the work is quadratic in time, but queries are moved
once and the corpus once per group.

Identical vectors are collapsed first: a large group of copies costs one vector, and its members
get each other as nearest neighbours.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.constants import HOT_ROWS
from sessionloom.functions import expressions as X
from sessionloom.operators import ordering
from sessionloom.sources.tables import cut_lineage

_FOUND = "id long, neighbor long, cost double"
_PAIRS_AT_ONCE = 1 << 14
#: The forest of the approximate search: its trees, and the items of a leaf at most.
TREES, LEAF = 24, 2048
#: Rows of a cell that one task takes, of a chunk that meets its planes, of the sample a cell is cut by, halvings at once.
CELL_ROWS, _CHUNK, _SAMPLE, _HALVINGS = 1 << 16, 1 << 13, 1 << 10, 6
#: Corpus blocks that queries meet first, and blocks whose centres a task may hold.
FIRST_BLOCKS, _MOST_CENTRES = 4, 1 << 16
#: Query blocks of a group at most, and queries that meet a block at once.
GROUP_BLOCKS, _QUERIES_AT_ONCE = 32, 1 << 11
_NOBODY = np.iinfo(np.int64).max
_MET = "g int, q long, c long, low double, pack binary"


def _costs(q: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Cost (smaller is nearer) of row i of q with row i of c, in one fixed order of addition."""
    if metric == "euclidean":
        return np.sqrt(((q - c) ** 2).sum(axis=1))
    dots = (q * c).sum(axis=1)
    if metric == "dot":
        return -dots
    norms = np.sqrt((q * q).sum(axis=1)) * np.sqrt((c * c).sum(axis=1))
    return -np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)


def _nearest(qid, q, cid, c, k: int, metric: str, barred: tuple, most: np.ndarray | None = None) -> pd.DataFrame:
    """The k nearest corpus rows of each query row, but for barred (row of q, row of c) places.

    With ``most``, rows that cost a query more than that may be left out, so that few are measured.

    A matrix product finds everything that could be among the k nearest, with a margin above
    its rounding error; those few pairs are then measured exactly.
    """
    dots = q @ c.T
    if metric == "euclidean":
        rough = (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * dots
    elif metric == "dot":
        rough = -dots
    else:
        norms = np.sqrt((q * q).sum(1))[:, None] * np.sqrt((c * c).sum(1))[None, :]
        rough = -np.divide(dots, norms, out=np.zeros_like(dots), where=norms > 0)
    margin = 1e-9 * max(1.0, float(np.abs(rough).max(initial=0.0)))
    rough[barred] = np.inf
    kk = min(k, rough.shape[1])
    if most is None:
        kth = np.partition(rough, kk - 1, axis=1)[:, kk - 1]
    else:
        kth = most * most if metric == "euclidean" else most.copy()
        many = np.flatnonzero(np.count_nonzero(rough <= kth[:, None] + margin, axis=1) > kk)
        if len(many):
            kth[many] = np.minimum(kth[many], np.partition(rough[many], kk - 1, axis=1)[:, kk - 1])
    rows, cols = np.nonzero((rough <= kth[:, None] + margin) & np.isfinite(rough))
    cost = np.empty(len(rows))
    for a in range(0, len(rows), _PAIRS_AT_ONCE):
        s = slice(a, a + _PAIRS_AT_ONCE)
        cost[s] = _costs(q[rows[s]], c[cols[s]], metric)
    order = np.lexsort((cid[cols], cost, rows))
    rows, cols, cost = rows[order], cols[order], cost[order]
    nth = np.arange(len(rows)) - np.searchsorted(rows, rows, side="left")
    keep = nth < k
    return pd.DataFrame({"id": qid[rows[keep]], "neighbor": cid[cols[keep]], "cost": cost[keep]})


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _block_pair(k: int, metric: str) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """``left`` holds queries, and rows without a vector that rule out a pair (id, bar)."""
        queries = left[left["bar"].isna()]
        if queries.empty or right.empty:
            return _nothing()
        qid, cid = queries["id"].to_numpy(), right["id"].to_numpy()
        barred = left[left["bar"].notna()]
        at_q = pd.Index(qid).get_indexer(barred["id"])
        at_c = pd.Index(cid).get_indexer(barred["bar"].astype("int64"))
        ok = (at_q >= 0) & (at_c >= 0)
        return _nearest(qid, _matrix(queries["vec"]), cid, _matrix(right["vec"]), k, metric, (at_q[ok], at_c[ok]))

    return search


def _nothing() -> pd.DataFrame:
    return pd.DataFrame({"id": pd.Series(dtype="int64"), "neighbor": pd.Series(dtype="int64"),
                         "cost": pd.Series(dtype="float64")})


def _best(found: DataFrame, k: int) -> DataFrame:
    nearest = W.partitionBy("id").orderBy("cost", "neighbor")
    return found.withColumn("rank", F.row_number().over(nearest)).filter(F.col("rank") <= k)


def block_search(queries: DataFrame, corpus: DataFrame, k: int, metric: str, barred: DataFrame | None = None,
                 block_rows: int = 2048) -> DataFrame:
    """Exact k nearest corpus rows (id, neighbor, cost, rank) of each query.

    Both sides have columns (id, vec); ``barred`` (id, bar) lists pairs that must not be
    found, and is applied inside the block before its k best are cut. Shuffled volume is rows
    times blocks of the other side; k rows per query leave each block pair.
    """
    def blocks(df: DataFrame) -> int:
        return max(1, -(-df.count() // block_rows))

    def block(c: str, n: int) -> Column:
        return F.pmod(X.spread(F.col(c)), F.lit(n)).cast("int")

    nq, nc = blocks(queries), blocks(corpus)
    left = queries.select("id", F.lit(None).cast("long").alias("bar"), "vec",
                          block("id", nq).alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(nc - 1))).alias("cb"))
    if barred is not None:
        left = left.unionByName(barred.select(
            F.col("id").cast("long").alias("id"), F.col("bar").cast("long").alias("bar")).select(
            "id", "bar", F.lit(None).cast(queries.schema["vec"].dataType).alias("vec"), block("id", nq).alias("qb"),
            block("bar", nc).alias("cb")))
    right = corpus.select("id", "vec", block("id", nc).alias("cb"),
                          F.explode(F.sequence(F.lit(0), F.lit(nq - 1))).alias("qb"))
    found = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(_block_pair(k, metric), _FOUND)
    return _best(found, k)


def _collapse(vectors: DataFrame, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(representatives (id, vec), members (id, rep)): one representative per distinct vector."""
    reps = vectors.groupBy("vec").agg(F.min("id").alias("rep"))
    members = ordering.spread_join(vectors, reps, ["vec"], salt_by=["id"], hot_rows=hot_rows).select("id", "rep")
    return reps.select(F.col("rep").alias("id"), "vec"), members


def _expand(found: DataFrame, members: DataFrame, k: int, self_cost: Column, hot_rows: int, asking: DataFrame | None = None) -> DataFrame:
    """Neighbours among all members from neighbours among representatives; of the members ``asking``, or of all.

    Only the k + 1 smallest members of a group can be among anyone's k nearest, since they
    share one cost and ties go to the smaller id.
    """
    smallest = W.partitionBy("rep").orderBy("id")
    near = members.withColumn("n", F.row_number().over(smallest)).filter(F.col("n") <= k + 1).select(
        F.col("rep").alias("at"), F.col("id").alias("neighbor"))
    asking = members if asking is None else asking
    own = asking.select(F.col("rep").alias("id")).distinct().select(
        "id", F.col("id").alias("at"), self_cost.alias("cost"))
    links = found.select("id", F.col("neighbor").alias("at"), "cost").unionByName(own)
    lists = _best(links.join(near, "at").select("id", "neighbor", "cost"), k + 1).select(
        F.col("id").alias("rep"), "neighbor", "cost")
    each = ordering.spread_join(asking, lists, ["rep"], salt_by=["id"], hot_rows=hot_rows)
    return _best(each.filter(F.col("id") != F.col("neighbor")).select("id", "neighbor", "cost"), k)


def _score(metric: str) -> Column:
    return F.col("cost") if metric == "euclidean" else -F.col("cost")


def _own_cost(metric: str) -> Column:
    return F.lit(0.0 if metric == "euclidean" else -1.0)


def _lean(m: np.ndarray) -> np.ndarray:
    """The same numbers in half the room where 32 bits hold them."""
    with np.errstate(over="ignore"):
        half = m.astype(np.float32)
    return half if np.array_equal(half, m) else m


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


# Forest -------------------------------------------------------------------------------

def _halving(points: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
    """A plane and an offset that part the points evenly: across the line through two of them, or any way if that is lopsided."""
    a, b = rng.choice(len(points), 2, replace=False)
    for plane in (points[a] - points[b], rng.normal(size=points.shape[1])):
        places = points @ plane
        offset = float(np.median(places))
        right = int((places > offset).sum())
        if 10 * min(right, len(points) - right) >= len(points):
            break
    return plane, offset


def _planes(sample: np.ndarray, depth: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Planes and offsets of a full binary tree, in heap order."""
    planes, offsets = rng.normal(size=(2**depth - 1, sample.shape[1])), np.zeros(2**depth - 1)
    members = {0: np.arange(len(sample))}
    for i in range(len(planes)):
        own = members.pop(i)
        if len(own) > 1:
            planes[i], offsets[i] = _halving(sample[own], rng)
        right = sample[own] @ planes[i] > offsets[i]
        members[2 * i + 1], members[2 * i + 2] = own[~right], own[right]
    return planes, offsets


def _plant(seed: int, level: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def plant(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        """The planes that cut a cell, from its sample."""
        rows = rows.sort_values("id")
        rng = np.random.default_rng((seed, level, int(key[0]), int(key[1])))
        depth = int(rows["depth"].iloc[0])
        pack = pickle.dumps((depth, *_planes(_matrix(rows["vec"]), depth, rng)), protocol=5)
        return pd.DataFrame([(int(key[0]), int(key[1]), int(rows["chunks"].iloc[0]), pack)], columns=["tree", "cell", "chunks", "planes"])

    return plant


def _move(key: tuple, rows: pd.DataFrame, planes: pd.DataFrame) -> pd.DataFrame:
    """A chunk of a cell's rows, in the cells below."""
    if rows.empty:
        return rows[["id", "vec", "tree", "cell"]]
    depth, lines, offsets = pickle.loads(planes["planes"].iloc[0])
    m, at = _matrix(rows["vec"]), np.zeros(len(rows), np.int64)
    for _ in range(depth):
        at = 2 * at + 1 + ((m * lines[at]).sum(1) > offsets[at])
    return rows[["id", "vec", "tree"]].assign(cell=rows["cell"] * 2**_HALVINGS + at - (2**depth - 1))


def cells(vectors: DataFrame, trees: int = 1, cell_rows: int = CELL_ROWS, seed: int = 42) -> DataFrame:
    """id, vec, tree, cell: per tree, cells of at most ``cell_rows`` vectors near each other; ``vectors`` (id, vec) all differ."""
    placed = vectors.select("id", "vec", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(1).cast("long").alias("cell"))
    keys, level = ["tree", "cell"], 0
    while True:
        n = F.col("n")
        large = placed.groupBy(*keys).agg(F.count("*").alias("n")).filter(n > cell_rows)
        large = cut_lineage(large.withColumns({
            "depth": F.least(F.lit(_HALVINGS), F.ceil(F.log2(n / cell_rows))).cast("int"), "chunks": F.ceil(n / _CHUNK).cast("int")}))
        count = large.count()
        if not count:
            return placed
        large = F.broadcast(large) if count <= ordering.SMALL else large
        inside = placed.join(large, keys)
        drawn = F.pmod(F.xxhash64("id", "tree", F.lit(seed + level)), n) < _SAMPLE
        planted = inside.filter(drawn).groupBy(*keys).applyInPandas(_plant(seed, level), "tree int, cell long, chunks int, planes binary")
        planted = planted.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        dealt = inside.withColumn("chunk", F.pmod(X.spread(F.col("id")), F.col("chunks")).cast("int"))
        moved = dealt.groupBy(*keys, "chunk").cogroup(planted.groupBy(*keys, "chunk")).applyInPandas(_move, placed.schema)
        placed = cut_lineage(moved.unionByName(placed.join(large, keys, "left_anti")))
        level += 1


def _leaves(points: np.ndarray, leaf: int, least: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Rows of each leaf: halved evenly down to ``leaf`` rows, but to no fewer than ``least``."""
    open_, out = [np.arange(len(points))], []
    while open_:
        own = open_.pop()
        if len(own) <= max(leaf, 2 * least - 1):
            out.append(own)
            continue
        plane, _ = _halving(points[own], rng)
        order = own[np.argsort(points[own] @ plane, kind="stable")]
        open_ += [order[:len(own) // 2], order[len(own) // 2:]]
    return out


def forest(vectors: DataFrame, k: int, trees: int, leaf: int, seed: int = 42, cell_rows: int = CELL_ROWS) -> DataFrame:
    """id, tree, cell, leaf, near (cost, neighbor): per tree the k nearest by angle among an item's leaf mates.

    ``vectors`` (id, vec) all differ. A leaf holds ``leaf`` items at most, and more than k if there are so many.
    """
    unit = vectors.select("id", F.col("vec").cast("array<double>").alias("vec"))
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    placed = cells(unit.withColumn("vec", F.transform("vec", lambda x: F.when(length > 0, x / length).otherwise(0.0))), trees, cell_rows, seed)
    # A cell with too few mates joins the largest of its tree.
    sizes = cut_lineage(placed.groupBy("tree", "cell").agg(F.count("*").alias("n")))
    small = sizes.filter(F.col("n") <= k)
    if not small.isEmpty():
        into = sizes.groupBy("tree").agg(F.max(F.struct("n", "cell"))["cell"].alias("into"))
        placed = placed.join(small.join(into, "tree").select("tree", "cell", "into"), ["tree", "cell"], "left").withColumn(
            "cell", F.coalesce("into", "cell")).drop("into")

    def search(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        ids, m = rows["id"].to_numpy(np.int64), _matrix(rows["vec"])
        out = []
        for number, own in enumerate(_leaves(m, leaf, k + 1, np.random.default_rng((seed, int(key[0]), int(key[1]))))):
            for at in range(0, len(own), 1024):
                some = own[at:at + 1024]
                bar = (np.arange(len(some)), np.arange(at, at + len(some)))
                found = _nearest(ids[some], m[some], ids[own], m[own], k, "cosine", bar)
                each = min(k, len(own) - 1)
                near, cost = (found[c].to_numpy().reshape(len(some), each) for c in ("neighbor", "cost"))
                out.append(pd.DataFrame({"id": ids[some], "leaf": number, "neighbor": list(near), "cost": list(cost)}))
        return pd.concat(out).assign(tree=key[0], cell=key[1])

    found = placed.groupBy("tree", "cell").applyInPandas(
        search, "id long, tree int, cell long, leaf int, neighbor array<long>, cost array<double>")
    return found.select("id", "tree", "cell", "leaf", F.arrays_zip("cost", "neighbor").alias("near"))


def similar_items(vectors: DataFrame, k: int = 50, trees: int = TREES, leaf: int = LEAF, seed: int = 42,
                  hot_rows: int = HOT_ROWS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Approximate k nearest items by angle (aid, neighbor, rank, score), from a forest of random projection trees.

    A tree halves the unit vectors again and again until at most ``leaf`` are left, each time along the line
    through two of them. Items that share a leaf are compared, and an item is found by its leaf mates over
    all trees; an item has at least k of them wherever there are so many.
    """
    if leaf <= k:
        raise ValueError(f"a leaf of {leaf} items cannot hold {k} neighbours")
    reps, members = _collapse(vectors.select("id", "vec"), hot_rows)
    # Costs and neighbours travel as numbers, which take half the room of pairs, in the same order.
    met = forest(cut_lineage(reps), k, trees, leaf, seed, cell_rows).groupBy("id").agg(
        *[F.flatten(F.collect_list(f"near.{c}")).alias(c) for c in ("cost", "neighbor")])
    # Mates met in several trees stand side by side once sorted: leaving out repeats so takes one look at each.
    met = met.select("id", F.array_sort(F.arrays_zip("cost", "neighbor")).alias("near"))
    fresh = F.filter("near", lambda x, i: (i == 0) | (x != F.get("near", i - 1)))
    best = met.select("id", F.explode(F.slice(fresh, 1, k)).alias("n")).select("id", "n.neighbor", "n.cost")
    return _expand(cut_lineage(best), members, k, _own_cost("cosine"), hot_rows).select(
        F.col("id").alias("aid"), "neighbor", "rank", _score("cosine").alias("score"))


# Exact search -----------------------------------------------------------------------

def _bounds(q: np.ndarray, centres: np.ndarray, radius: np.ndarray, norm: np.ndarray, metric: str) -> np.ndarray:
    """What a row of q costs at least in each block."""
    length = np.sqrt((q * q).sum(1))[:, None]
    dots = q @ centres.T
    if metric == "dot":
        low = -np.minimum(length * norm, dots + length * radius)
    else:
        gap = np.sqrt(np.maximum(length**2 + (centres * centres).sum(1) - 2 * dots, 0))
        low = np.maximum(gap - radius, 0)
        if metric == "cosine":  # of unit vectors; a zero vector's cost of 0 lies above its bound
            low = low**2 / 2 - 1
    return low - 1e-7 * (1 + np.abs(low))


def _packed(rows: DataFrame, metric: str) -> DataFrame:
    """block, n, centre, radius, norm and the rows themselves, of (id, vec, block)."""

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        m = _matrix(rows["vec"])
        points = _unit(m) if metric == "cosine" else m
        centre = points.mean(0)
        radius = float(np.sqrt(((points - centre) ** 2).sum(1)).max()) * (1 + 1e-9)
        norm = float(np.sqrt((points * points).sum(1)).max()) * (1 + 1e-9)
        return pd.DataFrame([(int(key[0]), centre, radius, norm, pickle.dumps((rows["id"].to_numpy(np.int64), _lean(m)), protocol=5))],
                            columns=["block", "centre", "radius", "norm", "pack"])

    return rows.groupBy("block").applyInPandas(pack, "block long, centre array<double>, radius double, norm double, pack binary")


def _asked(rows: DataFrame, barred: DataFrame) -> DataFrame:
    """block and its queries (id, vec, block), each with the corpus rows (id, bar, block) that it must not find."""

    def pack(key: tuple, rows: pd.DataFrame, bars: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame({"block": pd.Series(dtype="int64"), "pack": pd.Series(dtype=object)})
        rows, bars = rows.sort_values("id"), bars.sort_values(["id", "bar"])
        own = (rows["id"].to_numpy(np.int64), _lean(_matrix(rows["vec"])), bars["id"].to_numpy(np.int64), bars["bar"].to_numpy(np.int64))
        return pd.DataFrame([(int(key[0]), pickle.dumps(own, protocol=5))], columns=["block", "pack"])

    return rows.groupBy("block").cogroup(barred.groupBy("block")).applyInPandas(pack, "block long, pack binary")


def _unpacked(pack: bytes) -> tuple:
    """A block's numbers and its vectors at full width, and what else it holds."""
    ids, m, *more = pickle.loads(pack)
    return ids, m.astype(np.float64), *more


def _places(ids: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return pd.Index(ids).get_indexer(wanted)


def _search(asked: tuple, corpus: tuple, k: int, metric: str, most: np.ndarray | None = None) -> pd.DataFrame:
    (qid, q, who, bar), (cid, c) = asked, corpus
    a, b = _places(qid, who), _places(cid, bar)
    ok = (a >= 0) & (b >= 0)
    return _nearest(qid, q, cid, c, k, metric, (a[ok], b[ok]), most)


class _Group:
    """The queries of some blocks, and the k nearest that each has found so far."""

    def __init__(self, told: list[tuple], k: int, metric: str):
        """``told``: numbers, vectors, barred pairs (id, bar), what was found (places of the queries, neighbours, costs), and in which blocks."""
        self.k, self.metric = k, metric
        self.block, self.first = np.repeat(np.arange(len(told)), [len(t[0]) for t in told]), [t[7] for t in told]
        start = np.cumsum([0, *(len(t[0]) for t in told)])
        self.ids, self.q = np.concatenate([t[0] for t in told]), np.concatenate([t[1] for t in told])
        self.points = _unit(self.q) if metric == "cosine" else self.q
        self.who = np.concatenate([_places(t[0], t[2]) + at for t, at in zip(told, start)])  # a block bars for its own queries
        self.bar = np.concatenate([t[3] for t in told])
        self.barred = np.unique(self.bar)
        self.keys = np.unique(self.who * (len(self.barred) + 1) + np.searchsorted(self.barred, self.bar))
        self.near, self.cost = np.full((len(self.ids), k), _NOBODY), np.full((len(self.ids), k), np.inf)
        self.waiting = [(np.concatenate([t[4] + at for t, at in zip(told, start)]), *(np.concatenate([t[i] for t in told]) for i in (5, 6)))]
        self.merge()

    def merge(self) -> None:
        rows, near, cost = (np.concatenate(x) for x in zip(*self.waiting))
        self.waiting = []
        some, rows = np.unique(rows, return_inverse=True)
        rows = np.concatenate([np.repeat(np.arange(len(some)), self.k), rows])
        near, cost = np.concatenate([self.near[some].ravel(), near]), np.concatenate([self.cost[some].ravel(), cost])
        order = np.lexsort((near, cost, rows))
        first = order[np.searchsorted(rows[order], np.arange(len(some)))[:, None] + np.arange(self.k)]
        self.near[some], self.cost[some] = near[first], cost[first]

    def meet(self, name: int, cid: np.ndarray, c: np.ndarray, centre: np.ndarray, radius: float, norm: float) -> None:
        """One block more; queries that met it first do not meet it again."""
        low = _bounds(self.points, centre[None], np.array([radius]), np.array([norm]), self.metric)[:, 0]
        rows = np.flatnonzero((low <= self.cost[:, -1]) & np.array([name not in f for f in self.first])[self.block])
        if not len(rows):
            return
        if self.metric == "dot":
            moved, lines = c, -c.T
        else:  # by distances from the block's centre, which are small numbers
            moved = (_unit(c) if self.metric == "cosine" else c) - centre
            lines = np.vstack([-2 * moved.T, (moved * moved).sum(1)])
        reach = np.sqrt((moved * moved).sum(1)).max()
        with np.errstate(over="ignore", invalid="ignore"):
            lines = np.ascontiguousarray(lines, np.float32)
        for at in range(0, len(rows), _QUERIES_AT_ONCE):
            own = rows[at:at + _QUERIES_AT_ONCE]
            found = self._below(own, cid, c, centre, lines, reach)
            if len(found[0]):
                self.waiting.append(found)
        if sum(len(w[0]) for w in self.waiting) > max(1 << 14, self.near.size // 2):
            self.merge()

    def _below(self, own: np.ndarray, cid, c, centre, lines: np.ndarray, reach: float) -> tuple[np.ndarray, ...]:
        """Rows, neighbours and costs of the pairs that may be among the k nearest of the queries ``own``."""
        most, width = self.cost[own, -1], c.shape[1]
        with np.errstate(over="ignore", invalid="ignore"):
            if self.metric == "dot":
                left, limit = self.q[own], most
                size = np.sqrt((left * left).sum(1)) * reach
            else:
                moved = self.points[own] - centre
                square = (moved * moved).sum(1)
                left, limit = np.hstack([moved, np.ones((len(own), 1))]), (most * most if self.metric == "euclidean" else 2 + 2 * most) - square
                size = (np.sqrt(square) + reach) ** 2
            # Twice what rounding each number, product and sum to 24 bits can be wrong.
            limit = (limit + (width + 8) * 2.0**-23 * size + 1e-36).astype(np.float32)
            hits = None
            if size.max() < 1e30:
                hits = np.flatnonzero(left.astype(np.float32) @ lines <= limit[:, None])
        if hits is None or len(hits) > 8 * self.k * len(own):  # numbers beyond 32 bits, or many pairs within the error
            asked = np.isin(self.who, own)
            place = np.full(len(self.ids), -1)
            place[own] = np.arange(len(own))
            at_q, at_c = place[self.who[asked]], _places(cid, self.bar[asked])
            some = _nearest(own, self.q[own], cid, c, self.k, self.metric, (at_q[at_c >= 0], at_c[at_c >= 0]), most)
            rows, near, cost = (some[x].to_numpy() for x in ("id", "neighbor", "cost"))
            keep = cost <= self.cost[rows, -1]
            return rows[keep], near[keep], cost[keep]
        rows, cols = own[hits // len(cid)], hits % len(cid)
        if len(self.barred):
            near = cid[cols]
            at = np.minimum(np.searchsorted(self.barred, near), len(self.barred) - 1)
            key = rows * (len(self.barred) + 1) + at
            out = (self.barred[at] == near) & (self.keys[np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)] == key)
            rows, cols = rows[~out], cols[~out]
        cost = np.concatenate([np.zeros(0), *(
            _costs(self.q[rows[a:a + _PAIRS_AT_ONCE]], c[cols[a:a + _PAIRS_AT_ONCE]], self.metric) for a in range(0, len(rows), _PAIRS_AT_ONCE))])
        keep = cost <= self.cost[rows, -1]
        return rows[keep], cid[cols[keep]], cost[keep]

    def result(self) -> Iterator[pd.DataFrame]:
        if self.waiting:
            self.merge()
        for at in range(0, len(self.ids), _QUERIES_AT_ONCE):
            s = slice(at, at + _QUERIES_AT_ONCE)
            near, cost, ids = self.near[s].ravel(), self.cost[s].ravel(), np.repeat(self.ids[s], self.k)
            real = near != _NOBODY
            yield pd.DataFrame({"id": ids[real], "neighbor": near[real], "cost": cost[real]})


def _met(asked: DataFrame, corpus: DataFrame, k: int, metric: str, centres: tuple, group_of: dict[int, int]) -> DataFrame:
    """Queries with what they found in their first blocks (c null), and the blocks that any still has to meet: _MET."""
    names, centre, radius, norm = centres

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for block, pack in zip(b["block"], b["pack"]):
                q = _unpacked(pack)[1]
                low = _bounds(_unit(q) if metric == "cosine" else q, centre, radius, norm, metric).mean(0)
                rows += [(block, int(names[c])) for c in np.argsort(low, kind="stable")[:FIRST_BLOCKS]]
            yield pd.DataFrame(rows, columns=["q", "c"]).astype("int64")

    def begin(key: tuple, asked: pd.DataFrame, first: pd.DataFrame) -> pd.DataFrame:
        own, block = _unpacked(asked["pack"].iloc[0]), int(key[0])
        qid, q, who, bar = own
        best = pd.concat([_search(own, _unpacked(p), k, metric) for p in first["pack"]])
        best = best.sort_values(["id", "cost", "neighbor"])
        best = best[best.groupby("id").cumcount() < k]
        kth = np.full(len(qid), np.inf)
        last = best[best.groupby("id").cumcount() == k - 1]
        kth[_places(qid, last["id"])] = last["cost"].to_numpy()
        low = _bounds(_unit(q) if metric == "cosine" else q, centre, radius, norm, metric)
        low[low > kth[:, None]] = np.inf
        near = np.fmin.reduce(low, axis=0)
        near[np.isin(names, first["c"])] = np.inf
        told = (qid, _lean(q), who, bar, _places(qid, best["id"]), best["neighbor"].to_numpy(), best["cost"].to_numpy(),
                [int(c) for c in first["c"]])
        out = [(group_of[block], block, None, None, pickle.dumps(told, protocol=5))]
        out += [(group_of[block], block, int(names[c]), float(near[c]), None) for c in np.flatnonzero(near < np.inf)]
        return pd.DataFrame(out, columns=["g", "q", "c", "low", "pack"]).astype({"c": "Int64"})

    first = asked.mapInPandas(choose, "q long, c long")
    near = first.join(corpus.select(F.col("block").alias("c"), "pack"), "c")
    return asked.withColumn("q", F.col("block")).groupBy("q").cogroup(near.groupBy("q")).applyInPandas(begin, _MET)


def _pruned(asked: DataFrame, corpus: DataFrame, k: int, metric: str) -> tuple[DataFrame, DataFrame]:
    """(id, neighbor, cost, rank) of the k nearest, and the met blocks. Both sides are written."""
    seen = corpus.select("block", "centre", "radius", "norm").orderBy("block").toPandas()  # blocks are counted by the caller
    centres = (seen["block"].to_numpy(), np.stack(seen["centre"]), seen["radius"].to_numpy(), seen["norm"].to_numpy())
    # Neighbouring query blocks share a group; groups are as few as tasks can hold, but no fewer than keep all cores busy.
    blocks = [r["block"] for r in asked.select("block").orderBy("block").collect()]
    cores = asked.sparkSession.sparkContext.defaultParallelism
    groups = max(1, min(len(blocks), max(-(-len(blocks) // GROUP_BLOCKS), 2 * cores)))
    met = cut_lineage(_met(asked, corpus, k, metric, centres, {b: i * groups // len(blocks) for i, b in enumerate(blocks)}))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, told, number = None, [], None
        for b in batches:
            for g, c, pack, centre, radius, norm in zip(b["g"], b["c"], b["pack"], b["centre"], b["radius"], b["norm"]):
                if g != number:
                    if number is not None:
                        yield from (group or _Group(told, k, metric)).result()
                    group, told, number = None, [], g
                if pd.isna(c):
                    told.append(_unpacked(pack))
                    continue
                if group is None:
                    group, told = _Group(told, k, metric), []
                group.meet(int(c), *_unpacked(pack), np.asarray(centre), radius, norm)
        if number is not None:
            yield from (group or _Group(told, k, metric)).result()

    queries = met.filter(F.col("c").isNull()).drop("q").select("*", *[F.lit(None).cast(t).alias(n) for n, t in (
        ("centre", "array<double>"), ("radius", "double"), ("norm", "double"))])
    pairs = met.filter(F.col("c").isNotNull()).groupBy("g", "c").agg(F.min("low").alias("low"))
    rows = queries.unionByName(pairs.join(corpus.withColumnRenamed("block", "c").drop("n"), "c"))
    dealt = rows.repartitionById(groups, "g").sortWithinPartitions("g", F.col("c").isNotNull(), "low", "c")
    return _best(dealt.mapInPandas(finish, _FOUND), k), met


def _empty(df: DataFrame) -> DataFrame:
    return df.select("id", F.lit(0).cast("long").alias("neighbor"), F.lit(0.0).alias("cost"), F.lit(0).alias("rank")).limit(0)


def _neighbours(reps: DataFrame, k: int, metric: str, block_rows: int, asking: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(id, neighbor, cost, rank) among different vectors, of all or of those ``asking`` (id), and the met blocks (None: all pairs of blocks)."""
    itself = reps.select("id", F.col("id").alias("bar"))
    n = reps.count()
    if not n:
        return _empty(reps), None
    if n > block_rows * _MOST_CENTRES // 4:  # too many centres for a task
        queries = reps if asking is None else reps.join(asking, "id", "left_semi")
        return block_search(queries, reps, k, metric, itself, block_rows), None
    points = reps.select("id", F.col("vec").cast("array<double>").alias("vec"))
    placed = cut_lineage(cells(points, 1, block_rows).select("id", "vec", F.col("cell").alias("block")))
    corpus = cut_lineage(_packed(placed, metric))
    queries = placed if asking is None else cut_lineage(placed.join(asking, "id", "left_semi"))
    return _pruned(cut_lineage(_asked(queries, queries.select("id", F.col("id").alias("bar"), "block"))), corpus, k, metric)


def nearest_items(vectors: DataFrame, k: int, metric: str = "euclidean", block_rows: int = 2048,
                  hot_rows: int = HOT_ROWS, wanted: DataFrame | None = None) -> DataFrame:
    """Exact k nearest other items (aid, neighbor, rank, score) of every (id, vec); metric euclidean or cosine.

    With ``wanted`` (id; repeats and strange ids do not matter) only those items get lists, out of all vectors.
    Blocks that lie too far from a query are left out. Among vectors without any structure the work is
    quadratic in distinct vectors; above some millions of those use similar_items.
    """
    if metric not in ("euclidean", "cosine"):
        raise ValueError("an item is its own best match only under euclidean or cosine")
    reps, members = _collapse(vectors.select("id", "vec"), hot_rows)
    asking = askers = None
    if wanted is not None:
        asking = cut_lineage(members.join(wanted.select("id").distinct(), "id", "left_semi"))
        askers = asking.select(F.col("rep").alias("id")).distinct()
    found, _ = _neighbours(cut_lineage(reps), k, metric, block_rows, askers)
    return _expand(found, members, k, _own_cost(metric), hot_rows, asking).select(
        F.col("id").alias("aid"), "neighbor", "rank", _score(metric).alias("score"))


def _recommended(users: DataFrame, items: DataFrame, k: int, barred: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(id, neighbor, cost, rank) of the items of largest inner product, and the met blocks (None: all pairs of blocks)."""
    n, sessions = items.count(), users.count()
    if not n or not sessions:
        return _empty(users), None
    if n > block_rows * _MOST_CENTRES // 4:
        return block_search(users, items, k, "dot", barred, block_rows), None
    blocks = -(-n // block_rows)
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    ranged = items.select("id", "vec", norm.alias("_norm")).repartitionByRange(blocks, F.col("_norm").desc(), "id")
    corpus = cut_lineage(_packed(ranged.select("id", "vec", F.spark_partition_id().cast("long").alias("block")), "dot"))
    block = F.pmod(X.spread(F.col("id")), F.lit(-(-sessions // block_rows))).cast("long").alias("block")
    asked = cut_lineage(_asked(users.select("id", "vec", block), barred.select("id", "bar", block)))
    return _pruned(asked, corpus, k, "dot")


def recommend(session_factors: DataFrame, item_factors: DataFrame, k: int = 30, seen: DataFrame | None = None,
              block_rows: int = 2048) -> DataFrame:
    """The k items of largest dot product for each session (session, aid, rank, score).

    With ``seen`` (session, aid) those items are left out, however many a session has seen. Items stand in
    blocks of falling norm, and a session is done once no block that is left can reach its kth score.
    """
    barred = session_factors.select("id", F.lit(None).cast("long").alias("bar")).limit(0)
    if seen is not None:
        barred = seen.select(F.col("session").cast("long").alias("id"), F.col("aid").cast("long").alias("bar")).distinct()
    users = session_factors.select(F.col("id").cast("long").alias("id"), "vec")
    items = item_factors.select(F.col("id").cast("long").alias("id"), "vec")
    found, _ = _recommended(cut_lineage(users), cut_lineage(items), k, barred, block_rows)
    return found.select(F.col("id").alias("session"), F.col("neighbor").alias("aid"), "rank", (-F.col("cost")).alias("score"))
