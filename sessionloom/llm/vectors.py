"""Vectors in cover trees: exact threshold links and exact top-k search, block against block.

Vectors are dealt to the nearest of a few pivots (the tree's top level, from a bounded sample),
and a pivot's cell is cut by hash into blocks of about ``block_rows``, so that no block grows
with the data. Every block is packed into one row with its cover tree. Pairs of cells whose
distance exceeds their covering radii and the reach are pruned; the other block pairs meet in
one task each, which runs the dual traversal.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm import covertree
from sessionloom.llm.components import components
from sessionloom.sources.tables import cut_lineage

PIVOTS = 8
SAMPLE = 2048


def finite(vector: Column) -> Column:
    """Not null, not empty, and without null, NaN or infinite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    """Rows of doubles; shorter vectors are filled up with zeros."""
    rows = column.tolist()
    if all(len(r) == width for r in rows):
        return np.array(rows, np.float64).reshape(len(rows), width)
    out = np.zeros((len(rows), width))
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def _unit(m: np.ndarray) -> np.ndarray:
    return m / np.sqrt((m * m).sum(1))[:, None]


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Points of the sample far from each other, one after the other."""
    chosen = [0]
    gap = np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        gap = np.minimum(gap, ((sample - sample[chosen[-1]]) ** 2).sum(1))
        chosen.append(int(gap.argmax()))
    return sample[chosen]


def _cells(frame: DataFrame, pivots: np.ndarray, width: int, unit: bool) -> DataFrame:
    """Adds cell (nearest pivot) and gap (distance to it)."""

    @F.pandas_udf("cell int, gap double")
    def nearest(v: pd.Series) -> pd.DataFrame:
        m = _matrix(v, width)
        d = covertree.distances(_unit(m) if unit else m, pivots)
        k = d.argmin(1) if len(d) else np.empty(0, int)
        return pd.DataFrame({"cell": k.astype(np.int32), "gap": d[np.arange(len(d)), k]})

    return frame.withColumn("_c", nearest("vector")).select("*", "_c.cell", "_c.gap").drop("_c")


def _sampled(frame: DataFrame, width: int) -> np.ndarray:
    rows = frame.select("vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toPandas()
    return _matrix(rows["vector"], width)


def _salted(frame: DataFrame, block_rows: int) -> tuple[DataFrame, dict[int, int], dict[int, float]]:
    """Adds the block's number in its cell; also blocks and covering radius by cell (one of a few pivots)."""
    seen = frame.groupBy("cell").agg(F.count("*").alias("n"), F.max("gap").alias("r")).collect()
    blocks = {r["cell"]: max(1, math.ceil(r["n"] / block_rows)) for r in seen}
    count = F.element_at(F.create_map(*[F.lit(x) for kv in blocks.items() for x in kv]), F.col("cell")) if blocks else F.lit(1)
    return frame.withColumn("salt", F.pmod(F.xxhash64("node"), count).cast("int")), blocks, {r["cell"]: r["r"] for r in seen}


def _packed(frame: DataFrame, width: int, scale: float | None) -> DataFrame:
    """One row per (cell, salt): pickled node ids, weights, vectors and the levels of the cover tree.

    ``scale``: radius of the top level for unit vectors; None for raw vectors, by their spread.
    """

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        m = _matrix(rows["vector"], width)
        if scale is None:
            points, top = m, float(np.sqrt(((m - m.mean(0)) ** 2).sum(1)).max()) / 2
        else:
            points, top = _unit(m), scale
        tree = covertree.build(points, max(top, 1e-9))
        data = (rows["node"].to_numpy(np.int64), rows["weight"].to_numpy(np.int64), m, [(x.centre, x.radius, x.first, x.order) for x in tree.levels])
        return pd.DataFrame([(int(key[0]), int(key[1]), pickle.dumps(data, protocol=5))], columns=["cell", "salt", "block"])

    return frame.groupBy("cell", "salt").applyInPandas(pack, "cell int, salt int, block binary")


def _load(block: bytes, unit: bool):
    node, weight, m, levels = pickle.loads(block)
    return node, weight, m, covertree.Tree(_unit(m) if unit else m, [covertree.Level(*x) for x in levels])


def _flat(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after joining i with j: the smallest label spreads until nothing changes."""
    while True:
        low = np.minimum(labels[i], labels[j])
        if (labels[i] == low).all() and (labels[j] == low).all():
            return labels
        roots = np.concatenate([labels[i], labels[j]])
        both = labels.copy()
        np.minimum.at(both, roots, np.concatenate([low, low]))
        labels = both[labels]


def _linked(blocks: list[tuple], cosine: float) -> pd.DataFrame:
    """Links between two blocks, or inside one: per linked node its links and a node it hangs on."""
    same = len(blocks) == 1
    ns, ws, ms, s = blocks[0]
    nt, wt, mt, t = blocks[-1]
    shift = 0 if same else len(ns)
    links = np.zeros(shift + len(nt), np.int64)
    labels = np.arange(shift + len(nt))
    norm_s, norm_t = np.sqrt((ms * ms).sum(1)), np.sqrt((mt * mt).sum(1))
    for kind, i, j, inside in covertree.dual_pairs(s, t, math.sqrt(2 - 2 * cosine), same):
        if kind == "all":
            if inside:
                links[i] += ws[i].sum() - ws[i]
            else:
                links[i] += wt[j].sum()
                links[shift + j] += ws[i].sum()
            star = np.concatenate([i, shift + j])
            labels = _flat(labels, star, np.full(len(star), star[0]))
            continue
        for at in range(0, len(i), 100_000):
            a, b = i[at:at + 100_000], j[at:at + 100_000]
            if same:
                a, b = a[a != b], b[a != b]
            good = np.einsum("ij,ij->i", ms[a], mt[b]) / (norm_s[a] * norm_t[b]) >= cosine
            a, b = a[good], b[good]
            np.add.at(links, a, wt[b])
            np.add.at(links, shift + b, ws[a])
            labels = _flat(labels, a, shift + b)
    node = ns if same else np.concatenate([ns, nt])
    hit = np.flatnonzero(links)
    return pd.DataFrame({"node": node[hit], "links": links[hit], "root": node[labels[hit]]})


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, block_rows: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding).

    Links: cosine of at least ``cosine`` in double precision. n_links counts the other rows
    linked directly, component_id is the smallest vec_id reachable, kept says whether it is the
    own. Equal vectors form one class first, so copies are never paired with each other. Null
    and zero vectors and those with null or non-finite components link with nothing; vectors of
    other lengths are filled up with zeros. Null vec_ids link but lend no id. Other columns are
    ignored; an empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("vector"))
    sound = finite(F.col("vector")) & F.exists("vector", lambda x: x != 0)
    used = rows.filter(sound)
    classes = cut_lineage(used.groupBy("vector").agg(F.min("vec_id").alias("low"), F.count("*").alias("weight")))
    classes = classes.withColumn("node", F.monotonically_increasing_id())
    width = classes.agg(F.max(F.size("vector"))).first()[0] or 1
    sample = _sampled(classes, width)
    if not len(sample):
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    pivots = _pivots(_unit(sample), PIVOTS)
    placed, blocks, radius = _salted(_cells(classes, pivots, width, True), block_rows)
    packed = cut_lineage(_packed(placed, width, 0.5))
    reach = math.sqrt(2 - 2 * cosine)
    apart = covertree.distances(pivots, pivots)
    numbers, partners = {}, {}
    for c in sorted(blocks):
        numbers[c] = sum(blocks[x] for x in blocks if x < c)
    for c in blocks:  # a few pivots: the stretches of block numbers of all cells that a cell may link with
        partners[c] = [(numbers[x], numbers[x] + blocks[x] - 1) for x in sorted(blocks) if apart[c, x] <= radius[c] + radius[x] + reach + 1e-6]
    own = F.element_at(F.create_map(*[F.lit(x) for kv in numbers.items() for x in kv]), F.col("cell")) + F.col("salt")
    met = F.flatten(F.element_at(F.create_map(*[x for c, p in partners.items() for x in (
        F.lit(c), F.array(*[F.sequence(F.lit(a), F.lit(b)) for a, b in p]))]), F.col("cell")))
    pairs = packed.withColumn("own", own).select("own", "block", F.explode(met).alias("other")).select(
        F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "block")

    def meet(key: tuple, sides: pd.DataFrame) -> pd.DataFrame:
        sides = sides.sort_values("own")
        return _linked([_load(b, True) for b in sides["block"]], cosine)

    found = cut_lineage(pairs.groupBy("i", "j").applyInPandas(meet, "node long, links long, root long"))
    joined = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.join(links, "node", "left").join(joined, "node", "left").select(
        "vector", "low", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    known = named.join(least, "component").select(
        F.col("vector").alias("_v"), (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    # A class may hold a third of the rows; adaptive execution splits such a join's large side.
    told = rows.filter(sound).join(known, F.col("vector") == F.col("_v")).select("vec_id", "n_links", "component_id")
    alone = rows.filter(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return told.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _best(q: tuple, d: tuple, floor: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows of a block for each query of a query block, above each query's floor.

    Query nodes against data nodes: a pair is pruned if no member can reach the group's worst
    floor, |q||r| bounding what a covering radius can add to an inner product.
    """
    qn, _, qm, qt = q
    dn, _, dm, dt = d
    length = np.sqrt((qm * qm).sum(1))
    level, nodes = qt.levels[0], dt.levels[0]
    worst = np.minimum.reduceat(floor[level.order], level.first[:-1])
    centre, data = qm[level.centre], dm[nodes.centre]
    norm_c, norm_d = length[level.centre], np.sqrt((data * data).sum(1))
    got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def cut() -> None:  # keep the k best of each query and raise the floors
        i, j, s = (np.concatenate(x) for x in zip(*got))
        by = np.lexsort((dn[j], -s, i))
        i, j, s = i[by], j[by], s[by]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        keep = place < k
        last = place == k - 1
        floor[i[last]] = np.maximum(floor[i[last]], s[last])
        got[:] = [(i[keep], j[keep], s[keep])]

    for at in range(0, len(centre), 256):
        rows = slice(at, at + 256)
        bound = centre[rows] @ data.T + norm_c[rows, None] * nodes.radius + level.radius[rows, None] * (norm_d + nodes.radius)
        a, b = np.nonzero(bound >= worst[rows, None] - 1e-6 * (1 + np.abs(worst[rows, None])))
        for i, j, _ in covertree._product(level.first, level.order, a + at, nodes.first, nodes.order, b):
            s = np.concatenate([np.einsum("ij,ij->i", qm[i[x:x + 100_000]], dm[j[x:x + 100_000]]) for x in range(0, len(i), 100_000)] or [np.empty(0)])
            keep = (s >= floor[i]) & (qn[i] != dn[j])
            got.append((i[keep], j[keep], s[keep]))
            cut()
        worst = np.minimum.reduceat(floor[level.order], level.first[:-1])
    if not got:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    i, j, s = got[0]
    return pd.DataFrame({"query_id": qn[i], "vec_id": dn[j], "score": s.astype(np.int64)})


def top_k(vectors: DataFrame, queries: Column, k: int = 5, block_rows: int = 8192, query_rows: int = 2048) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of largest integer inner product for each query row.

    Components become floor(256 x); scores are exact as long as they stay below 2 ** 53.
    ``queries`` says which rows are queries; all rows but the query's own are candidates; ties go
    to the smaller vec_id. Null vectors, those with null or non-finite components and rows with
    a null vec_id take no part. Rows with one vec_id count once, with the smallest vector.
    Shorter vectors are filled up with zeros. A query with fewer candidates gets them all.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    whole = F.transform("v", lambda x: F.floor(x * 256).cast("double"))
    used = rows.filter(finite(F.col("v")) & F.col("vec_id").isNotNull()).groupBy(F.col("vec_id").alias("node")).agg(F.min(whole).alias("vector"))
    used = cut_lineage(used.withColumn("weight", F.lit(1)))
    width = used.agg(F.max(F.size("vector"))).first()[0] or 1
    schema = "query_id long, vec_id long, score long"
    asked = used.filter(queries(F.col("node")) if callable(queries) else queries)
    sample_rows = used.orderBy(F.xxhash64("node")).limit(SAMPLE).toPandas()  # bounded: floors to begin with
    if not len(sample_rows):
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample, sample_ids = _matrix(sample_rows["vector"], width), sample_rows["node"].to_numpy(np.int64)
    placed, blocks, _ = _salted(_cells(used, _pivots(sample, PIVOTS), width, False), block_rows)
    data = _packed(placed, width, None)
    n = asked.count()
    shares = max(1, math.ceil(n / query_rows))
    dealt = asked.withColumn("cell", F.lit(0)).withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(shares)).cast("int"))
    groups = _packed(dealt, width, None)
    # The query set against all rows, block by block.
    cells = F.array(*[F.struct(F.lit(c).alias("cell"), F.sequence(F.lit(0), F.lit(m - 1)).alias("salts")) for c, m in blocks.items()])
    left = groups.select(F.col("block").alias("queries"), F.explode(cells).alias("c")).select(
        "queries", "c.cell", F.explode("c.salts").alias("salt"))

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"query_id": [], "vec_id": [], "score": []})]
        for blob in a["queries"]:
            q = _load(blob, False)
            floor = np.full(len(q[0]), -np.inf)
            for at in range(0, len(q[0]), 256):
                s = q[2][at:at + 256] @ sample.T
                s[q[0][at:at + 256, None] == sample_ids] = -np.inf
                if s.shape[1] >= k:
                    floor[at:at + 256] = np.partition(s, -k, axis=1)[:, -k]
            for other in b["block"]:
                out.append(_best(q, _load(other, False), floor.copy(), k))
        return pd.concat(out).astype("int64")

    parts = left.groupBy("cell", "salt").cogroup(data.groupBy("cell", "salt")).applyInPandas(meet, schema)
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return parts.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
