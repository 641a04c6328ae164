"""Hard negatives of anchors, by exact inner products of packed integers (Kronecker substitution).

Rows are dealt by hash into blocks. Within a block the rows of a label stand together, and for each
component the values of up to FIELDS rows, made non-negative by a bias, lie in separate fields of one
wide integer. An anchor's component multiplies that integer once and so all its rows; the sum over
the components holds every row's biased product in its field, from which the bias is taken away. A
field is wide enough for the largest sum that the table's least and greatest components allow, so
nothing carries over and scores are exact.

Anchors, a stated share of all rows, meet every block: first the rows of their own label, for their
positives, then all other rows, for negatives in the stretch below each positive's score.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from operator import mul

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.sources.tables import cut_lineage

#: Rows packed into one wide integer.
FIELDS = 256


def field_bytes(width: int, low: int, high: int) -> int:
    """Bytes of a field that holds any sum of ``width`` products of biased components."""
    largest = width * (high - low) ** 2
    return next(b for b in (4, 8, 16, 32) if largest < 1 << (8 * b))


class Packed:
    """Rows of integers packed by component. Scores are exact whatever the sizes of the components."""

    def __init__(self, rows: np.ndarray, low: int, high: int):
        self.n, self.width = rows.shape
        self.low, self.bytes = low, field_bytes(self.width, low, high)
        biased = (rows - low).astype("<u8")
        # Taken away later: low * (sum of a row's biased values) and the anchor's own share.
        self.sums = biased.astype(object).sum(1) if self.bytes > 4 else biased.sum(1).astype(np.int64)
        self.wide = []
        for at in range(0, self.n, FIELDS):
            part = biased[at:at + FIELDS]
            fields = np.zeros((self.width, len(part), self.bytes), np.uint8)
            fields[:, :, :min(8, self.bytes)] = np.ascontiguousarray(part.T).view(np.uint8).reshape(
                self.width, len(part), 8)[:, :, :min(8, self.bytes)]
            self.wide.append([int.from_bytes(f.tobytes(), "little") for f in fields])

    def _fields(self, total: int, count: int) -> np.ndarray:
        raw = total.to_bytes(count * self.bytes, "little")
        if self.bytes == 4:
            return np.frombuffer(raw, "<u4").astype(np.int64)
        return np.array([int.from_bytes(raw[i:i + self.bytes], "little") for i in range(0, len(raw), self.bytes)], object)

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Inner product of the anchor with every row, as 64-bit integers."""
        own = [int(x) - self.low for x in anchor]
        found = [self._fields(sum(map(mul, own, wide)), min(FIELDS, self.n - FIELDS * g)) for g, wide in enumerate(self.wide)]
        if not found:
            return np.zeros(0, np.int64)
        shift = self.low * sum(own) + self.low * self.low * self.width
        out = np.concatenate(found) + self.low * self.sums + shift
        if self.bytes > 4 and any(abs(x) >= 1 << 63 for x in out):
            raise OverflowError("a score does not fit into 64 bits")
        return out.astype(np.int64)


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for k, r in enumerate(column):
        out[k, :len(r)] = r
    return out


def usable(vectors: DataFrame, relabel: Callable[[Column, Column], Column]) -> DataFrame:
    """node, label, vector (floor(256 x) of every component) of the rows that take part."""
    v = F.col("v")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("node"), F.col("label").cast("long").alias("label"),
                          F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.filter(F.col("node").isNotNull() & F.col("label").isNotNull() & v.isNotNull() & ~bad)
    whole = F.transform(v, lambda x: F.floor(x * 256))
    one = F.min(F.struct(relabel(F.col("node"), F.col("label")).alias("label"), whole.alias("vector")))
    return rows.groupBy("node").agg(one.alias("r")).select("node", "r.label", "r.vector")


def _first(node: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k rows of highest score, ties to the smaller node."""
    if len(score) > k:
        kth = np.partition(score, len(score) - k)[len(score) - k]
        some = np.flatnonzero(score >= kth)
    else:
        some = np.arange(len(score))
    return some[np.lexsort((node[some], -score[some]))[:k]]


def _blocks(rows: pd.DataFrame, width: int, low: int, high: int) -> dict[int, tuple[np.ndarray, Packed]]:
    """Per label its nodes and packed rows."""
    label = rows["label"].to_numpy(np.int64)
    node, m = rows["node"].to_numpy(np.int64), _matrix(rows["vector"], width)
    return {int(x): (node[label == x], Packed(m[label == x], low, high)) for x in np.unique(label)}


def _ranked(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("score").desc(), "node"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def mine(vectors: DataFrame, anchors: Callable[[Column], Column], positives: int = 5, negatives: int = 5,
         share: tuple[int, int] = (80, 100), relabel: Callable[[Column, Column], Column] = lambda node, label: label,
         block_rows: int = 8192, anchor_rows: int = 2048) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components become floor(256 x); the score of two rows is their integer inner product. An anchor's
    positives are its ``positives`` best other rows of its label; for each, the ``negatives`` best rows of
    other labels with share[0] * positive_score <= share[1] * negative_score <= share[1] * positive_score.
    Ties go to the smaller vec_id; where there are fewer, all are returned.

    Rows with a null label, vec_id or vector, or with null or non-finite components, take no part. Rows
    that repeat a vec_id count once (smallest label, then smallest vector). Shorter vectors are filled
    up with zeros. Other columns are ignored; an empty table gives an empty result.
    """
    used = cut_lineage(usable(vectors, relabel))
    x = F.col("vector")
    n, width, low, high = used.agg(F.count("*"), F.max(F.size(x)), F.min(F.array_min(x)), F.max(F.array_max(x))).first()
    width, low, high = width or 1, min(low or 0, 0), max(high or 0, 0)
    blocks = max(1, math.ceil(n / block_rows))
    data = used.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int"))
    asked = used.filter(anchors(F.col("node")))
    shares = max(1, math.ceil(asked.count() / anchor_rows))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(shares)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("part")
    data = data.select("node", "label", "vector", "block", every)
    each = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")

    def best(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            held = _blocks(right[right["label"].isin(set(left["label"]))], width, low, high)
            for a, label, v in zip(left["node"], left["label"], _matrix(left["vector"], width)):
                if label in held:
                    node, packed = held[label]
                    s = packed.scores(v)
                    other = node != a
                    ids, s = node[other], s[other]
                    out += [(a, int(ids[i]), int(s[i])) for i in _first(ids, s, positives)]
        return pd.DataFrame(out, columns=["anchor", "node", "score"]).astype("int64")

    keys = ["part", "block"]
    met = asked.select("part", "node", "label", "vector", each).groupBy(*keys).cogroup(data.groupBy(*keys))
    near = _ranked(met.applyInPandas(best, "anchor long, node long, score long"), ["anchor"], positives)
    wanted = near.groupBy("anchor").agg(F.collect_list("node").alias("near"), F.collect_list("score").alias("tops"))
    known = cut_lineage(asked.join(wanted, asked["node"] == wanted["anchor"]).select("part", "node", "label", "vector", "near", "tops"))

    def hard(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            held = _blocks(right, width, low, high)
            for a, label, v, nearest, tops in zip(left["node"], left["label"], _matrix(left["vector"], width), left["near"], left["tops"]):
                others = [(node, packed.scores(v)) for x, (node, packed) in held.items() if x != label]
                if not others:
                    continue
                ids, s = np.concatenate([o[0] for o in others]), np.concatenate([o[1] for o in others])
                by = np.lexsort((ids, -s))
                falling = -s[by]
                for positive, top in zip(nearest.tolist(), tops.tolist()):
                    least = -(-share[0] * top // share[1])  # the smallest whole score in the stretch
                    at, end = np.searchsorted(falling, -top, "left"), np.searchsorted(falling, -least, "right")
                    out += [(a, positive, top, int(ids[i]), int(s[i])) for i in by[at:min(end, at + negatives)]]
        return pd.DataFrame(out, columns=["anchor", "positive", "positive_score", "node", "score"]).astype("int64")

    schema = "anchor long, positive long, positive_score long, node long, score long"
    met = known.select("part", "node", "label", "vector", "near", "tops", each).groupBy(*keys).cogroup(data.groupBy(*keys))
    found = _ranked(met.applyInPandas(hard, schema), ["anchor", "positive"], negatives)
    return found.select(F.col("anchor").alias("anchor_id"), F.col("positive").alias("positive_id"), "rank",
                        F.col("node").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
