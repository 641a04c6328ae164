"""SimHash near-duplicates: fingerprints of word shingles, joined by ball hashing.

Two fingerprints within 3 bits agree, in one of their 32-bit halves, up to one bit. So every
fingerprint emits, of each half, all variants within half the radius (one bit) and they meet on
variants: whoever is within a bit of a fingerprint's half lands in the bucket of that half
itself. Pairs in a bucket are verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import text_or_empty
from sessionloom.llm.components import components
from sessionloom.sources.tables import cut_lineage

RADIUS = 3


def fingerprint(text: str, words: int = 3) -> int:
    """64 bits: bit b is set if it is set in over half of the shingles' XXH64 (seed 42).

    Words are runs of anything but ASCII white space, A-Z in lower case; a shingle is ``words``
    of them joined by spaces, repeats included; a shorter text is one shingle, an empty one 0.
    """
    from xxhash import xxh64_intdigest

    found = text.encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    if len(found) < words:
        shingles = [b" ".join(found)]
    else:
        shingles = list(map(b" ".join, zip(*(found[k:] for k in range(words)))))
    hashes = np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64, len(shingles))
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        part = hashes[k:k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the 64 bits as a long. Null texts count as empty; other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fps})

    return docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")).mapInPandas(run, "doc_id long, fp long")


def _links(fps: np.ndarray, base: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Edges that join what is linked in a bucket: a forest over pairs with a member of its own half.

    Breadth first: each member is taken once and looks at those not yet reached.
    """
    us, vs = [], []
    alone = np.arange(len(fps))
    while len(alone):
        queue, alone = [alone[0]], alone[1:]
        while queue and len(alone):
            x = queue.pop()
            near = np.bitwise_count(fps[alone] ^ fps[x]) <= RADIUS
            if not base[x]:
                near &= base[alone]
            if near.any():
                reached, alone = alone[near], alone[~near]
                us.append(np.full(len(reached), fps[x]))
                vs.append(fps[reached])
                queue.extend(reached.tolist())
    return us, vs


def _meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, fp) sorted by key: verified links of each bucket (u, v)."""
    kept_key, kept_fp = np.empty(0, np.int64), np.empty(0, np.uint64)
    half = np.uint64(0xFFFFFFFF)

    def work(key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
        own = np.where(key >> 32 == 1, fp >> np.uint64(32), fp & half) == (key.astype(np.uint64) & half)
        sizes = np.diff(edge)
        two = edge[:-1][sizes == 2]
        good = two[(np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS) & (own[two] | own[two + 1])]
        us, vs = [fp[good]], [fp[good + 1]]
        bases = np.add.reduceat(own, edge[:-1]) if len(own) else own
        for k in np.flatnonzero((sizes > 2) & (bases > 0)):
            a, b = _links(fp[edge[k]:edge[k + 1]], own[edge[k]:edge[k + 1]])
            us += a
            vs += b
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        return pd.DataFrame({"u": u, "v": v}).drop_duplicates()

    for b in batches:
        key = np.concatenate([kept_key, b["key"].to_numpy(np.int64)])
        fp = np.concatenate([kept_fp, b["fp"].to_numpy(np.int64).view(np.uint64)])
        last = np.searchsorted(key, key[-1]) if len(key) else 0  # the last bucket may go on
        if last:
            yield work(key[:last], fp[:last])
        kept_key, kept_fp = key[last:], fp[last:]
    if len(kept_key):
        yield work(kept_key, kept_fp)


def linked_fingerprints(fps: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``fp`` that join all within RADIUS of each other."""
    fp = F.col("fp")
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    flips = F.array(F.lit(0), *[F.lit(1 << b) for b in range(32)]).cast("array<bigint>")
    keys = F.concat(F.transform(flips, lambda f: low.bitwiseXOR(f)),
                    F.transform(flips, lambda f: high.bitwiseXOR(f).bitwiseOR(F.lit(1 << 32))))
    variants = fps.select("fp").select("fp", F.explode(keys).alias("key"))
    return variants.repartition("key").sortWithinPartitions("key", "fp").mapInPandas(_meet, "u long, v long")


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, one row per row of ``docs``.

    component_id: the smallest doc_id reachable over links (fingerprints that differ in at most
    RADIUS bits), itself included. Equal fingerprints are joined first, so that copies cost one
    row each. Rows with a null doc_id link like others but lend no id; an all-null component has
    a null id. Empty texts share the fingerprint 0. An empty table gives an empty result.
    """
    found = cut_lineage(fingerprints(docs, words))
    classes = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("low")))
    named = components(linked_fingerprints(classes)).withColumnRenamed("node", "fp")
    rooted = classes.join(named, "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    least = rooted.groupBy("component").agg(F.min("low").alias("component_id"))
    ids = rooted.join(least, "component").select("fp", "component_id")
    # A class may hold a third of the rows; adaptive execution splits such a join's large side.
    return found.join(ids, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """One row of each near-duplicate component: the one of its smallest doc_id.

    Of rows with one doc_id one stays. Rows without a doc_id cannot be named as anyone's copy
    and stay.
    """
    found = near_duplicates(docs, words)
    kept = found.filter(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.unionByName(docs.filter(F.col("doc_id").isNull()))
