"""Token ids in files compressed by a grammar (Re-Pair), readable at any document.

File format: a Parquet folder, one row per shard (see SHARD). A shard holds the ids of
documents in ascending doc_id order (nulls first), each with the end id. ``sequence`` is the
compressed string of symbols: symbols below ``base`` are token ids, symbol ``base + k`` stands
for the pair ``rules[2k], rules[2k + 1]``; ``expansion[k]`` is the number of token ids it stands
for. ``at`` has the place in ``sequence`` where each document begins, so that a document, or a
range of its ids, is decoded without the rest. No rule crosses the end of a document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.common import look_up, per_worker, text_or_empty
from sessionloom.llm.wordcodec import WordCodec

SHARD = ("part int, shard int, base int, n_ids long, doc_ids binary, null_ids int, at binary, "
         "rules binary, expansion binary, sequence binary")


_NO_PAIR = np.uint32(2**32 - 1)  # where a document ends; no pair of 16-bit symbols below the last


def _slot(pairs: np.ndarray) -> np.ndarray:
    return ((pairs * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16)


def repair(ids: np.ndarray, starts: np.ndarray, base: int, rounds: int = 5, least: int = 64,
           most_rules: int = 15_000) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, starts in it, rules, expansion lengths).

    Each round counts all pairs of neighbours inside documents and replaces, all at once, the
    pairs that occur ``least`` times or more, the most frequent first as far as ``most_rules``
    goes; of overlapping occurrences the leftmost counts. The work ends when no pair is frequent
    or after ``rounds``, which also bounds how deep rules nest. Symbols have 16 bits, so a pair is
    one 32-bit number.
    """
    seq = ids.astype(np.uint16)
    opens = np.zeros(len(seq) + 1, bool)  # where documents begin
    opens[starts] = True
    rules = np.empty((0, 2), np.uint16)
    size = np.empty(0, np.int64)
    for k in range(rounds):
        key = seq[:-1].astype(np.uint32)
        key <<= 16
        key |= seq[1:]
        key[opens[1:-1]] = _NO_PAIR
        order = np.sort(key)
        edge = np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1], [True]))) if len(order) else np.zeros(1, int)
        pairs, count = order[edge[:-1]], np.diff(edge)
        del order
        good = (count >= least) & (pairs != _NO_PAIR)
        pairs, count = pairs[good], count[good]
        room = min(most_rules - len(rules), -(-most_rules // rounds))
        pairs = np.sort(pairs[np.argsort(-count, kind="stable")[:room]])
        if not len(pairs):
            break
        # A pair's rule by a hash; of pairs in one slot the first stays. What an empty slot holds never comes to it.
        slot, own = np.zeros(1 << 16, np.int32), np.full(1 << 16, _NO_PAIR)
        own[_slot(_NO_PAIR[None])] = _NO_PAIR ^ np.uint32(1)
        mixed = _slot(pairs)
        slot[mixed[::-1]], own[mixed[::-1]] = np.arange(len(pairs), dtype=np.int32)[::-1], pairs[::-1]
        mixed = _slot(key)
        hit = np.flatnonzero(own[mixed] == key)
        rule = slot[mixed[hit]]
        del key, mixed
        place = np.arange(len(hit), dtype=np.int32)
        run = np.maximum.accumulate(np.where(np.concatenate(([True], np.diff(hit) != 1)), place, 0))
        first = (place - run) % 2 == 0
        hit, rule = hit[first], rule[first]
        used = np.bincount(rule, minlength=len(pairs)) > 0  # only rules in use are kept
        seq[hit] = (base + len(rules) - 1 + np.cumsum(used)).astype(np.uint16)[rule]
        keep = np.ones(len(seq), bool)
        keep[hit + 1] = False
        left, right = (pairs[used] >> np.uint32(16)).astype(np.uint16), pairs[used].astype(np.uint16)
        part = [np.where(s >= base, size[np.maximum(s.astype(np.int64) - base, 0)] if len(size) else 1, 1) for s in (left, right)]
        rules, size = np.concatenate([rules, np.stack([left, right], axis=1)]), np.concatenate([size, part[0] + part[1]])
        seq, opens = seq[keep], np.append(opens[:-1][keep], False)
    return seq, np.flatnonzero(opens[:-1]), rules, size


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The token ids that symbols stand for."""
    ids, begin, size = _meanings(rules, base)
    return look_up(seq, ids, begin, size)[0]


def _meanings(rules: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The token ids of every symbol one after another, where each symbol's begin, and their number."""
    of, ids = np.arange(base + len(rules)), np.concatenate([np.arange(base), base + np.arange(len(rules))]).astype(np.uint32)
    while (deep := ids >= base).any():
        place = np.cumsum(1 + deep) - 1 - deep
        longer, pair = np.empty(len(ids) + int(deep.sum()), np.uint32), rules[ids[deep] - base]
        longer[place] = ids
        longer[place[deep]], longer[place[deep] + 1] = pair[:, 0], pair[:, 1]
        ids, of = longer, np.repeat(of, 1 + deep)
    size = np.bincount(of, minlength=base + len(rules))
    return ids, np.cumsum(size) - size, size


def decode_range(row, document: int, start: int, stop: int) -> np.ndarray:
    """Token ids start..stop of a shard's document by its place, expanding only what is needed."""
    rules, size, seq, at = _parts(row)
    sub = seq[at[document]:at[document + 1]].astype(np.int64)
    ends = np.cumsum(np.where(sub >= row["base"], size[np.maximum(sub - row["base"], 0)] if len(size) else 1, 1))
    a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    skip = int(ends[a - 1]) if a else 0
    return expand(sub[a:b], rules, row["base"])[start - skip:stop - skip]


def _parts(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return (np.frombuffer(row["rules"], "<u2").astype(np.uint32).reshape(-1, 2), np.frombuffer(row["expansion"], "<u4").astype(np.int64),
            np.frombuffer(row["sequence"], "<u2"), np.frombuffer(row["at"], "<i8"))


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, base: int = 50_257,
                      shard_ids: int = 4_000_000, rounds: int = 5) -> None:
    """Encode documents and write shards of about ``shard_ids`` ids (a longer document is one shard).

    Null texts count as empty; null doc_ids come first; rows with one doc_id are ordered by
    text; other columns are ignored. Symbols are 16 bits wide: ``base`` + 15,000 rules fit.
    """

    def shards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        codec = per_worker(("codec", tokenizer, True), lambda: WordCodec(tokenizer, byte_level=True))
        end = np.array([end_id], "<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        kept: list[bytes] = []
        size = 0

        def shard() -> pd.DataFrame:
            nonlocal number, size
            lengths = np.array([len(x) // 4 for x in kept], np.int64)
            starts = np.concatenate(([0], lengths.cumsum()[:-1]))
            ids = np.frombuffer(b"".join(kept), "<u4")
            seq, at, rules, expansion = repair(ids, starts, base, rounds)
            nulls = sum(d is None for d in doc_ids)
            row = (part, number, base, len(ids), np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(), nulls,
                   np.append(at, len(seq)).astype("<i8").tobytes(), rules.astype("<u2").tobytes(),
                   expansion.astype("<u4").tobytes(), seq.astype("<u2").tobytes())
            doc_ids.clear()
            kept.clear()
            number, size = number + 1, 0
            return pd.DataFrame([row], columns=[c.split()[0] for c in SHARD.split(", ")])

        for b in batches:
            texts, names = b["text"].tolist(), [None if pd.isna(d) else int(d) for d in b["doc_id"]]
            for d, ids in zip(names, codec.each(texts)):
                doc_ids.append(d)
                kept.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= shard_ids:
                    yield shard()
        if kept:
            yield shard()

    plain = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    ordered = plain.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInPandas(shards, SHARD).write.mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Documents of token files: doc_id, start (ids before it), n_tokens, ids_crc32, and ids if asked for."""

    def documents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.to_dict("records"):
                rules, _, seq, at = _parts(row)
                ids, ends = look_up(seq, *_meanings(rules, row["base"]))
                starts = ends[at]
                data = ids.astype("<u4", copy=False).tobytes()
                bounds = (starts * 4).tolist()
                out = pd.DataFrame({
                    "doc_id": pd.array(np.frombuffer(row["doc_ids"], "<i8"), "Int64"), "part": row["part"], "shard": row["shard"],
                    "start": starts[:-1], "n_tokens": np.diff(starts),
                    "ids_crc32": [zlib.crc32(data[a:e]) for a, e in zip(bounds, bounds[1:])],
                    "ids": [data[a:e] if keep_ids else None for a, e in zip(bounds, bounds[1:])]})
                out.loc[:row["null_ids"] - 1, "doc_id"] = pd.NA if row["null_ids"] else out["doc_id"].iloc[0]
                yield out

    files = spark.read.schema(SHARD).parquet(path)
    # One row per shard, some million ids each.
    before = files.select("part", "shard", F.coalesce(
        F.sum("n_ids").over(W.orderBy("part", "shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    rows = files.mapInPandas(documents, "doc_id long, part int, shard int, start long, n_tokens long, ids_crc32 long, ids binary")
    found = rows.join(before, ["part", "shard"]).withColumn("start", F.col("start") + F.col("_before"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * keep_ids)
