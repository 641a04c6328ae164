"""Phrases whose words belong together, by mergeable Misra-Gries summaries and an exact second count.

Phrases are hashed and the hashes dealt over partitions. A task summarises the phrases of a chunk of
texts, which is small enough to be counted whole; the summaries of a hash partition are merged in
one streaming pass that never keeps more counters than a capacity above (phrases seen) / threshold.
By the bound of Misra and Gries no phrase that reaches the threshold can then fall out: what the
merge takes from all counters together stays below the threshold, and is added back before a
counter is judged. Words and pairs of words go first; longer phrases are summarised only where all
their pairs survived, since a phrase is no more frequent than its parts.

The survivors become a bit set of bounded size. The second pass counts the phrases themselves, not
their hashes, wherever the bit set lets them through: what it lets through in vain costs rows, never
a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.common import text_or_empty
from sessionloom.sources.tables import cut_lineage

#: Characters that end a piece, and 0xFF, which no text in UTF-8 holds, in their place.
ENDS = b".,;:!?\n\x0b\x0c\r"
END = b"\xff"
_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ" + ENDS, b"abcdefghijklmnopqrstuvwxyz" + END * len(ENDS))

#: Bytes of text counted at once, and counters per hash partition on average.
CHUNK_BYTES = 2 << 20
COUNTERS = 1 << 18
#: Capacity in units of (phrases seen) / threshold: errors stay below threshold / SLACK.
SLACK = 4
_SUMMARY = "part int, mass long, keys binary, counts binary"
_SLICE_BITS = 16


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Chunk:
    """The words of some documents in a row, as numbers; 0 ends a piece."""

    def __init__(self, langs: list[str], texts: list[bytes]):
        numbers, tongues = _Numbers(), _Numbers()
        numbers[END]  # is 0
        words: list[bytes] = []
        sizes = []
        for text in texts:
            own = text.translate(_FOLD).replace(END, b" \xff ").split()
            own.append(END)
            words += own
            sizes.append(len(own))
        self.word = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        self.names = list(numbers)
        self.lang = np.repeat(np.fromiter((tongues[x] for x in langs), np.int64, len(langs)), sizes)
        self.langs = list(tongues)
        self._words = np.fromiter(map(xxhash.xxh64_intdigest, self.names), np.uint64, len(self.names))
        self._langs = np.fromiter(map(xxhash.xxh64_intdigest, self.langs), np.uint64, len(self.langs))

    def phrases(self, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(words, first places, hashes) of the phrases of one word, of two, and so on, inside pieces."""
        inside = self.word != 0
        own = self._words[self.word]
        at = np.flatnonzero(inside)
        h = _mix(self._langs[self.lang[at]] + own[at])
        for k in range(1, longest + 1):
            yield k, at, h
            more = inside[at + k]  # the last place always ends a piece
            at, h = at[more], h[more]
            h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + own[at + k])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    langs: list[str] = []
    texts: list[bytes] = []
    size = 0
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
            langs.append(lang)
            texts.append(text.as_py())
            size += len(texts[-1]) + 1
            if size >= CHUNK_BYTES:
                yield Chunk(langs, texts)
                langs, texts, size = [], [], 0
    if texts:
        yield Chunk(langs, texts)


def _held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash is set; the first bits of a hash name its place."""
    place = h >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _known(chunk: Chunk, longest: int, known: Broadcast | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Phrases of three words and more whose pairs are all known."""
    pair = np.zeros(len(chunk.word) + longest, bool)
    for k, at, h in chunk.phrases(longest):
        if k == 2:
            pair[at[_held(known.value, h)]] = True
        if k > 2:
            good = np.logical_and.reduce([pair[at + i] for i in range(k - 1)])
            yield k, at[good], h[good]


def merge(keys: list[np.ndarray], counts: list[np.ndarray], capacity: int, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The sum of summaries cut to ``capacity`` counters, and what was taken from every counter for that.

    No more than ``most`` may be taken: a sum that would need it stays as it is.
    """
    h, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, int)
    h, n = h[first], np.add.reduceat(n, first) if len(first) else n
    if len(h) <= capacity:
        return h, n, 0
    lost = int(np.partition(n, len(n) - capacity - 1)[len(n) - capacity - 1])
    if lost > most:
        return h, n, 0
    keep = n > lost
    return h[keep], n[keep] - lost, lost


def _summarise(docs: DataFrame, parts: int, longest: int, known: Broadcast | None) -> DataFrame:
    """One row per chunk and hash partition: how often each hash occurs, whole."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            found = chunk.phrases(longest) if known is None else _known(chunk, longest, known)
            hashes = np.concatenate([h for _, _, h in found])
            keys, counts = np.unique(hashes, return_counts=True)
            part = (keys % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            keys, counts, part = keys[order].astype("<u8"), counts[order].astype("<u4"), part[order]
            edges = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(part) else [0]
            stretch = list(zip(edges[:-1], edges[1:]))
            for i in range(0, len(stretch), 1024):
                some = stretch[i:i + 1024]
                yield pa.RecordBatch.from_arrays([
                    pa.array([int(part[a]) for a, _ in some], pa.int32()),
                    pa.array([int(counts[a:b].sum()) for a, b in some], pa.int64()),
                    pa.array([keys[a:b].tobytes() for a, b in some], pa.binary()),
                    pa.array([counts[a:b].tobytes() for a, b in some], pa.binary())], ["part", "mass", "keys", "counts"])

    return docs.mapInArrow(count, _SUMMARY)


class Summary:
    """The merged counters of one hash partition. A count is too small by at most ``lost``, which stays below ``least``."""

    def __init__(self, least: int, counters: int):
        self.least, self.counters, self.mass, self.lost, self.waiting = least, counters, 0, 0, 0
        self.keys: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, keys: np.ndarray, counts: np.ndarray, mass: int) -> None:
        self.keys.append(keys)
        self.counts.append(counts)
        self.mass += mass
        self.waiting += len(keys)
        if self.waiting > self.counters:
            self.cut()

    def cut(self) -> None:
        capacity = max(self.counters, SLACK * (self.mass // self.least + 1))
        h, n, lost = merge(self.keys, self.counts, capacity, self.least - 1 - self.lost)
        self.keys, self.counts, self.lost, self.waiting = [h], [n], self.lost + lost, 0

    def frequent(self) -> np.ndarray:
        self.cut()
        return self.keys[0][self.counts[0] + self.lost >= self.least]


def _survivors(summaries: DataFrame, least: int, counters: int) -> DataFrame:
    """Hashes that may occur ``least`` times or more: all that do, and few others."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, own = None, Summary(least, counters)
        for b in batches:
            for p, m, k, c in zip(b["part"], b["mass"], b["keys"], b["counts"]):
                if part is not None and p != part:
                    yield pd.DataFrame({"hash": own.frequent().astype(np.int64)})
                    own = Summary(least, counters)
                part = p
                own.add(np.frombuffer(k, "<u8"), np.frombuffer(c, "<u4"), m)
        if part is not None:
            yield pd.DataFrame({"hash": own.frequent().astype(np.int64)})

    return summaries.repartition("part").sortWithinPartitions("part").mapInPandas(walk, "hash long")


def _bit_set(survivors: DataFrame, most_bits: int) -> np.ndarray:
    """Bits of the survivors, sixteen or more times as many as survivors, at most 2 ** most_bits.

    Built slice by slice on the executors; the driver puts at most 2 ** (most_bits - 16) slices in a row.
    """
    survivors = cut_lineage(survivors)
    bits = max(_SLICE_BITS, min(most_bits, (16 * survivors.count()).bit_length()))

    def slice_(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        own = np.zeros(1 << _SLICE_BITS, np.uint8)
        own[rows["place"].to_numpy()] = 1
        return pd.DataFrame([(int(key[0]), np.packbits(own, bitorder="little").tobytes())], columns=["slice", "bits"])

    place = F.shiftrightunsigned("hash", 64 - bits)
    places = survivors.select(F.shiftright(place, _SLICE_BITS).cast("int").alias("slice"),
                              place.bitwiseAND(F.lit((1 << _SLICE_BITS) - 1)).cast("int").alias("place")).distinct()
    out = np.zeros((1 << bits) // 8, np.uint8)
    size = (1 << _SLICE_BITS) // 8
    for r in places.groupBy("slice").applyInPandas(slice_, "slice int, bits binary").collect():
        out[r["slice"] * size:(r["slice"] + 1) * size] = np.frombuffer(r["bits"], np.uint8)
    return out


def _differ(word: np.ndarray, at: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    return np.logical_or.reduce([word[at + i] != word[first + i] for i in range(k)])


def _counted(docs: DataFrame, longest: int, short: Broadcast, long: Broadcast) -> DataFrame:
    """lang, words, phrase, n of the phrases that the bit sets let through, per chunk; words 0: all words of the chunk."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches):
            out: list[tuple[str, int, str, int]] = []
            for k, at, h in chunk.phrases(longest):
                if k == 1:
                    every = np.bincount(chunk.lang[at], minlength=len(chunk.langs))
                    out += [(lang, 0, "", int(n)) for lang, n in zip(chunk.langs, every)]
                passed = _held((short if k <= 2 else long).value, h)
                at, h = at[passed], h[passed]
                while len(at):  # phrases are told by their words: those that only share a hash wait for the next turn
                    _, first, which, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
                    other = _differ(chunk.word, at, at[first][which], k) | (chunk.lang[at] != chunk.lang[at[first]][which])
                    if other.any():
                        n = n - np.bincount(which[other], minlength=len(first))
                    for place, c in zip(at[first].tolist(), n.tolist()):
                        phrase = b" ".join([chunk.names[w] for w in chunk.word[place:place + k]])
                        out.append((chunk.langs[chunk.lang[place]], k, phrase.decode(), c))
                    at, h = at[other], h[other]
            lang, words, phrase, n = zip(*out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(lang, pa.string()), pa.array(words, pa.int32()), pa.array(phrase, pa.string()), pa.array(n, pa.int64())],
                ["lang", "words", "phrase", "n"])

    return docs.mapInArrow(count, "lang string, words int, phrase string, n long")


def frequencies(docs: DataFrame, least: int = 100, longest: int = 5, counters: int = COUNTERS, most_bits: int = 27) -> DataFrame:
    """lang, words, phrase, n: all phrases of up to ``longest`` words that occur ``least`` times or more in a
    language, with their exact counts; rows with words 0 hold the number of all words of a language.

    ``counters``: counters kept by a merging task for a hash partition, about. ``most_bits``: the bit sets
    sent to the tasks have at most 2 ** most_bits bits each.
    """
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_or_empty().cast("binary").alias("text"))
    # A text of b bytes has at most (b + 1) / 2 words, each begins at most one phrase of a length.
    most = docs.agg(F.sum(F.octet_length(text_or_empty()) + 1)).first()[0] or 0
    parts = max(1, -(-most * SLACK // (least * counters)))
    short = sc.broadcast(_bit_set(_survivors(_summarise(texts, parts, min(2, longest), None), least, counters), most_bits))
    long = short
    if longest > 2:
        long = sc.broadcast(_bit_set(_survivors(_summarise(texts, parts, longest, short), least, counters), most_bits))
    found = _counted(texts, longest, short, long).groupBy("lang", "words", "phrase").agg(F.sum("n").alias("n"))
    return cut_lineage(found.filter((F.col("words") == 0) | (F.col("n") >= least)))


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000, **options) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` best phrases of two to ``longest`` words of each language.

    Texts are lower-cased (A-Z) and cut into pieces at .,;:!? and line ends; words lie between spaces and
    tabs. a counts the phrase, n all words of the language; cut after its first k words, l and r count
    its parts and the score is floor(1000 a n / (l r)); the lowest cut counts, then the smallest k. A
    phrase that lies in a longer candidate as frequent as itself is dropped. Order: score, a (both
    falling), phrase (bytes, rising).

    Null texts are empty, a null lang is ``und``, repeated rows count each time, texts without words
    give nothing, other columns are ignored, and an empty table gives an empty result. ``options``:
    see frequencies.
    """
    known = frequencies(docs, least, longest, **options)
    every = known.filter("words = 0").select("lang", F.col("n").alias("n"))
    part = known.filter("words > 0").select("lang", "phrase", "n")
    phrases = known.filter("words > 1").select("lang", "words", "phrase", F.col("n").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("left"),
                       F.array_join(F.slice("w", F.col("k") + 1, F.col("words")), " ").alias("right"))
    both = (cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"])
            .join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
            .join(every, "lang"))
    scaled = both.withColumns({"_up": _wide(F.col("a")) * _wide(F.col("n")) * F.lit(1000).cast("decimal(4,0)"),
                               "_down": _wide(F.col("l")) * _wide(F.col("r"))})
    best = scaled.groupBy("lang", "phrase").agg(
        F.min(F.struct(F.expr("_up div _down").alias("score"), "k", "l", "r", "a", "n")).alias("b"))
    # Parts of a candidate, two words or more but not all of it, with the count of the largest candidate around them.
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("words") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))
    inner = phrases.filter("words > 2").select("lang", "a", F.explode(F.array_distinct(spans)).alias("phrase"))
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = best.join(around, ["lang", "phrase"], "left").filter(F.coalesce(F.col("around") < F.col("b.a"), F.lit(True)))
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    rows = left.select("lang", "phrase", "b.a", "b.l", "b.r", "b.n", "b.score")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
