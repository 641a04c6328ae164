"""Toxic passages: maximum-scoring segments over token log-odds, calibrated by extreme values.

1. Of labelled rows, every word (and its first 4 to 6 letters, for words not seen before) gets
   the log-odds of toxic against clean documents under a symmetric Dirichlet prior. Units that
   speak for toxicity significantly form the lexicon; any other token scores a small penalty.
   A unit counts once for each different word before it, so that copies of a text count once.
2. One linear scan finds all maximal segments of positive score (Ruzzo and Tompa).
3. A segment of score S in n tokens has the expectation E = K n exp(-lambda S) under clean text
   (Karlin and Altschul), with lambda and K from clean rows that the lexicon was not made of;
   the evidence of a document is the sum of -ln E over its segments with E < 1.
4. The evidence is turned into a probability by a logistic curve on those same rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.llm.common import text_or_empty
from sessionloom.sources.tables import cut_lineage

SPLIT = r"[^\p{L}\p{N}]+"
_WORD = re.compile(r"[^\W_]+")
PREFIXES = (6, 5, 4)


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]  # words, and openings with a star, by log-odds
    penalty: float
    rate: float  # lambda
    k: float
    curve: tuple[float, float]

    def token(self, word: str) -> float:
        found = self.lexicon.get(word)
        if found is not None:
            return found
        for n in PREFIXES:
            if len(word) > n and (found := self.lexicon.get(word[:n] + "*")) is not None:
                return found
        return -self.penalty


class _Scores(dict):
    """Scores of words met so far, forgotten when they are many."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> float:
        if len(self) > 200_000:
            self.clear()
        self[word] = score = self.model.token(word)
        return score


def segments(scores: np.ndarray, penalty: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one pass over the positive tokens.

    Tokens between positive ones score -penalty each. A new positive token is merged with
    earlier segments as long as one has a lower sum before it and a lower sum at its end.
    """
    out: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum at the end
    total, last = 0.0, -1
    for i in np.flatnonzero(scores > 0).tolist():
        total -= penalty * (i - last - 1)
        start, before = i, total
        total += float(scores[i])
        last = i
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= before:
                j -= 1
            if j < 0 or out[j][3] >= total:
                out.append((start, i + 1, before, total))
                break
            start, before = out[j][0], out[j][2]
            del out[j:]
    return [(a, b, e - s) for a, b, s, e in out]


def _scan(model: Model, texts, memo: _Scores) -> Iterator[tuple[int, list[tuple[int, int, float]], np.ndarray]]:
    for t in texts:
        words = _WORD.findall(t.lower())
        scores = np.fromiter(map(memo.__getitem__, words), np.float64, len(words))
        yield len(words), segments(scores, model.penalty), scores


def evidence(model: Model, n: int, found: list[tuple[int, int, float]]) -> float:
    """Sum of -ln E over the significant segments."""
    floor = math.log(max(model.k * n, 1e-12))
    return sum(max(0.0, model.rate * s - max(floor, 0.0)) for _, _, s in found)


def probability(model: Model, x: float) -> float:
    a, b = model.curve
    return 1 / (1 + math.exp(-min(max(a + b * math.log1p(x), -30.0), 30.0)))


def sample_labels(labels: DataFrame, usable: Column, rows: int) -> DataFrame:
    """(doc_id, toxic) of at most ``rows`` labelled documents of each class, by hash; the larger label counts."""
    one = labels.filter(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    parts = [one.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for c in (0, 1)]
    return cut_lineage(parts[0].unionByName(parts[1]))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = 20_000, units: int = 50_000, prior: float = 0.5,
        least: int = 3, odds: float = 2.0, z: float = 3.3, penalty: float = 0.25) -> Model:
    """A model from labelled documents.

    ``rows`` bounds the labelled rows of each class that are used, ``units`` the lexicon; both
    keep what reaches the driver small. ``usable`` says which rows of ``labels`` may be learnt
    from. Without any toxic label the lexicon is empty and all scores are the base rate.
    """
    sample = sample_labels(labels, usable, rows)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # At most 2 * rows pairs of numbers are broadcast.
    known = text.join(F.broadcast(sample), "doc_id").withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) > 0)
    learn = known.filter("own")
    words = F.filter(F.split(F.lower("text"), SPLIT), lambda w: w != "")
    pairs = learn.select("toxic", F.explode(F.arrays_zip(words.alias("word"), F.concat(F.array(F.lit("")), words).alias("before"))).alias("p"))
    seen = pairs.filter("p.word is not null").groupBy("p.word", "p.before").agg(
        F.max("toxic").alias("a"), F.max(1 - F.col("toxic")).alias("b"))
    counted = cut_lineage(seen.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b")))
    openings = counted.select("a", "b", "word", F.explode(F.array(*[F.lit(n) for n in PREFIXES])).alias("n")).filter(
        F.char_length("word") > F.col("n")).groupBy(F.concat(F.substring("word", F.lit(1), F.col("n")), F.lit("*")).alias("word")).agg(
        F.sum("a").alias("a"), F.sum("b").alias("b"))
    total = counted.agg(F.sum("a"), F.sum("b")).first()

    def share(count: str, of: float | None) -> Column:
        return F.log((F.col(count) + prior) / (float(of or 0) - F.col(count) + prior))

    both = counted.unionByName(openings).filter(F.col("a") >= least).withColumn("odds", share("a", total[0]) - share("b", total[1]))
    both = both.withColumn("z", F.col("odds") / F.sqrt(1 / (F.col("a") + prior) + 1 / (F.col("b") + prior)))
    top = both.filter((F.col("odds") >= odds) & (F.col("z") >= z)).orderBy(F.col("z").desc(), "word").limit(units).collect()
    model = Model({r["word"]: float(r["odds"]) for r in top}, penalty, 1.0, 0.1, (0.0, 0.0))
    return _calibrate(model, known.filter("not own"))


def _calibrate(model: Model, rows: DataFrame) -> Model:
    """lambda, K and the curve from held-back rows (bounded: see sample_labels); numbers only reach the driver."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Scores(model)
        for b in batches:
            out = []
            for toxic, (n, found, scores) in zip(b["toxic"], _scan(model, b["text"], memo)):
                out.append((int(toxic), n, [s for _, _, s in found], [float(s) for s in scores[scores > 0]]))
            yield pd.DataFrame(out, columns=["toxic", "n", "found", "hits"])

    seen = rows.mapInPandas(run, "toxic int, n long, found array<double>, hits array<double>").collect()
    clean = [r for r in seen if not r["toxic"]]
    tokens = sum(r["n"] for r in clean) + 1
    hits = np.array([s for r in clean for s in r["hits"]] + [max(model.lexicon.values(), default=1.0)])  # one more, as a prior

    def moment(rate: float) -> float:  # E exp(rate * score) of a clean token
        return float(np.exp(rate * hits).sum() + (tokens - len(hits)) * math.exp(-rate * model.penalty)) / tokens

    low, high = 1e-3, 20.0  # the root above 0, if the mean score is negative
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if moment(mid) < 1 else (low, mid)
    rate = min(max(low, 0.05), 5.0)
    bar = 2.0 / rate
    k = (sum(s >= bar for r in clean for s in r["found"]) + 1) / (tokens * math.exp(-rate * bar))
    model = Model(model.lexicon, model.penalty, rate, k, (0.0, 0.0))
    x = np.array([math.log1p(evidence(model, r["n"], [(0, 0, s) for s in r["found"]])) for r in seen])
    y = np.array([float(r["toxic"]) for r in seen])
    design, beta = np.stack([np.ones(len(x)), x], axis=1), np.array([-2.0, 1.0])
    for _ in range(50):  # logistic regression with a weak pull to the start
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - 0.1 * (beta - np.array([-2.0, 1.0]))
        beta = beta + np.linalg.solve((design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2), gradient)
    return Model(model.lexicon, model.penalty, rate, k, (float(beta[0]), max(float(beta[1]), 0.0)))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, score, predicted, evidence, passages (start, end, score in tokens) of every row.

    Null and empty texts have no passage and get the curve's foot. Null doc_ids and repeated rows
    are kept; other columns are ignored; no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Scores(model)
        for b in batches:
            out = []
            for n, found, _ in _scan(model, b["text"], memo):
                x = evidence(model, n, found)
                p = probability(model, x)
                bar = math.log(max(model.k * n, 1.0)) / model.rate
                out.append((p, int(p >= threshold), x, [f for f in found if f[2] > bar]))
            rows = pd.DataFrame(out, columns=["score", "predicted", "evidence", "passages"])
            rows.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield rows

    schema = "doc_id long, score double, predicted int, evidence double, passages array<struct<start:long,end:long,score:double>>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInPandas(run, schema)


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whatever their columns, whose text scores below the threshold; no shuffle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        memo = _Scores(model)
        for b in batches:
            texts = (t or "" for t in b.column(b.schema.names.index("text")).to_pylist())
            p = [probability(model, evidence(model, n, found)) for n, found, _ in _scan(model, texts, memo)]
            yield b.filter(pa.array([x < threshold for x in p], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
