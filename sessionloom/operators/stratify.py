"""Folds and splits that keep label proportions, and score profiles.

Where label vectors repeat, a stratum is a distinct vector: rows are dealt out inside their stratum in
the order of a hash of their id. Strata are few and large, so their rows are numbered in slices.

Where most vectors are unique, labels are kept in proportion one by one: in rounds, the label with the
fewest rows left is taken, and all its rows are dealt so that each fold gets what it still lacks of
that label. There are as many rounds as labels, and one for the rows that are left. Common labels
come last, when few of their rows are left to even them out; some rows then change folds, as long
as that brings all the labels' shares, taken together, nearer to their goals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.constants import HOT_ROWS
from sessionloom.functions import expressions as X
from sessionloom.operators import ordering
from sessionloom.operators.training import evenly, shares_of
from sessionloom.sources.tables import cut_lineage


def _numbered(df: DataFrame, id_col: str, labels: list[str], seed: Column, hot_rows: int,
              also: tuple[str, ...] = ()) -> DataFrame:
    """Add the row's place in its stratum, the stratum's size, and the rows in strata before it.

    There is one stratum per distinct label vector (at most 2^labels), so the window over
    strata is small. ``also`` names columns that number the strata separately.
    """
    keys = [*also, *labels]
    hashed = df.withColumn("_h", seed)
    sizes = ordering.key_sizes(hashed, keys)
    placed = ordering.positions(hashed, keys, ["_h", id_col], "_pos", hot_rows, sizes)
    before = W.partitionBy(*also).orderBy(*labels).rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.col("n").alias("_size"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_start"))
    return ordering.spread_join(placed, starts, keys, salt_by=[id_col], hot_rows=hot_rows, sizes=sizes).drop("_h")


def _fold(folds: int) -> Column:
    return F.pmod(F.col("_start") + F.col("_pos") - 1, F.lit(folds)).cast("int")


def stratified_folds(df: DataFrame, id_col: str, labels: list[str], folds: int = 3, seed: int = 0,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``fold``: each label vector is spread evenly, and so is the whole frame."""
    numbered = _numbered(df, id_col, labels, X.spread(F.col(id_col), seed), hot_rows)
    return numbered.withColumn("fold", _fold(folds)).drop("_pos", "_start", "_size")


def repeated_folds(df: DataFrame, id_col: str, labels: list[str], folds: int = 5, repeats: int = 10,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """stratified_folds once per repeat, each with another order of dealing."""
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = X.spread(F.col(id_col) + F.col("repeat") * 1000003, 1)
    return _numbered(many, id_col, labels, order, hot_rows, ("repeat",)).withColumn("fold", _fold(folds)).drop(
        "_pos", "_start", "_size")


def stratified_split(df: DataFrame, id_col: str, labels: list[str], test_size: float = 0.1, seed: int = 0,
                     hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``is_test``: the rounded share of each label vector."""
    sized = _numbered(df, id_col, labels, X.spread(F.col(id_col), seed), hot_rows)
    n_test = F.floor(F.col("_size") * F.lit(test_size) + 0.5)
    return sized.withColumn("is_test", F.col("_pos") <= n_test).drop("_pos", "_start", "_size")


def _dealt_by_label(df: DataFrame, id_col: str, labels: list[str], weights: list[int], order: Column, also: list[str],
                    hot_rows: int) -> DataFrame:
    """Add ``fold``: each fold gets its weight's share of every label; ``also`` names columns that number separate dealings.

    A label is a column that is not 0. What a fold lacks of a label is counted in units of 1 / (sum of
    weights), so it is a whole number; the next row goes to the fold that lacks most (ties: the first).
    """
    whole, spark = sum(weights), df.sparkSession
    has = {c: F.coalesce(F.col(c).cast("double") != 0, F.lit(False)) for c in labels}
    counts = [F.count("*").alias("n"), *[F.count_if(h).alias(c) for c, h in has.items()]]
    rows = cut_lineage(df.withColumn("_h", order))
    # Which round takes a row does not depend on the folds: that of its first label in the order of the rounds.
    rounds: list[str] = []
    while True:
        rest = rows
        for c in rounds:
            rest = rest.filter(~has[c])
        waiting = rest.agg(*counts).first()
        left = [c for c in labels if c not in rounds and waiting[c]]
        if not left:
            break
        rounds.append(min(left, key=lambda c: (waiting[c], labels.index(c))))
    of_row = F.lit(len(rounds))
    for r, c in reversed(list(enumerate(rounds))):
        of_row = F.when(has[c], r).otherwise(of_row)
    keys = [*also, "_round"]
    placed = cut_lineage(ordering.positions(rows.withColumn("_round", of_row), keys, [*labels, "_h", id_col], "_pos", hot_rows))
    totals = {tuple(t[k] for k in also): t for t in rows.groupBy(*also).agg(*counts).collect()}
    sizes = {(tuple(r[k] for k in also), r["_round"]): r["n"] for r in placed.groupBy(*keys).agg(F.count("*").alias("n")).collect()}
    types = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = ", ".join([*[f"{k} {types[k]}" for k in keys], "_count long", "_quotas array<long>"])

    def dealt(quotas: list[tuple]) -> DataFrame:
        told = F.broadcast(spark.createDataFrame(quotas, schema))  # a row per dealing and round
        fold = evenly(F.col("_pos") - 1, [F.col("_quotas")[k] for k in range(len(weights))], F.col("_count"))
        return placed.join(told, keys).withColumn("fold", fold)

    given: dict[tuple, dict[str, list[int]]] = {t: {c: [0] * len(weights) for c in [*labels, "n"]} for t in totals}
    quotas: list[tuple] = []
    for r, label in enumerate([*rounds, "n"]):
        now = []
        for t, total in totals.items():
            if count := sizes.get((t, r)):
                # Lightest first: what a fold has beyond its share, in units.
                beyond = [whole * g - total[label] * w for g, w in zip(given[t][label], weights)]
                now.append((*t, r, count, shares_of(beyond, whole, count)))
        quotas += now
        if now and label != "n":
            for f in dealt(now).groupBy(*also, "fold").agg(*counts).collect():
                for c, own in given[tuple(f[k] for k in also)].items():
                    own[f["fold"]] += f[c]
    return dealt(quotas).drop("_round", "_pos", "_count", "_quotas")


#: Rows looked at for a change from one fold to another in a pass, and passes at most.
_CHANGES, _PASSES = 256, 20


def _gains(beyond: np.ndarray, whole: int, fold: np.ndarray, has: np.ndarray) -> np.ndarray:
    """What a change of each row to each fold takes from the sum of squares, in 2 * whole; 0 for its own fold."""
    gain = np.stack([(has * (beyond[:, fold].T - beyond[:, b] - whole)).sum(1) for b in range(beyond.shape[1])], 1)
    gain[np.arange(len(fold)), fold] = 0
    return gain


def _changes(beyond: np.ndarray, whole: int, fold: np.ndarray, has: np.ndarray) -> dict[int, int]:
    """New folds of some rows: one by one the change that lessens the sum of squares most. ``beyond``: label x fold, in units."""
    fold, out, open_ = fold.copy(), {}, np.ones(len(fold), bool)
    while True:
        gain = _gains(beyond, whole, fold, has)
        gain[~open_] = 0
        i, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, b] <= 0:
            return out
        beyond[:, fold[i]] -= whole * has[i]
        beyond[:, b] += whole * has[i]
        fold[i], out[int(i)], open_[i] = b, int(b), False


def _best_change(beyond: list[np.ndarray], whole: int):
    """The fold that a row gains most by changing to, and the gain, from its labels, fold and dealing."""

    @F.pandas_udf("gain long, to int")
    def best(has: pd.Series, fold: pd.Series, dealing: pd.Series) -> pd.DataFrame:
        gain, to = np.zeros(len(fold), np.int64), np.zeros(len(fold), np.int32)
        for i in dealing.unique():
            own = (dealing == i).to_numpy()
            gains = _gains(beyond[i], whole, fold[own].to_numpy(), np.stack(has[own].to_numpy()).astype(np.int64))
            gain[own], to[own] = gains.max(1), gains.argmax(1)
        return pd.DataFrame({"gain": gain, "to": to})

    return best.asNondeterministic()


def _repaired(rows: DataFrame, id_col: str, labels: list[str], weights: list[int], also: list[str]) -> DataFrame:
    """Rows of ``_dealt_by_label`` with some folds changed; a pass looks at _CHANGES rows for every two folds."""
    spark, whole = rows.sparkSession, sum(weights)
    has = F.array(*[F.when(F.coalesce(F.col(c).cast("double") != 0, F.lit(False)), 1).otherwise(0) for c in labels], F.lit(1))
    keys = [*also, "_all"]
    rows = cut_lineage(rows.withColumn("_all", F.lit(0)))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    for _ in range(_PASSES):
        each = [F.sum(has[m]) for m in range(len(labels) + 1)]
        beyond: dict[tuple, np.ndarray] = {}
        for r in rows.groupBy(*keys, "fold").agg(F.array(*each).alias("n")).collect():
            beyond.setdefault(tuple(r[k] for k in keys), np.zeros((len(each), len(weights)), np.int64))[:, r["fold"]] = r["n"]
        for k, n in beyond.items():
            beyond[k] = whole * n - n.sum(1)[:, None] * np.array(weights)
        told = spark.createDataFrame([(*k, i) for i, k in enumerate(beyond)], ", ".join([*[f"{k} {types[k]}" for k in keys], "_dealing int"]))
        met = rows.join(F.broadcast(told), keys).withColumn("_has", has)  # one row per dealing
        place = F.row_number().over(W.partitionBy(*keys, "fold", "_b.to").orderBy(F.col("_b.gain").desc(), "_h", id_col))
        some = met.withColumn("_b", _best_change(list(beyond.values()), whole)("_has", "fold", "_dealing")).filter(F.col("_b.gain") > 0)
        some = some.withColumn("_place", place).filter(F.col("_place") <= _CHANGES)
        found: dict[tuple, list] = {}
        for r in some.orderBy(*keys, "_h", id_col).select(*keys, id_col, "fold", "_has").collect():
            found.setdefault(tuple(r[k] for k in keys), []).append((r[id_col], r["fold"], r["_has"]))
        moves = []
        for k, own in found.items():
            new = _changes(beyond[k], whole, np.array([f for _, f, _ in own]), np.array([h for _, _, h in own], np.int64))
            moves += [(*k, own[i][0], b) for i, b in new.items()]
        if not moves:
            break
        moved = spark.createDataFrame(moves, ", ".join([*[f"{k} {types[k]}" for k in keys], f"{id_col} {types[id_col]}", "_to int"]))
        rows = cut_lineage(rows.join(F.broadcast(moved), [*keys, id_col], "left").withColumn("fold", F.coalesce("_to", "fold")).drop("_to"))
    return rows.drop("_all", "_h")


def _by_label(df: DataFrame, id_col: str, labels: list[str], weights: list[int], order: Column, also: list[str], hot_rows: int) -> DataFrame:
    if df.isEmpty():
        return df.withColumn("fold", F.lit(None).cast("int"))
    return _repaired(_dealt_by_label(df, id_col, labels, weights, order, also, hot_rows), id_col, labels, weights, also)


def label_folds(df: DataFrame, id_col: str, labels: list[str], folds: int = 3, seed: int = 0, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``fold``: every label (a column that is not 0) is spread over the folds evenly, the rarest first."""
    return _by_label(df, id_col, labels, [1] * folds, X.spread(F.col(id_col), seed), [], hot_rows)


def repeated_label_folds(df: DataFrame, id_col: str, labels: list[str], folds: int = 5, repeats: int = 10,
                         hot_rows: int = HOT_ROWS) -> DataFrame:
    """label_folds once per repeat, each with another order of dealing."""
    many = df.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    order = X.spread(F.col(id_col) + F.col("repeat") * 1000003, 1)
    return _by_label(many, id_col, labels, [1] * folds, order, ["repeat"], hot_rows)


def label_split(df: DataFrame, id_col: str, labels: list[str], test_size: float = 0.1, seed: int = 0,
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add ``is_test``: the test part gets ``test_size`` (in thousandths) of every label, the rarest first."""
    test = round(1000 * test_size)
    dealt = _by_label(df, id_col, labels, [1000 - test, test], X.spread(F.col(id_col), seed), [], hot_rows)
    return dealt.withColumn("is_test", F.col("fold") == 1).drop("fold")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count of each value of each column, in long form."""
    return df.unpivot([], columns, "grading_metric", "score").groupBy("grading_metric", "score").agg(
        F.count("*").alias("count"))


def mean_histogram(df: DataFrame, columns: list[str], width: float = 0.25) -> DataFrame:
    """Rows per bin of the mean over the columns."""
    total = sum((F.col(c).cast("double") for c in columns[1:]), F.col(columns[0]).cast("double"))
    scored = df.withColumn("bin", F.floor(total / float(len(columns)) / width).cast("long"))
    return scored.groupBy("bin").agg(F.count("*").alias("count")).withColumn("bin_start", F.col("bin") * width)
