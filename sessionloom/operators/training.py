"""Training rows: labels, folds, sampling, feature merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionloom.constants import EVENT_TYPES, HOT_ROWS
from sessionloom.functions import expressions as X
from sessionloom.operators import ordering
from sessionloom.sources.tables import cut_lineage


def with_truth(candidates: DataFrame, labels: DataFrame, event: str) -> DataFrame:
    """Candidates with target 1 where the labels of the event contain the item, else 0."""
    truth = (
        labels.filter(F.col("type") == event)
        .select("session", F.explode("ground_truth").alias("aid")).distinct()
        .withColumn("target", F.lit(1))
    )
    return candidates.join(truth, ["session", "aid"], "left").withColumn(
        "target", F.coalesce("target", F.lit(0)))


def with_rank_weight(candidates: DataFrame, c: int) -> DataFrame:
    return candidates.withColumn("cvm_weights", X.rank_weight(F.col("rank"), c))


def fold_by_hash(df: DataFrame, folds: int = 5, seed: int = 0) -> DataFrame:
    """Fold of each row by a hash of its session: no shuffle, sessions stay whole."""
    return df.withColumn("fold", F.pmod(X.spread(F.col("session"), seed), F.lit(folds)).cast("int"))


def fold_deal(df: DataFrame, folds: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(session, fold) with fold sizes that differ by at most one session.

    Candidate groups all have the same size, so dealing them out balances the folds' rows.
    Sessions are dealt in the order of a hash of their number.
    """
    sessions = df.select("session").distinct().withColumns({"_all": F.lit(0), "_h": X.spread(F.col("session"))})
    placed = ordering.positions(sessions, ["_all"], ["_h", "session"], "_pos", hot_rows)
    return placed.select("session", F.pmod(F.col("_pos") - 1, F.lit(folds)).cast("int").alias("fold"))


def shares_of(loads: Sequence[int], size: int, count: int) -> list[int]:
    """How many of ``count`` equal things each bin gets if one after the other goes to the lightest (ties: the first).

    A bin is filled at its load, load + size, load + 2 size, ...; the things go to the ``count`` smallest
    of these levels, found by bisection, so that the work does not grow with ``count``.
    """
    def below(level: int) -> list[int]:
        return [max(0, -(-(level - x) // size)) for x in loads]

    low, high = min(loads), max(loads) + size * (count + 1)
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(below(mid)) <= count else (low, mid)
    out = below(low)
    for k, x in enumerate(loads):
        if sum(out) < count and x <= low and (low - x) % size == 0:
            out[k] += 1
    return out


def _whole(a: Column, b: Column) -> Column:
    """a / b rounded down, exact for whole numbers not below 0; 0 for b = 0."""
    b = F.greatest(b, F.lit(1))
    return F.round((a - a % b) / b).cast("long")


def evenly(pos: Column, quotas: Sequence[Column], count: Column) -> Column:
    """Bin of the place ``pos`` (from 0) among ``count``, so that each bin gets its quota and all stretches mix the bins alike.

    A bin takes the places at which its share of the places left passes a whole number.
    """
    out, free = F.lit(len(quotas) - 1), F.lit(True)
    left, pos = count.cast("long"), pos.cast("long")
    choices = []
    for k, quota in enumerate(quotas[:-1]):
        before = _whole(pos * quota + left - 1, left)  # of this bin, before the place
        until = _whole((pos + 1) * quota + left - 1, left)
        choices.append((free & (until > before), k))
        free = free & (until <= before)
        pos, left = pos - before, left - quota
    for hit, k in reversed(choices):
        out = F.when(hit, k).otherwise(out)
    return out.cast("int")


def fold_by_size(df: DataFrame, folds: int = 5, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(session, size, fold): the largest session goes to the lightest fold, and so on, as grouped folds are dealt.

    Sessions of one size are interchangeable, so only the histogram of sizes is dealt out on the driver
    (n rows have at most sqrt(2 n) different sizes); sessions are numbered among those of their
    size, in the order of a hash.
    """
    sizes = cut_lineage(df.groupBy("session").agg(F.count("*").alias("size")))
    classes = sizes.groupBy("size").agg(F.count("*").alias("n"))
    loads, quotas = [0] * folds, []
    for r in classes.orderBy(F.col("size").desc()).collect():
        own = shares_of(loads, r["size"], r["n"])
        loads = [x + c * r["size"] for x, c in zip(loads, own)]
        quotas.append((r["size"], r["n"], own))
    told = df.sparkSession.createDataFrame(quotas, "size long, n long, quotas array<long>")
    hashed = sizes.withColumn("_h", X.spread(F.col("session")))
    placed = ordering.positions(hashed, ["size"], ["_h", "session"], "_pos", hot_rows, classes)
    met = ordering.spread_join(placed, told, ["size"], hot_rows=hot_rows, sizes=classes)
    fold = evenly(F.col("_pos") - 1, [F.col("quotas")[k] for k in range(folds)], F.col("n"))
    return met.select("session", "size", fold.alias("fold"))


def split_fold(df: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of one fold."""
    return df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)


def pair_hash(seed: int = 42) -> Column:
    return F.pmod(X.spread(F.col("session"), seed) * 31 + X.spread(F.col("aid"), seed), F.lit(1000000))


def sample_negatives(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """All positives and about ``fraction`` of the negatives, by a hash of the row: repeatable anywhere."""
    return df.filter((F.col("target") == 1) | (pair_hash(seed) < F.lit(int(round(fraction * 1000000)))))


def sample_negatives_random(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    return df.sampleBy("target", {0: fraction, 1: 1.0}, seed)


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("session").agg(F.count("*").alias("group_size"))


def merge_features(candidates: DataFrame, items: DataFrame, sessions: DataFrame, interactions: DataFrame,
                   hot_rows: int = HOT_ROWS) -> DataFrame:
    """Candidates with item, session and interaction features as doubles; -1 where a feature is absent.

    Popular items are candidates of very many sessions, so the item join deals them out. The
    candidates are read twice for that; give a written or checkpointed table.
    """
    rows = candidates.withColumn("rec", F.col("rec").cast("double"))
    merged = (
        ordering.spread_join(rows, items, ["aid"], "left", hot_rows=hot_rows)
        .join(sessions, "session", "left")
        .join(interactions, ["session", "aid"], "left")
    )
    keys = {"session", "aid", "target", "fold", "rank"}
    return merged.select(*[
        F.col(c) if c in keys else F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in merged.columns])


def early_stop_set(validation: DataFrame, max_sessions: int = 40_000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Mark the rows of the first ``max_sessions`` sessions by number: the bounded early-stopping set."""
    numbered = ordering.positions(
        validation.select("session").distinct().withColumn("_all", F.lit(0)), ["_all"], ["session"], "_pos", hot_rows)
    chosen = numbered.select("session", (F.col("_pos") <= max_sessions).alias("is_eval"))
    return validation.join(chosen, "session")


def feature_names() -> list[str]:
    """The 165 model columns, in groups: rank weight, item, last week, session, interaction, rec."""
    days = range(7)

    def basic(key: str, partner: str, times: bool) -> list[str]:
        out = [f"{key}_{partner}_{s}" for s in ("count", "nunique")]
        out += [f"{key}_type_{s}" for s in ("mean", "min", "max")]
        out += [f"{key}_ts_{s}" for s in ("min", "max", "mean", "std")] if times else []
        out += [f"{key}_{u}_{s}" for u in ("day", "hour") for s in ("mean", "max")]
        out += ["session_length_ts"] if key == "session" else []
        out += [f"{key}_inter_day_{d}" for d in days]
        out += [f"{key}_percent_count_{e}" for e in EVENT_TYPES]
        return out + [f"{key}_{partner}_{s}_{e}" for e in EVENT_TYPES for s in ("count", "nunique")]

    def funnel(kind: str) -> list[str]:
        tsw = "inter" if kind == "all" else kind
        places = ("first", "last", "avg")
        return ([f"num_{tsw}_on_aid_tsw_{s}" for s in ("max", "mean", "std")]
                + [f"inter_aid_{kind}_{p}_occ_ts" for p in places]
                + [f"inter_percent_aid_{kind}_{p}_occ" for p in places])

    kinds = ("all", "click", "cart", "order")
    return [
        "cvm_weights",
        *basic("aid", "session", times=False),
        *[f"aid_ts_diff_{s}" for s in ("avg", "min", "max")],
        *[f"LW_{c}" for c in basic("aid", "session", times=True)],
        *basic("session", "aid", times=True),
        *[f"session_ts_diff_{s}" for s in ("avg", "std", "min", "max")],
        *[c for k in kinds for c in funnel(k)],
        *[f"inter_percent_{'inter' if k == 'all' else k}_aid" for k in kinds],
        *[f"inter_{e}_{u}_{s}" for e in ("all", *EVENT_TYPES) for u in ("day", "hour")
          for s in ("nunique", "mean", "min", "max")],
        "rec",
    ]


def select_features(merged: DataFrame) -> DataFrame:
    keys = [c for c in ("session", "aid", "target", "fold") if c in merged.columns]
    return merged.select(*keys, *feature_names())
