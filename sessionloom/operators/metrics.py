"""Recall at 20 and the submission rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.constants import RECALL_WEIGHTS, TOP_PREDICTIONS


def top_predictions(scored: DataFrame, k: int = TOP_PREDICTIONS, score: str = "pred", with_score: bool = False) -> DataFrame:
    """The k best items of each session, with their rank (and score, if asked for); ties go to the smaller item."""
    best = W.partitionBy("session").orderBy(F.col(score).desc(), F.col("aid"))
    return scored.withColumn("pos", F.row_number().over(best)).filter(F.col("pos") <= k).select(
        "session", "aid", "pos", *([score] if with_score else []))


def prediction_lists(top: DataFrame) -> DataFrame:
    """session -> labels array in rank order; a session has at most k ranked rows."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", "aid")))
    return top.groupBy("session").agg(F.transform(ordered, lambda p: p["aid"]).alias("labels"))


def hits(labels: DataFrame, predictions: DataFrame, k: int = TOP_PREDICTIONS) -> DataFrame:
    """Hits and denominator of every labelled row (session, type, ground_truth array).

    The denominator is the length of the list, at most k; a session without prediction has
    no hits.
    """
    found = F.size(F.array_intersect("ground_truth", "labels"))
    return labels.join(predictions, "session", "left").select(
        "session", "type",
        F.when(F.col("labels").isNotNull(), found).otherwise(0).cast("long").alias("hits"),
        F.least(F.size("ground_truth"), F.lit(k)).cast("long").alias("truths"),
    )


def recall(labels: DataFrame, predictions: DataFrame, event: str, k: int = TOP_PREDICTIONS) -> DataFrame:
    """One row: hits, truths and recall of one event type."""
    return hits(labels.filter(F.col("type") == event), predictions, k).agg(
        F.lit(event).alias("type"),
        F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"),
        F.coalesce(F.sum("truths"), F.lit(0)).alias("truths"),
        F.coalesce(F.try_divide(F.sum("hits").cast("double"), F.sum("truths").cast("double")), F.lit(0.0)).alias(
            "recall"),
    )


def weighted_recall(labels: DataFrame, predictions: dict[str, DataFrame], k: int = TOP_PREDICTIONS) -> DataFrame:
    """Recall of each event and the weighted overall recall (type ``all``)."""
    parts = None
    for event, predicted in predictions.items():
        one = recall(labels, predicted, event, k)
        parts = one if parts is None else parts.unionByName(one)
    weight = F.create_map(*[F.lit(x) for pair in RECALL_WEIGHTS.items() for x in pair])
    overall = parts.agg(
        F.lit("all").alias("type"), F.sum("hits").alias("hits"), F.sum("truths").alias("truths"),
        F.sum(F.col("recall") * F.element_at(weight, F.col("type"))).alias("recall"),
    )
    return parts.unionByName(overall)


def fold_summary(recalls: DataFrame) -> DataFrame:
    """Mean and population deviation of the folds' recall per event type."""
    return recalls.groupBy("type").agg(
        F.avg("recall").alias("mean"), F.stddev_pop("recall").alias("std"))


def predicted_sessions_only(labels: DataFrame, predictions: DataFrame) -> DataFrame:
    return labels.join(predictions.select("session"), "session", "left_semi")


def submission(predictions: dict[str, DataFrame]) -> DataFrame:
    """session_type such as ``12_clicks`` and the labels joined by blanks, all events together."""
    out = None
    for event, predicted in predictions.items():
        rows = predicted.select(
            F.concat_ws("_", F.col("session").cast("string"), F.lit(event)).alias("session_type"),
            F.array_join(F.transform("labels", lambda a: a.cast("string")), " ").alias("labels"),
        )
        out = rows if out is None else out.unionByName(rows)
    return out


def ground_truth(events: DataFrame, names: dict[str, int]) -> DataFrame:
    """Labels of a held-out window: the distinct items of each session and type, sorted.

    A label list is as long as the distinct items of one session and type.
    """
    label = F.create_map(*[F.lit(x) for n, t in names.items() for x in (t, n)])
    return (
        events.select("session", "type", "aid").distinct()
        .groupBy("session", "type").agg(F.sort_array(F.collect_list("aid")).alias("ground_truth"))
        .withColumn("type", F.element_at(label, F.col("type")))
    )
