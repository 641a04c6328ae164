"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws a key u ** (1 / w) from its hash and its quality weight w. A source that
should give T of its Z words gives all documents T // Z times (complete epochs) and, of the
documents in falling key order, those whose running size stays within the rest T mod Z. The
document that the rest ends in is taken if that comes nearer to the target.

The running size over a source, which may hold a third of all rows, is found without sorting
it: keys fall into 4,096 bins, sums per bin tell which bin the rest ends in, and only that bin
is cut again, so that the last step orders a handful of keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.llm.common import text_or_empty, word_count
from sessionloom.sources.tables import cut_lineage

def uniform(column: Column, seed: int) -> Column:
    """A number in (0, 1) from the md5 of (seed, column): any engine can repeat it."""
    head = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), column.cast("string")).cast("binary")), 1, 12)
    return (F.conv(head, 16, 10).cast("long") + 0.5) / float(1 << 48)


def targets(sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), share: float = 1.0, most: float = 3.0) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size; other columns stay).

    Sources in code point order, null last, weigh ``weights``, repeating. They share ``share``
    of all words; a target stops at ``most`` times its source's size and the excess goes to the
    others by weight until none is above. That ends at one price per weight, p: a source
    gets min(most * size, p * weight). Sources by most * size / weight say where p lies.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", weight).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    by_need = W.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    total = W.partitionBy()
    s = s.withColumns({
        "budget": F.sum("source_size").over(total) * float(share),
        "full": F.coalesce(F.sum("cap").over(by_need.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(by_need.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    price = (F.col("budget") - F.col("full")) / F.col("open")  # if this source is the first that is not full
    s = s.withColumn("p", F.when(price * F.col("w") <= F.col("cap"), price))
    p = F.coalesce(F.max("p").over(total), F.lit(float("inf")))
    return s.withColumn("target", F.least(F.col("cap"), p * F.col("w"))).drop("w", "cap", "budget", "full", "open", "p")


def _ends(level: DataFrame, digit: str) -> DataFrame:
    """Per source the first digit that no longer fits into ``left`` as a whole, and what is left before it.

    ``level`` has source key, digit, n (words) and left; at most 4,096 digits a source.
    """
    inside = W.partitionBy("src").orderBy(digit)
    run = F.sum("n").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow))
    return (
        level.withColumn("run", run).filter("run > left")
        .groupBy("src").agg(F.min_by(F.struct(digit, (F.col("left") - F.col("run") + F.col("n")).alias("left"), "n"), digit).alias("e"))
        .select("src", "e.*")
    )


def mix(docs: DataFrame, quality: DataFrame | None = None, unweighted: float = 1.0, seed: int = 5, weights: Sequence[float] = (1, 2, 3),
        share: float = 1.0,
        most: float = 3.0) -> DataFrame:
    """doc_id, size, source, source_size, target, times, taken (= times * size) of every row.

    ``docs`` needs doc_id, text, source; ``quality`` (doc_id, weight > 0) may give document
    weights, else ``unweighted``. Null texts have size 0. Rows with one doc_id draw one key and are taken
    alike. A source of no words has target 0. An empty table gives an empty result. Reruns
    agree: keys are hashes. Other columns are ignored.
    """
    sized = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(text_or_empty()).alias("size"))
    if quality is None:
        sized = sized.withColumn("_w", F.lit(None).cast("double"))
    else:
        sized = sized.join(quality.groupBy("doc_id").agg(F.max("weight").cast("double").alias("_w")), "doc_id", "left")
    key = F.pow(uniform(F.coalesce(F.col("doc_id"), F.lit(-1)), seed), 1.0 / F.coalesce("_w", F.lit(float(unweighted))))
    keyed = sized.select(
        "doc_id", "source", "size", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("src"),
        F.floor((1.0 - key) * float(1 << 48)).cast("long").alias("k"))  # rising k: falling key
    keyed = keyed.withColumns({"a": F.shiftright("k", 36), "b": F.shiftright("k", 24)})
    keyed = cut_lineage(keyed)  # a few numbers per document

    first = cut_lineage(keyed.groupBy("src", "a").agg(F.sum("size").alias("n"), F.first("source", True).alias("source")))
    goals = targets(first.groupBy("src").agg(F.first("source", True).alias("source"), F.sum("n").alias("source_size")), weights, share, most)
    times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goals = cut_lineage(goals.withColumn("epochs", times).withColumn("left", F.col("target") - F.col("epochs") * F.col("source_size")))
    one = _ends(first.join(goals.select("src", "left"), "src"), "a")
    two = _ends(keyed.join(one.drop("n"), ["src", "a"]).groupBy("src", "b").agg(F.sum("size").alias("n"), F.max("left").alias("left")), "b")
    three = _ends(keyed.join(two.drop("n"), ["src", "b"]).groupBy("src", "k").agg(F.sum("size").alias("n"), F.max("left").alias("left")), "k")
    cut = three.select("src", F.when(F.col("left") * 2 >= F.col("n"), F.col("k") + 1).otherwise(F.col("k")).alias("cut"))
    # The bins spread a large source's rows over the join.
    bins = first.select("src", "a").join(goals.drop("source", "left"), "src").join(cut, "src", "left")
    extra = F.when(F.col("k") < F.col("cut"), 1).otherwise(0)
    return (
        keyed.join(bins, ["src", "a"]).withColumn("times", F.col("epochs") + extra)
        .select("doc_id", "size", "source", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))
    )


def repeat(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """Rows of ``docs`` as many times as ``mixed`` (see mix) takes them."""
    times = mixed.filter("times > 0").select(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), "times").distinct().withColumnRenamed("times", "_n")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_d")) & F.col("source").cast("string").eqNullSafe(F.col("_s"))
    taken = docs.join(times, same).withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    return taken.select(*[F.col(c) for c in docs.columns])
