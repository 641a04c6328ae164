"""Ordered work on keys of any size.

A window partitioned by session puts a whole session into one task, which fails when one
session holds a large share of all rows. The helpers here look for such hot keys first, in one
aggregation. Where there are none, the plan is the plain window or join. The rows of hot keys are
cut into slices of about ``hot_rows`` rows by a range partitioning over the key and the whole
order, so a burst of rows in one second is cut like any other; the window runs inside each
slice, and what the earlier slices contribute is added. Keys with at most ``hot_rows`` rows
form one slice.

The tables of hot keys and of their slices have at most ``rows / hot_rows`` (plus one per
hot key) rows; up to SMALL rows they are broadcast.
"""

from __future__ import annotations

import weakref
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sessionloom.constants import HOT_ROWS
from sessionloom.sources.tables import cut_lineage

ORDER = ("ts", "event_id")
SMALL = 100_000

#: Hot keys found, by the frame of sizes they were found in, so that they are looked for once.
_FOUND: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def key_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows per key: what the helpers need to know of a frame."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def hot_keys(sizes: DataFrame, keys: Sequence[str], hot_rows: int) -> tuple[DataFrame, int] | None:
    """(keys and n, rows) of the keys with more than ``hot_rows`` rows, or None if there are none."""
    found = _FOUND.setdefault(sizes, {})
    if (*keys, hot_rows) not in found:
        hot = sizes.filter(F.col("n") > hot_rows).select(*keys, "n")
        count, rows = hot.agg(F.count("*"), F.sum("n")).first()
        found[(*keys, hot_rows)] = None if not count else (_small(cut_lineage(hot), count), int(rows))
    return found[(*keys, hot_rows)]


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def _parted(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], hot_rows: int,
            sizes: DataFrame | None) -> tuple[DataFrame, DataFrame | None, int]:
    """(rows of other keys, rows of hot keys with ``_slice``, number of slices).

    Slices rise along the order. They are written down, since sampled bounds could differ
    between two evaluations.
    """
    found = hot_keys(key_sizes(df, keys) if sizes is None else sizes, keys, hot_rows)
    if found is None:
        return df, None, 0
    hot, rows = found
    count = -(-rows // hot_rows) + 1
    dealt = df.join(hot.select(*keys), list(keys), "left_semi").repartitionByRange(count, *keys, *order)
    sliced = cut_lineage(dealt.withColumn("_slice", F.spark_partition_id()))
    return df.join(hot.select(*keys), list(keys), "left_anti"), sliced, count


def running_counts(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    counters: dict[str, Column],
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add, per key in the given order, the inclusive running count of each condition.

    The order must be total inside a key. ``sizes`` (see key_sizes) saves a pass over the frame
    where the caller has it already.
    """
    rest, hot, slices = _parted(df, keys, order, hot_rows, sizes)

    def counted(rows: DataFrame, *also: str) -> DataFrame:
        inside = W.partitionBy(*keys, *also).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
        return rows.withColumns({n: F.sum(c.cast("long")).over(inside) for n, c in counters.items()})

    if hot is None:
        return counted(rest)
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        hot.groupBy(*keys, "_slice")
        .agg(*[F.sum(c.cast("long")).alias(f"_{n}") for n, c in counters.items()])
        .select(*keys, "_slice", *[F.sum(f"_{n}").over(before).alias(f"_{n}") for n in counters])
    )
    met = counted(hot, "_slice").join(_small(starts, slices), [*keys, "_slice"])
    added = {n: F.col(n) + F.coalesce(F.col(f"_{n}"), F.lit(0)) for n in counters}
    return counted(rest).unionByName(met.withColumns(added).drop("_slice", *[f"_{n}" for n in counters]))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column] = ORDER, name: str = "pos",
              hot_rows: int = HOT_ROWS, sizes: DataFrame | None = None) -> DataFrame:
    """Add the position from 1 of each row inside its key."""
    return running_counts(df, keys, order, {name: F.lit(True)}, hot_rows, sizes)


def adjacent(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, str],
    step: int,
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add columns of the previous (step -1) or next (step 1) row of the key; null at the end.

    ``columns`` maps new names to existing columns.
    """
    rest, hot, slices = _parted(df, keys, order, hot_rows, sizes)
    shift = F.lead if step > 0 else F.lag
    plain = W.partitionBy(*keys).orderBy(*order)
    out = rest.withColumns({n: shift(c).over(plain) for n, c in columns.items()})
    if hot is None:
        return out
    inside, across = W.partitionBy(*keys, "_slice").orderBy(*order), W.partitionBy(*keys).orderBy("_slice")
    value = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
    edge = F.min_by(value, F.struct(*order)) if step > 0 else F.max_by(value, F.struct(*order))
    edges = (
        hot.groupBy(*keys, "_slice")
        .agg(edge.alias("_edge"))
        .select(*keys, "_slice", shift("_edge").over(across).alias("_edge"))
    )
    # Only a slice's outermost row, which has no neighbour inside, looks across the edge.
    near = hot.withColumns({"_end": shift(order[0]).over(inside).isNull(),
                            **{n: shift(c).over(inside) for n, c in columns.items()}})
    met = near.join(_small(edges, slices), [*keys, "_slice"]).withColumns(
        {n: F.when(F.col("_end"), F.col("_edge")[n]).otherwise(F.col(n)) for n in columns})
    return out.unionByName(met.drop("_slice", "_end", "_edge"))


def spread_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salt_by: Sequence[str] = ("session",),
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose left side may hold hot keys and whose right side has few rows per key.

    Left rows of a hot key are dealt over ``ceil(n / hot_rows)`` salts by a hash of
    ``salt_by``; only the right rows of hot keys are repeated, once per salt. Without hot keys it
    is a plain join. ``sizes`` (keys and n) saves counting the left side.
    """
    on = list(on)
    found = hot_keys(key_sizes(left, on) if sizes is None else sizes, on, hot_rows)
    if found is None:
        return left.join(right, on, how)
    hot = found[0].select(*on, F.ceil(F.col("n") / hot_rows).cast("int").alias("_salts"))
    one = F.coalesce("_salts", F.lit(1))
    dealt = left.join(hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_by), one).cast("int")).drop("_salts")
    repeated = right.join(hot, on, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), one - 1))).drop("_salts")
    return dealt.join(repeated, [*on, "_salt"], how).drop("_salt")
