"""Connected components of a graph of any shape, by alternating star contractions.

Every round hangs each node's larger neighbours, then its smaller ones, on the smallest node it
sees; the components' sizes do not matter, since only minima per node are gathered (combined
before the shuffle) and joined back. Rounds grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionloom.sources.tables import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (u, v, longs); component: its smallest node.

    Loops and repeated edges do no harm; nodes without edges are not in the result.
    """
    u, v = F.col("u"), F.col("v")
    e = cut_lineage(edges.filter(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(v.alias("u"), u.alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter(v > u).select(v.alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(v.alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        e = cut_lineage(small.filter("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:  # every node hangs on its component's smallest
            break
        before = now
    roots = e.select(v.alias("node"), v.alias("component")).distinct()
    return e.select(u.alias("node"), v.alias("component")).unionByName(roots)
