"""Connected components of a table of links, by alternating large and small stars.

Each step is a min-aggregation (combined before the shuffle) joined back on the node, so a node with very many links
is split by the adaptive skew join and never gathered in one task.  Each round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _step(edges: DataFrame, large: bool) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    # the key is written anew to keep the aggregation's own partitioning from being reused, so that a hot node's links can be split
    linked = both.join(least.select(F.col("u").bitwiseXOR(F.lit(0)).alias("w"), "m"), F.col("u") == F.col("w")).drop("w")
    if large:
        out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b: longs, either way round, repeats and loops allowed) -> (node, root): root is the least node reachable.

    Nodes without links do not appear.  No rows in, no rows out.
    """
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    seen = None
    while True:
        now = cut(_step(_step(now, True), False))
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
