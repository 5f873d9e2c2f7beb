"""Connected components of links between long ids, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convosieve.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all linked nodes; links are columns a and b, in any direction, repeated or not.

    A round sends every node's neighbours to the least of them.  A node with a third of all links is only ever aggregated (by a
    minimum, combined before the shuffle) and joined with one row.  Rounds grow with the logarithm of the longest path.
    """
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, mark = stored(ordered), None
    while True:
        both = edges.union(edges.select("b", "a")).toDF("a", "b")
        least = both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("least"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("least"))
        rest = large.join(lower, "a").where("b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        before, edges = edges, stored(rest.union(lower.select("a", F.col("least").alias("b"))).distinct())
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
