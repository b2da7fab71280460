"""Connected components of a table of edges, by alternating large-star and small-star steps over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capforge.llm.common import join_counted, stored

def _sign(edges: DataFrame) -> tuple:
    """Edges, and a sum over them that tells two tables apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """Stored (node, label): the smallest node reachable over the edges (a, b), for every node of an edge.

    Nodes are of any type that Spark orders; an empty table of edges has no nodes.
    """
    alone = edges.filter("a = b").select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "star")
    seen = _sign(now)
    while True:
        ends, rows = now.union(now.select("v", "u")), 2 * seen[0]
        least = ends.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = stored(join_counted(ends, least, "u", "n", rows).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter(
            "u <> v").distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = join_counted(large, least, "u", "n", rows).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", "m")).filter("u <> v").distinct()
        now, before = stored(small, "star"), seen
        seen = _sign(now)
        if seen == before:
            found = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
            return stored(found.union(now.select("v", "v").distinct()).union(
                alone.join(found.select("node"), "node", "left_anti").join(found.select(F.col("label").alias("node")), "node", "left_anti")), "labels")
