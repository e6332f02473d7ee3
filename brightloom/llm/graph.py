"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31))), F.lit(0))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges(a long, b long) to (node, root): the least node of each component, for every node that has an edge.

    Each step only takes minima by node and joins them back, so a node with any number of edges is never
    gathered, and skewed joins can be split. Null nodes and loops are left out; no edges give no rows."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = store.cut(edges)
    seen = _print(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = store.cut(least)  # so that both sides of the join are exchanged for it, and a hot node can be split
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = store.cut(large)
        least = store.cut(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        small = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = store.cut(small)
        now = _print(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
