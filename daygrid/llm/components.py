"""Connected components by alternating large and small stars, for links that need not fit anywhere but on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """links(a, b): undirected, any comparable type. Returns node, root: the smallest node reachable. Each round is two grouped
    minima; rounds grow with the logarithm of the longest chain. Nodes without links do not appear."""

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e.select("a", "b") if small else e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        joined = both.join(least, "a")
        if small:  # a is the larger end: its neighbours and itself go under the least of them
            out = joined.select(F.col("b").alias("x"), "m").union(least.select(F.col("a").alias("x"), "m"))
        else:  # neighbours larger than a go under the least of a's neighbourhood
            out = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("x"), "m")
        return out.filter(F.col("x") != F.col("m")).select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct()

    edges = cut(links.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        edges = cut(star(star(edges, small=False), small=True))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
