"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, joined_to_one, written


def components(links: DataFrame) -> DataFrame:
    """``node root`` for every node of ``links`` (columns ``a b``): root is the smallest node that can be reached.

    Large-star and small-star rounds: each node's neighbours are hung on the smallest one until nothing changes, in a
    number of rounds that grows with the logarithm of the graph. Minima are aggregated before the shuffle and joined back
    by :func:`plotwise.llm.common.joined_to_one`, so a node with very many links is never one task's list. Each round is
    a written table. Links may repeat or join a node to itself; a link with a null end is none. No link: no row.
    """
    links = links.where(F.col("a").isNotNull() & F.col("b").isNotNull())
    edges = written(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        # large-star: every larger neighbour goes to the smallest of the neighbourhood
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b")
        near = written(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("_n")), "least")
        large = joined_to_one(both.where("b > a"), near, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = written(large, "large-star")
        # small-star: every smaller neighbour, and the node, goes to the smallest
        least = written(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_n")), "least")
        small = joined_to_one(large, least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        small = written(small, "small-star")
        now = small.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        dropped(edges, large, near, least)
        edges = small
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
