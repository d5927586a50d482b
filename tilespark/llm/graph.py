"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_checkpoint


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of ``links`` (a, b).

    A large-star step ties every larger neighbour of a node to the smallest one; a small-star step does so with the smaller
    neighbours. Both keep the components, and the links become stars around the smallest nodes after about log n rounds.
    The minima are written before they are joined, so that Spark may split the links of a hub among tasks. The number of links
    is known in each round, and few links are written to few files.
    """
    edges = shared_checkpoint(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if state == before or not state["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        before, n = state, state["n"]
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = shared_checkpoint(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), n)
        # of each link, the larger end is tied to the smallest neighbour of the smaller end
        large = shared_checkpoint(edges.join(least.withColumnRenamed("a", "b"), "b").select("a", F.col("m").alias("b")).distinct(), n)
        least = shared_checkpoint(large.groupBy("a").agg(F.min("b").alias("m")), n)
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = shared_checkpoint(moved.unionByName(least.withColumnRenamed("m", "b")).filter("a <> b").distinct(), n)
