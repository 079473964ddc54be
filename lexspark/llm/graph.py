"""Connected components of an undirected graph as a table of edges, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.session import cut


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable. Only nodes of an edge with two ends appear.

    edges: columns a, b (long). Self-links and nulls are ignored. Each round contracts every neighbourhood to its
    minimum twice (to larger, then to smaller neighbours), so that the rounds grow with the logarithm of a chain's
    length. Each step is a partial aggregate and a join, and its result is written, so that nothing is gathered in
    one task or on the driver. No edges: an empty table. More than max_rounds rounds raise.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    before = None
    for _ in range(max_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = state
        # larger neighbours of u go to the smallest of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
        large = cut(
            both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "star"
        )
        # smaller neighbours of u, and u itself, go to the smallest of them
        least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "star")
        now = cut(
            large.join(least, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct(),
            "star",
        )
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
