"""Connected components of an edge table by alternating star contractions, each step an aggregation and a join."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from marketframe.llm.storage import Shelf


def components(edges: DataFrame, shelf: Shelf, rounds: int = 60) -> DataFrame:
    """edges (a, b) of longs -> (node, root): root is the smallest node reachable. Nodes without edges do not appear.

    Star contraction (large star, then small star) halves the depth of every tree per round, so rounds is never reached in
    practice; running out of rounds raises. Hubs only ever meet as the many side of an equi-join, which Spark may split.
    """
    tag = len(shelf.paths)
    now = shelf.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"edges-{tag}")
    for i in range(rounds):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        small = shelf.put(small, f"edges-{tag}-{i}")
        shelf.drop(now)
        # a forest of stars whose centres are no leaves is final
        if not small.groupBy("a").count().where("count > 1").limit(1).count() and not small.join(small.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return small.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                small.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        now = small
    raise RuntimeError(f"components did not settle in {rounds} rounds")
