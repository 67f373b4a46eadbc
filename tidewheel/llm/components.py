"""Connected components of an edge table, by alternating star contractions.

Only ``min`` aggregates and equi-joins on node ids: no neighbour list is ever collected. A node with very many edges is
a skewed join key; its least neighbour is written to a table first, so that adaptive execution can split the join on it. A round's tables go to the shared folder and are removed after the next round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.runtime import cut, last_cut, remove

MAX_ROUNDS = 60


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable, for each node other than its component's smallest.

    Edges are undirected; loops, repeats and nulls are ignored. A node without edges isn't in the result.
    """
    spark = edges.sparkSession
    # (a, b): a hangs below the smaller b
    stars = cut(
        edges.where(F.col(a) != F.col(b))
        .select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"))
        .distinct()
    )
    old = [last_cut()]
    for _ in range(MAX_ROUNDS):
        both = stars.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(
            stars.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        old.append(last_cut())
        large = (
            both.join(least, "u")
            .where("v > u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .where("a != b")
            .distinct()
        )
        # nodes below one other only hang there already
        own = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        crossed = large.join(own.where("n > 1").select("a", "m"), "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        stars = cut(own.select("a", F.col("m").alias("b")).unionAll(crossed).distinct())
        # done when every node hangs below one root that hangs below nothing
        child = stars.groupBy("a").agg(F.count(F.lit(1)).alias("n"))
        wrong = child.where("n > 1").select("a").unionAll(
            stars.select("b").distinct().join(child, F.col("b") == F.col("a"), "left_semi").select(F.col("b").alias("a"))
        )
        settled = wrong.isEmpty()
        remove(spark, *old)
        old = [last_cut()]
        if settled:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    raise RuntimeError(f"components did not settle within {MAX_ROUNDS} rounds")
