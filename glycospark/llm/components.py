"""Connected components of an edge table, without collecting anything."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import settle


def components(edges: DataFrame) -> DataFrame:
    """``(id, root)`` for each node of ``edges(a, b)``; the root is the smallest id reachable.

    Alternates two contractions: every node points its larger neighbours to its smallest
    one, then its smaller ones.  The number of edges never grows; the rounds grow with the
    logarithm of the longest path.  Each round is a table in the shared folder, so that a
    lost executor costs no more than its own tasks.  Self loops and nulls are ignored.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = settle(edges, "edges")
    while True:
        # done when every node has one smaller neighbour, which has none itself
        nodes = edges.groupBy("u").agg(F.count("*").alias("n")).select(F.col("u").alias("x"), (F.col("n") > 1).cast("int").alias("many"), F.lit(1).alias("below"), F.lit(0).alias("above"))
        tops = edges.select(F.col("v").alias("x"), F.lit(0).alias("many"), F.lit(0).alias("below"), F.lit(1).alias("above")).distinct()
        state = nodes.unionByName(tops).groupBy("x").agg(F.max("many").alias("many"), (F.max("below") + F.max("above") > 1).alias("middle"))
        if state.where("many = 1 OR middle").isEmpty():
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = settle(large, "large")
        least = settle(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        # every smaller neighbour and the node itself point to the smallest neighbour
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = settle(small.where("u <> v").distinct(), "edges")
    nodes = edges.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return nodes.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
