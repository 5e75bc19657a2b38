"""Connected components by alternating stars, as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sketchloom.llm.shared import drop_stored, stored


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of edges (a, b) of longs; component is the smallest node reachable.

    A round links each node's larger neighbours to its least neighbour, then its smaller ones. Both steps keep what is
    reachable and never add edges, and a round that changes nothing has stars only; rounds go on until then
    (logarithmic in practice). Each round is stored and the one before it deleted. Minima are summed before
    a shuffle, and a hub's edges are joined from stored tables, whose skewed partitions AQE splits. No edges give no rows.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(current)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = stored(both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "edges")
        own = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(own, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        following = stored(small.unionByName(own.withColumnRenamed("m", "b")).distinct(), "edges")
        after = _state(following)
        drop_stored(current, least, large, own)
        current = following
        if after == before:
            found = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
            return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
        before = after
