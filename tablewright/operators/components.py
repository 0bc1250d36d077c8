"""Connected components of an edge table by repeated star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

MAX_ROUNDS = 60


def _only_stars(edges: DataFrame) -> bool:
    """Every node points to one centre and no centre points on: nothing is left to contract."""
    centres = edges.select(F.col("v").alias("u")).distinct()
    if not edges.join(centres, "u", "left_semi").limit(1).isEmpty():
        return False
    return edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").limit(1).isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of (a, b); component is the smallest node id reached.

    Alternating large-star and small-star steps (Kiveris et al., SoCC 2014). Minima combine map-side
    and the join back to the edges is an ordinary equi-join that AQE can split on a hot node. The edge
    set is checkpointed every round and shrinks to one star per component.
    """
    current = cut_lineage(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(MAX_ROUNDS):
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            low.select("u", F.col("m").alias("v"))
        )
        current = cut_lineage(small.filter("u <> v").distinct())
        if _only_stars(current):
            break
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
