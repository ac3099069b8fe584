"""Connected components as a distributed union-find: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetratio.llm.common import stored


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge to another node; root is the least node of its component.

    A large star hangs each node's greater neighbours on its least neighbour, a small star the lesser ones;
    after about log² rounds each component is one star. Each round is stored; only a count and a checksum reach
    the driver. Sums are combined before the shuffle and the joins can be split where a node has many neighbours.
    """
    current = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    seen = _fingerprint(current)
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both).select("u", F.least("u", "m").alias("m"))
        large = stored(both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large-star")
        hung = large.join(_lowest(large), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        current = stored(hung.distinct(), "small-star")
        now = _fingerprint(current)
        if now == seen:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
