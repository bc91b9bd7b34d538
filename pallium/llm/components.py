"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.session import join_by_hot_key, stored


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node hands the least node of its neighbourhood to its larger neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
    return join_by_hot_key(both.filter("v > u"), least, "u", "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """Each node hands its least neighbour to itself and to its other smaller neighbours. Edges go from large to small."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))
    return join_by_hot_key(edges, least, "u", "n", n).select(F.explode(both).alias("e")).select("e.*").filter("u <> v").distinct()


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of all nodes in `links`, the component being its least node.

    Nodes are longs. Self links and nulls are ignored; an empty table gives an empty result. The number of
    rounds grows with the logarithm of the longest path; each round is written to the shared folder. A node with
    very many neighbours is spread: its least neighbour is broadcast to them.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "links")
    seen, n = None, edges.count()
    while True:
        # stored between the stars too: each reads its edges several times
        edges = stored(_small_star(stored(_large_star(edges, n), "stars"), n), "stars")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        seen, n = state, state["n"]
