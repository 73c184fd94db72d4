"""Connected components of a link table by alternating large and small stars.

Every step is a minimum per node (merged before the shuffle) and a join with a table that has one row per node, which
adaptive execution can split, so a node with very many links is no single task. Steps are written to the shared folder, and deleted
when the next one stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyscope.session import discard, settle


def _least(links: DataFrame, node: str, other: str) -> DataFrame:
    return links.groupBy(F.col(node).alias("node")).agg(F.min(other).alias("least"))


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node that has a link; ``root`` is the smallest node of its component.

    Links are undirected; loops, repeated links and links with a null end are ignored.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = settle(pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("u") > F.col("v"))).distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Large star: every neighbour above a node goes to the smallest neighbour of that node.
        least = _least(both, "u", "v").select("node", F.least("node", "least").alias("least"))
        large = (
            both.filter(F.col("v") > F.col("u"))
            .join(least, F.col("u") == F.col("node"))
            .select(F.col("v").alias("u"), F.col("least").alias("v"))
            .distinct()
        )
        large = settle(large)
        # Small star: a node and its neighbours below it go to the smallest of them.
        least = _least(large, "u", "v")
        small = large.join(least, F.col("u") == F.col("node"))
        used = (edges, large)
        edges = settle(
            small.select(F.col("v").alias("u"), F.col("least").alias("v"))
            .filter(F.col("u") > F.col("v"))
            .unionAll(least.select(F.col("node").alias("u"), F.col("least").alias("v")))
            .distinct()
        )
        discard(*used)
        # Both stars leave the links as they are once every node hangs on its root.
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        before = now
