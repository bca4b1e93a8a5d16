"""Connected components of a graph given as an edge table, by alternating large-star and small-star steps.

Every step is two small aggregations; the edges are written to the shared folder after each, so that lineage stays short and a
lost executor costs one step. Hubs are no problem: a node's neighbours are reduced to a minimum and joined back, never gathered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_dir


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's smallest neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    return (
        down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
    )


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has an edge; root is the smallest node of its component. ``edges`` has u and v."""
    shared_dir(edges.sparkSession)
    now = edges.where("u <> v").select("u", "v").distinct().checkpoint()
    before = None
    for _ in range(most_rounds):
        large = _large_star(now).where("u <> v").distinct()
        now = _small_star(large).where("u <> v").distinct().checkpoint()
        # Stars that no longer change: each round's edges are summed to one number that does not depend on order.
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root"))
            ).distinct()
        before = state
    raise RuntimeError(f"components have not settled after {most_rounds} rounds")
