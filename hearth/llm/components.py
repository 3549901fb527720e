"""Connected components by alternating large-star and small-star steps.

Edges are rows; no node's neighbours are ever gathered into one place.  Minima are
aggregated on the map side and joined back, so a node with very many neighbours is a
skewed join that Spark splits, not a large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    return pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def large_star(edges: DataFrame) -> DataFrame:
    """Links each greater neighbour of a node to the least node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written first: both sides of the join are then plain shuffles, of which Spark splits skewed ones
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
    return _star(both.where("v > u"), least)


def small_star(edges: DataFrame) -> DataFrame:
    """Links each lesser neighbour of a node, and the node, to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = materialise(down.groupBy("u").agg(F.min("v").alias("m")), "components-least")
    return _star(down, least).unionByName(least.select("u", F.col("m").alias("v")))


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the least node reachable, for each node of ``edges`` (u, v) of integers.

    Ends when every component is a star around its least node: no edge leads to a node
    from which another leads on, and no node has two edges.
    """
    edges = edges.where("u <> v").select("u", "v").distinct()
    for _ in range(max_rounds):
        edges = materialise(small_star(large_star(edges)).distinct(), "components")
        # every edge leads to a lesser node; in a star each node but the least has one, to the least
        onward = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
        if not onward.take(1) and not edges.groupBy("u").count().where("count > 1").take(1):
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
