"""Connected components of a graph of any shape, by large and small stars.

Each round links every node to the smallest node it knows, in joins and partial
aggregations only, so a node with a third of all edges is split like any other skewed key.
The edges of each round are a table in the shared folder. Rounds grow with the logarithm
of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import Stage, stage


def _all_stars(edges: DataFrame) -> bool:
    """Whether each ``u`` has one ``v`` and no ``v`` is a ``u``: then every component is a star around its ``v``."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"))
    ends = ends.unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    return not nodes.where("up > 1 or up = 1 and n > 1").count()


def _least_neighbour(pairs: DataFrame) -> Stage:
    """Per ``u`` the smallest of itself and its neighbours ``v``."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    return stage(least.select("u", F.least("u", "m").alias("m")), "least")


def _large_star(edges: DataFrame) -> Stage:
    """Neighbours above each node go to the smallest node around it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least_neighbour(both)
    moved = both.where("v > u").join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    made = stage(moved.where("u <> v").distinct(), "large_star")
    least.release()
    return made


def _small_star(edges: DataFrame) -> Stage:
    """Each node and the smaller nodes around it go to the smallest of them."""
    least = _least_neighbour(edges)
    moved = edges.join(least.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    made = stage(
        moved.unionByName(least.df.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small_star"
    )
    least.release()
    return made


def components(links: DataFrame) -> Stage:
    """``node`` and ``component`` (smallest node reachable) of every node that is not smallest.

    ``links`` has columns ``a`` and ``b``; loops, repeated and reversed links are harmless, but
    the latter two cost a round. A node that the result lacks is its own component.
    """
    oriented = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    now = stage(oriented.where("u <> v"), "links")
    while not _all_stars(now.df):
        large = _large_star(now.df)
        now.release()
        now = _small_star(large.df)
        large.release()
    return Stage(now.df.select(F.col("u").alias("node"), F.col("v").alias("component")), now.path)
