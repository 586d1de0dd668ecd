"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, join_groups, keep


def _with_least(pairs: DataFrame) -> DataFrame:
    """(u, v) with m, the least of u and all its v. Sums by key first; a hub's rows can be split over tasks."""
    least = pairs.groupBy(F.col("u").alias("k")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return join_groups(pairs, least, F.col("u") == F.col("k")).select("u", "v", "m")


def large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of u is linked to the least of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours are linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    linked = _with_least(down)
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node either has one parent and no child, or no parent."""
    one = F.lit(1)
    roles = edges.select(F.col("u").alias("n"), one.alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), one.alias("down")))
    return roles.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges(u long, v long)``; the root is the component's least node.

    Each round is written to the shared folder, and the one before is deleted. Rounds grow with the logarithm
    of the nodes.
    """
    stars = keep(small_star(large_star(edges.where("u != v"))), "stars")
    for _ in range(most_rounds):
        if _is_stars(stars):
            children = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return children.union(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, stars = stars, keep(small_star(large_star(stars)), "stars")
        drop(before)
    raise RuntimeError("components: no end after the given rounds")
