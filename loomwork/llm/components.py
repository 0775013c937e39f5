"""Connected components of an edge table by alternating large-star and small-star steps, all distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, hot, saved


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether each edge (a, b) joins a node b to its root a, with one root a node and no root that is a node."""
    n = edges.count()
    if edges.select("b").distinct().count() != n:
        return False
    roots = edges.select(F.col("a").alias("r")).distinct()
    return roots.join(edges, F.col("r") == F.col("b"), "left_semi").isEmpty()


def _joined(rows: DataFrame, least: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with ``m`` of their ``key``. A star's centre may be the key of a third of all rows: such keys, ``HOT_SHARE`` at most, meet
    their rows by broadcast."""
    same = F.col(key) == F.col("u")
    many = hot(F.col("n"), total)
    common = F.broadcast(least.where(many))
    return rows.join(common, same).union(rows.join(common, same, "left_anti").join(least.where(~many), same))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is joined to the least of the node and its neighbours."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.least(F.col("u"), F.min("b")).alias("m"), F.count("*").alias("n"))
    return _joined(both.where("b > a"), least, "a", 2 * edges.count()).select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are joined to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("w"), F.least("a", "b").alias("v"))
    least = down.groupBy(F.col("w").alias("u")).agg(F.min("v").alias("m"), F.count("*").alias("n"))
    joined = _joined(down, least, "w", edges.count()).select(F.col("m").alias("a"), F.col("v").alias("b"))
    return joined.union(least.select(F.col("m").alias("a"), F.col("u").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), root being its component's least node. Rounds grow with the logarithm of the
    longest path; each is written to the shared folder, and the one before it deleted."""
    now = saved(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    while not _is_forest_of_stars(now):
        large = saved(_large_star(now), "large-star")
        dropped(now)
        now = saved(_small_star(large), "small-star")
        dropped(large)
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).union(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
