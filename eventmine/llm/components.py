"""Connected components of a graph that no task holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage


def components(edges: DataFrame, most: int | None = None) -> DataFrame:
    """From edges (``a``, ``b``) between 64-bit node numbers: (``node``,
    ``root``) for every node that has an edge; nodes of one component share
    their root. Node numbers should be hashes, not counted up along a path.
    ``most``: number of edges, repeated ones included, if it is known.

    Each round points every node at the smallest of itself and its neighbours
    and contracts the graph along these pointers, so hubs need no list of
    their neighbours, only a minimum (summed up before the shuffle). With
    hashed numbers a round removes a fixed share of the nodes on average, so
    the rounds grow with the logarithm of the longest path."""
    edges = cut_lineage(edges.where(F.col("a") != F.col("b")).select("a", "b").distinct(), most)
    levels, n = [], edges.count()
    n_nodes = 2 * n
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = cut_lineage(both.groupBy("a").agg(F.min("b").alias("low")).select(
            F.col("a").alias("node"), F.least("a", "low").alias("root")), 2 * n)
        levels.append(point)
        left, right = (point.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        edges = cut_lineage(edges.join(left, "a").join(right, "b").where(F.col("ra") != F.col("rb")).select(
            F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), n)
        n = edges.count()
        if not n:
            break
    roots = levels.pop()
    while levels:
        below = levels.pop()
        above = roots.select(F.col("node").alias("root"), F.col("root").alias("top"))
        roots = below.join(above, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return cut_lineage(roots, n_nodes)
