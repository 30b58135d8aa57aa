"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relievo.lineage import cut


def components(edges: DataFrame) -> DataFrame:
    """node, component for the nodes of ``edges`` (a, b); the component is its smallest node.

    In a round every node moves to the one of itself and its neighbours whose hash is first, and
    once more from there; edges are renamed by these moves, and loops and repeats are dropped.
    By hash a share of the nodes goes in every round even where nodes are numbered along a
    path, so rounds grow with the logarithm of the longest path; what moved to the first node
    of all stays there, so a star is done in two.  A node with many neighbours only takes part
    in partial minima and in joins against unique keys.
    """
    edges = cut(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), sized=False)
    place = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("to"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    found, k = nodes.select("node", F.col("node").alias("component")), 0
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(F.col("a").alias("n")).agg(F.min(place("b")).alias("m")).select("n", F.least(place("n"), "m")["to"].alias("up"))
        top = up.select(F.col("n").alias("k"), F.col("up").alias("top"))
        move = cut(up.join(top, F.col("up") == F.col("k")).select("n", "top"))
        to = lambda side: move.select(F.col("n").alias(f"n_{side}"), F.col("top").alias(f"to_{side}"))  # noqa: B023, E731
        found = found.join(to("c"), F.col("component") == F.col("n_c"), "left").select("node", F.coalesce("to_c", "component").alias("component"))
        if k % 4 == 3:
            found = cut(found, sized=False)
        moved = edges.join(to("a"), F.col("a") == F.col("n_a")).join(to("b"), F.col("b") == F.col("n_b"))
        edges, k = cut(moved.where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), sized=False), k + 1
    found = cut(found)
    least = found.groupBy(F.col("component").alias("c")).agg(F.min("node").alias("least"))
    return cut(found.join(least, F.col("component") == F.col("c")).select("node", F.col("least").alias("component")))
