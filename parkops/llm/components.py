"""Connected components of an edge table, by alternating large and small stars.

Every round is a minimum per node (combined map-side) and a join; a node with very many
edges is never collected. Rounds are written to the shared folder, and their number
grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parkops.llm.common import written


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): every node of (a, b) with the least node of its component."""
    e = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                .filter("a != b").distinct(), "edges")
    for _ in range(max_rounds):
        last, e = e, written(_small_star(_large_star(e)), "edges")
        # stars only: every edge leads to a root, and none is new
        if e.join(last, ["a", "b"], "left_anti").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def _large_star(e: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of node and neighbours."""
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m")) \
        .select("n", F.least("n", "m").alias("m"))
    return both.join(least, both["a"] == least["n"]).filter("b > a") \
        .select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are tied to the least of them."""
    e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = e.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("m"))
    moved = e.join(least, e["a"] == least["n"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select(F.col("n").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(own).filter("a != b").distinct()
