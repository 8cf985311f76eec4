"""Connected components by alternating large-star and small-star steps.

The method of Kiveris et al. (2014): every step only groups and joins edges, the number of
edges never grows beyond the input's, and stars (one hub with very many members) settle in
two rounds. Each round is checkpointed, so plans stay short and a lost executor costs one
round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.plans.workspace import cut


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _stars(edges: DataFrame) -> bool:
    """Does every node have one edge, to a node that has none of its own?"""
    many = edges.groupBy("a").count().filter("count > 1").select("a")
    chained = edges.select("a").join(edges.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
    return many.unionByName(chained).isEmpty()


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", *, max_rounds: int = 60) -> DataFrame:
    """``node, component`` for every node that has an edge to another node.

    ``component`` is the smallest node of the component; nodes may be of any orderable type.
    Nulls, loops and repeated edges are ignored. Raises if ``max_rounds`` do not settle it.
    """
    e = edges.select(F.col(left).alias("a"), F.col(right).alias("b")).filter("a is not null and b is not null and a <> b")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _stars(e):
            roots = e.select(F.col("b").alias("node")).distinct()
            return e.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
        e = cut(_small_star(_large_star(e)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
