"""Connected components of a graph given by its edges, by alternating large and small stars, all of it distributed.

Each round ties every node to the smallest neighbour it sees; it ends when the edges form stars, which is asked before each
round, so edges that are stars need none. Rounds grow with the logarithm of the longest path. Every round is a stored table,
so a lost executor costs a task, not the rounds before it. The driver learns one row a round; what a round adds to its memory
is its plan, so each edge is read once for each end and not in both directions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _stars(e: DataFrame) -> bool:
    """Has every node with an edge to a smaller one no other edge. e: distinct (u, v) with u > v."""
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"))))).select("col.*")
    return ends.groupBy("node").agg(F.max("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up = 1 AND n > 1").isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", store: Callable[[DataFrame, str], DataFrame] = staged) -> DataFrame:
    """edges: two columns of ids (pairs in either direction, repeats and loops allowed). (node, component) for every node
    that has an edge to another; component is the smallest id reachable. Isolated nodes are not in it. store: what stores the
    table of a round."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = store(e, "components")
    while not _stars(e):
        # The least of a node and its neighbours is one of the smaller ends of its edges, or itself.
        least = e.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        large = e.join(least, F.col("v") == F.col("x"), "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        e = store(small, "components")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())
