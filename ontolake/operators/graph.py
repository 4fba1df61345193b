"""Fixed points over edges: reachability, closures, components. Each round is a stored table and joins only what is new."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ResourceLimitError
from ..staging import stored, stored_rows


def reachable(edges: DataFrame, seeds: DataFrame | None = None, reflexive: bool = False, rounds: int = 200) -> DataFrame:
    """Semi-naive closure of edges (src, dst): all (src, dst) with a path of one edge or more. seeds: (src) to start from;
    reflexive: each start also reaches itself. A path longer than `rounds` raises."""
    e = edges.select("src", "dst").distinct()
    starts = seeds.select("src").distinct() if seeds is not None else None
    first = e if starts is None else e.join(starts, "src", "left_semi")
    every = delta = stored(first, "closure")
    step = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    for _ in range(rounds):
        found = delta.join(step, "dst").select("src", F.col("next").alias("dst")).distinct().join(every, ["src", "dst"], "left_anti")
        delta, n = stored_rows(found, "closure")
        if not n:
            break
        every = every.union(delta)
    else:
        raise ResourceLimitError(f"a path of more than {rounds} edges")
    if reflexive:
        own = starts if starts is not None else e.select("src").union(e.select("dst")).distinct()
        every = every.union(own.select("src", F.col("src").alias("dst"))).distinct()
    return every


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) of an undirected graph given by (src, dst): the smallest node reachable. Labels fall to the
    smallest neighbour's, then to their label's label, so the rounds grow with the logarithm of the paths."""
    both = stored(edges.select("src", "dst").union(edges.select("dst", "src")).distinct(), "component-edges")
    label = stored(both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("label")).select(F.col("src").alias("node"), "label"), "components")
    for _ in range(rounds):
        near = both.join(label, both.dst == label.node).groupBy("src").agg(F.min("label").alias("near"))
        one = label.join(near, F.col("node") == F.col("src"), "left").select("node", F.least("label", F.coalesce("near", "label")).alias("to"), F.col("label").alias("was"))
        jump = one.select(F.col("node").alias("to"), F.col("to").alias("label"))
        one = one.join(jump, "to", "left").select("node", F.coalesce("label", "to").alias("label"), "was")
        now = stored(one, "components")
        moved = not now.where("label <> was").isEmpty()
        label = now.select("node", "label")
        if not moved:
            return label.withColumnRenamed("label", "component")
    raise ResourceLimitError(f"a component wider than 2^{rounds}")
