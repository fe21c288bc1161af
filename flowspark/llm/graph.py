"""Connected components of an edge table by contraction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written


def components(edges: DataFrame, keep: Callable[[DataFrame], DataFrame] = written) -> DataFrame:
    """``node, label`` for every end of the edges ``a, b``; nodes of one component share the label, one of its nodes.

    Each round, a node points to its neighbour of least priority, if that is less than its own, and edges are redrawn
    between what their ends point to. Priorities are hashes seeded by the round, so every round is expected to merge a
    fixed share of what is left, whatever the graph's shape. Both sides of each join are written tables: adaptive
    execution can split a hub's partition. ``keep`` writes a table.
    """
    current = keep(edges.filter("a <> b").distinct())
    maps: list[DataFrame] = []
    while not current.isEmpty():
        seed = F.lit(len(maps))
        both = current.select("a", "b").union(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("p"), F.col("b").alias("n"))).alias("m"))
        own = F.struct(F.xxhash64("a", seed).alias("p"), F.col("a").alias("n"))
        step = keep(least.select(F.col("a").alias("node"), F.least(own, F.col("m"))["n"].alias("parent")))
        maps.append(step)
        ends = lambda c: step.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))  # noqa: B023, E731
        moved = current.join(ends("a"), "a").join(ends("b"), "b")
        current = keep(moved.filter("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct())
    if not maps:
        return current.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = maps.pop().select("node", F.col("parent").alias("label"))
    while maps:
        step = maps.pop()
        named = labels.select(F.col("node").alias("parent"), "label")
        labels = keep(step.join(named, "parent", "left").select("node", F.coalesce("label", "parent").alias("label")))
    return labels
