"""Connected components of an edge list, by hooking and pointer jumping.

A round hooks every node to its smallest neighbour, follows the hooks to their ends, and keeps the
edges between different ends; a handful of rounds leaves none. Every table that a join reads is
first written to the shared folder: a join's both sides are then plain exchanges, whose large
partitions Spark can split, so a node with many neighbours is no task's burden. Nothing but counts
reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import checkpoint, scratch


def _follow(hooks: DataFrame) -> DataFrame:
    """(node, root): every chain of hooks followed to its end, twice as far each time."""
    while True:
        up = hooks.select(F.col("node").alias("root"), F.col("root").alias("_up"))
        far = checkpoint(hooks.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root"), (F.col("_up") < F.col("root")).alias("_moved")))
        hooks = far.select("node", "root")
        if not far.filter("_moved").limit(1).count():
            return hooks


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); a component is named by its smallest node.

    Loops and nulls are dropped, repeated and reversed edges count once; no edges, no rows.
    """
    with scratch(edges.sparkSession) as keep:
        return keep(_components(edges))


def _components(edges: DataFrame) -> DataFrame:
    pairs = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = checkpoint(pairs.distinct())
    labels = None
    while pairs.limit(1).count():
        both = pairs.select(F.col("a").alias("node"), F.col("b").alias("to")).unionByName(pairs.select(F.col("b").alias("node"), F.col("a").alias("to")))
        hooks = checkpoint(both.groupBy("node").agg(F.min("to").alias("to")).select("node", F.least("node", "to").alias("root")))
        roots = _follow(hooks)
        if labels is None:
            labels = roots
        else:
            up = roots.select(F.col("node").alias("root"), F.col("root").alias("_up"))
            labels = checkpoint(labels.join(up, "root", "left").select("node", F.coalesce("_up", "root").alias("root")))
        ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        half = checkpoint(pairs.join(ra, "a").select(F.col("ra"), "b").distinct())
        next_ = half.join(rb, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        pairs = checkpoint(next_.distinct())
    labels = pairs.select(F.col("a").alias("node"), F.col("a").alias("root")) if labels is None else labels
    return checkpoint(labels.select("node", F.col("root").alias("component")))
