"""Trees as (node, parent) tables: levels, closure, pruning, relabelling, aggregation up the tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def closure(tree: DataFrame, deepest: int = 64) -> DataFrame:
    """(node, ancestor, distance): every node with itself and all of its ancestors. A node may have several parents.

    One join per level of the tree, each level kept while the next is made; the loop ends with the deepest level there is.
    """
    edges = tree.filter("parent IS NOT NULL").select(F.col("node").alias("child"), F.col("parent").alias("up")).distinct()
    frontier = tree.select("node", F.col("node").alias("ancestor")).distinct().withColumn("distance", F.lit(0))
    out = frontier
    for distance in range(1, deepest + 1):
        frontier = frontier.join(edges, F.col("ancestor") == F.col("child")).select("node", F.col("up").alias("ancestor")).distinct().withColumn("distance", F.lit(distance)).persist()
        if frontier.isEmpty():
            return out.groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        out = out.unionByName(frontier)
    raise ValueError(f"the tree is deeper than {deepest} levels, or has a cycle")


def levels(tree: DataFrame) -> DataFrame:
    """(node, level): 0 at roots; the longest way up counts where there are several."""
    return closure(tree).groupBy("node").agg(F.max("distance").alias("level"))


def pruned_at(tree: DataFrame, cuts: DataFrame) -> DataFrame:
    """Without the cut nodes and all below them. cuts: node."""
    gone = closure(tree).join(cuts.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node")
    return tree.join(gone, "node", "left_anti")


def pruned_below(tree: DataFrame, cuts: DataFrame) -> DataFrame:
    """The cut nodes become leaves: what lies below them goes."""
    gone = closure(tree).filter("distance > 0").join(cuts.select(F.col("node").alias("ancestor")), "ancestor", "left_semi").select("node")
    return tree.join(gone, "node", "left_anti")


def to_targets(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """Nodes on the way from a root to a target."""
    kept = closure(tree).join(targets.select("node"), "node", "left_semi").select(F.col("ancestor").alias("node")).distinct()
    return tree.join(kept, "node", "left_semi")


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.filter("parent IS NOT NULL").select(F.col("parent").alias("node")), "node", "left_anti")


def relabelled(tree: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, label): the lowest label at or below each node; null where there is none. labels: node, label."""
    found = closure(tree).join(labels, "node").groupBy(F.col("ancestor").alias("node")).agg(F.min("label").alias("label"))
    return tree.select("node").distinct().join(found, "node", "left")


def aggregated_up(tree: DataFrame, values: DataFrame) -> DataFrame:
    """(node, total, n): sum and count of the values (node, value) at or below each node. Values are summed per node before they climb."""
    own = values.groupBy("node").agg(F.sum("value").alias("s"), F.count("value").alias("c"))
    return closure(tree).join(own, "node").groupBy(F.col("ancestor").alias("node")).agg(F.sum("s").alias("total"), F.sum("c").alias("n"))


def coarse_label(tree: DataFrame, structures: DataFrame) -> DataFrame:
    """(node, structure): the nearest of the given structures (node) at or above each node."""
    up = closure(tree).join(structures.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    return up.groupBy("node").agg(F.min_by("ancestor", F.struct("distance", "ancestor")).alias("structure"))


def reduced_labels(samples: DataFrame, tree: DataFrame, leaves: DataFrame) -> DataFrame:
    """(sample, node, label): each sample moves up to the leaf of a pruned tree above it, whose label is the smallest of its samples'; 0 and null without one.

    samples: sample, node, label; leaves: node.
    """
    up = closure(tree).join(leaves.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    moved = samples.join(up.select("node", "ancestor"), "node", "left").select("sample", F.col("ancestor").alias("node"), F.col("label").alias("own"))
    lowest = moved.filter("node IS NOT NULL").groupBy("node").agg(F.min("own").alias("label"))
    return moved.join(lowest, "node", "left").select("sample", "node", F.coalesce("label", F.lit(0)).alias("label"))
