"""Category trees as rows: one for each path prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(leaves: DataFrame, path: str = "path") -> DataFrame:
    """node (path joined by " / "), name, depth (from 1), parent, n_leaves (below it and at it), n_direct (at it).

    Every leaf counts for each prefix of its path, so the roll-up is one explode and one pre-aggregated grouping. Leaves
    with an empty path make no node."""
    levels = F.sequence(F.lit(1), F.size(path))
    nodes = leaves.where(F.size(path) > 0).select(path, F.explode(levels).alias("depth")).select(
        F.slice(path, F.lit(1), F.col("depth")).alias("prefix"), "depth", (F.col("depth") == F.size(path)).alias("direct"))
    out = nodes.groupBy("prefix", "depth").agg(F.count("*").alias("n_leaves"), F.count_if("direct").alias("n_direct"))
    parent = F.array_join(F.slice("prefix", F.lit(1), F.greatest(F.col("depth") - 1, F.lit(0))), " / ")
    return out.select(F.array_join("prefix", " / ").alias("node"), F.element_at("prefix", -1).alias("name"), "depth", parent.alias("parent"), "n_leaves", "n_direct")


def ordered(tree: DataFrame) -> DataFrame:
    """Siblings by name without case, each below its parent."""
    return tree.orderBy(F.lower("node"))


def pruned(leaves: DataFrame, matches, path: str = "path") -> DataFrame:
    """The tree over leaves that match only, so that nodes without any go."""
    return build(leaves.where(matches), path)
