"""Connected components over an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, work: Scratch) -> DataFrame:
    """node, label (the smallest node that it reaches) of every node in edges (a, b: long).

    Large stars link a node's larger neighbours to its smallest one, small stars do so with the smaller ones; both keep
    components, and after a number of rounds about the logarithm of the largest component's length only stars are left.
    Minima are pre-aggregated and joined back, so a hub with many edges is split by adaptive skew joins; every round is
    written to the shared folder, where work keeps it.
    """
    now = work.cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        roots = now.select(F.col("b").alias("a")).distinct()
        if now.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty() and now.join(roots, "a", "left_semi").isEmpty():  # stars only
            roots = now.select(F.col("b").alias("node"), F.col("b").alias("label"))
            return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots).distinct()
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        other = F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b"))
        small = large.join(lower, "a").select(other.alias("a"), F.col("m").alias("b"))
        now = work.cut(small.unionByName(lower.select("a", F.col("m").alias("b"))).distinct())
