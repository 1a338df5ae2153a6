"""Connected components of an edge table, by least labels, hooked roots and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released

MAX_ROUNDS = 60


def components(edges: DataFrame, src: str = "u", dst: str = "v") -> DataFrame:
    """node, label (the least node reachable) for every node of an undirected edge table.

    Each round a label hears the least label across the edges of its nodes and takes it (roots hook onto roots), and every
    label jumps to its own label: long chains take about as many rounds as their length has bits. Edges within a label
    have nothing more to tell and go, so that a group with many edges is read whole once, not in every round. All are
    aggregations with map-side combine and joins that adaptive execution can split. The edges left and the labels are
    checkpointed each round, which keeps plans short.
    A node without edges is not in the result; no edges give no rows.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    both = checkpointed(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = checkpointed(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")).withColumnRenamed("a", "node"))
    for _ in range(MAX_ROUNDS):
        told = both.join(labels.toDF("b", "near"), "b").join(labels.toDF("a", "label"), "a")
        told = checkpointed(told.filter("near <> label").select("a", "b", "label", "near"))
        if told.isEmpty():
            return labels
        hook = told.groupBy("label").agg(F.min("near").alias("hook"))
        near = labels.join(hook, "label", "left").select("node", F.least("label", "hook").alias("near"))
        root = near.select(F.col("node").alias("near"), F.col("near").alias("root"))
        labels = checkpointed(near.join(root, "near").select("node", F.col("root").alias("label")))
        both = told.select("a", "b")
        del told, hook, near, root
        released(edges.sparkSession)
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
