"""Connected components by contraction, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.scratch import Scratch


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b); nodes with one label are those that edges connect.

    Each round points every node to its smallest neighbour, or to itself if none is smaller,
    and replaces nodes by what they point to. Node numbers are hashes, so a round removes a
    constant share of the nodes on average, and rounds grow with the logarithm of the nodes.
    A node with any number of edges is met in partial minima only.
    """
    labels = None
    edges = scratch.keep(edges.where("a <> b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("to"))
        to = scratch.keep(to, "to")
        moved = edges.join(to.select(F.col("node").alias("a"), F.col("to").alias("a2")), "a")
        moved = moved.join(to.select(F.col("node").alias("b"), F.col("to").alias("b2")), "b")
        after = scratch.keep(
            moved.where("a2 <> b2").select(F.least("a2", "b2").alias("a"), F.greatest("a2", "b2").alias("b")).distinct(), "edges"
        )
        if labels is None:
            labels = to.select("node", F.col("to").alias("label"))
        else:
            step = to.select(F.col("node").alias("label"), "to")
            before, labels = labels, labels.join(step, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
            labels = scratch.keep(labels, "labels")
            scratch.drop(before)
        scratch.drop(edges)
        edges = after
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
