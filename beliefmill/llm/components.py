"""Distributed connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that an edge names; component is the smallest node of its part.

    Each round hooks every node to its smallest neighbour, jumps one pointer, and contracts the graph to
    the labels, so a path shrinks by half or more a round and the loop ends after at most log2(longest
    path) rounds. Minima are aggregated before the shuffle, so a node with very many edges costs one row
    for each task; the joins are plain equi-joins, which adaptive execution may split where a label is
    hot. Every round is written to the shared folder, and its tables are deleted after the next one;
    only an emptiness flag reaches the driver.
    Edges with a null end and self loops are ignored; an empty edge table gives an empty result.
    """
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b")
    pairs = staged(pairs.distinct(), "cc-edges")
    labels = None
    while not pairs.isEmpty():
        both = pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a")))
        low = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        low = low.select("node", F.least("node", "low").alias("low"))
        jump = low.select(F.col("node").alias("low"), F.col("low").alias("next"))
        step = staged(low.join(jump, "low").select("node", F.col("next").alias("label")), "cc-step")
        if labels is None:
            labels = step
        else:
            to = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            old = labels
            labels = old.join(to, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
            labels = staged(labels, "cc-labels")
            dropped(old)
        left = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        right = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        old = pairs
        pairs = old.join(left, "a").join(right, "b").select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
        pairs = staged(pairs.where("a < b").distinct(), "cc-edges")
        dropped(old, step if labels is not step else None)
    if labels is None:
        return pairs.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return labels.select("node", F.col("label").alias("component"))
