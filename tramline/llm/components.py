"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tramline.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for every node of ``edges(a, b)`` (longs): label is the lowest node of its component.

    Each round takes the lowest label among a node's neighbours and then the label of that label (pointer jumping), so
    the number of rounds grows with the logarithm of a path's length. Every round is written to the shared folder; only
    a count comes to the driver. Loops and repeated edges do no harm."""
    edges = edges.where("a <> b")
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("_l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("_l").alias("_near"))
        low = labels.join(near, "node").select("node", F.col("label").alias("_old"), F.least("label", "_near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("_further"))
        after = written(low.join(jump, "label", "left").select("node", "_old", F.least("label", F.coalesce("_further", "label")).alias("label")), "labels")
        if after.where(F.col("_old") != F.col("label")).isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")


def hub_components(links: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of ``links(node, hub)`` (longs): nodes that share a hub hang together, and so on.

    Each node is tied to its lowest hub and each of its other hubs to that one, so only hubs go through the rounds of
    ``components``: a group of a million nodes around a few hubs costs a few edges. A node's hubs are one row; callers
    bound how many it has. The label is the lowest hub of the component."""
    of_node = written(links.groupBy("node").agg(F.min("hub").alias("least"), F.collect_set("hub").alias("hubs")), "hubs")
    edges = of_node.select(F.explode("hubs").alias("a"), F.col("least").alias("b")).distinct()
    labels = components(edges).select(F.col("node").alias("least"), "label")
    return of_node.select("node", "least").join(labels, "least", "left").select("node", F.coalesce("label", "least").alias("label"))
