"""Connected components of links, by hooking and pointer jumping on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settled


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of ``links``; root is the least node of its component.

    Each round, every component hooks onto its least neighbour; chains of hooks are then halved
    until they are stars. Rounds grow with the logarithm of the longest chain. Only minima are
    aggregated, so nodes with many links are no burden; lineage is cut in the shared folder.
    """
    nodes = links.select(F.col(a).alias("node")).union(links.select(F.col(b).alias("node"))).distinct()
    labels = settled(nodes.select("node", F.col("node").alias("root")), "cc-labels")
    edges = settled(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v").distinct(), "cc-edges")
    while True:
        both = edges.union(edges.select("v", "u"))
        hooks = both.groupBy("u").agg(F.min("v").alias("to")).filter("to < u")
        hooks = settled(hooks, "cc-hooks")
        if hooks.isEmpty():
            return labels
        while True:
            up = hooks.select(F.col("u").alias("mid"), F.col("to").alias("top"))
            jumped = settled(hooks.join(up, hooks["to"] == up["mid"], "left").select("u", F.coalesce("top", "to").alias("to"), F.col("top").isNotNull().alias("moved")), "cc-hooks")
            moved = not jumped.filter("moved").isEmpty()
            hooks = jumped.select("u", "to")
            if not moved:
                break
        labels = settled(labels.join(hooks, labels["root"] == hooks["u"], "left").select("node", F.coalesce("to", "root").alias("root")), "cc-labels")
        left = edges.join(hooks, "u", "left").select(F.coalesce("to", "u").alias("u"), "v")
        right = left.join(hooks.select(F.col("u").alias("v"), F.col("to").alias("w")), "v", "left").select("u", F.coalesce("w", "v").alias("v"))
        edges = settled(right.filter("u <> v").distinct(), "cc-edges")
