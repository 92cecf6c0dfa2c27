"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from llm.common import materialise


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for the ends of ``links (a, b)``; a component is named by its
    smallest node.

    Contraction: every component hooks onto its smallest neighbour, hooks are followed one
    step further, and the links between what remains are relabelled. Links shrink from round
    to round; nothing but their count reaches the driver.
    """
    open_links = materialise(links.where("a <> b").distinct(), "links")
    labels = materialise(open_links.select(F.col("a").alias("node")).union(open_links.select("b")).distinct().select(
        "node", F.col("node").alias("component")), "labels")
    while not open_links.isEmpty():
        both = open_links.union(open_links.select("b", "a"))
        hooks = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("b"))
        hooks = materialise(hooks, "hooks")
        further = hooks.select(F.col("a").alias("b"), F.col("b").alias("c"))
        hooks = materialise(hooks.join(further, "b").select("a", F.col("c").alias("b")), "hooks")
        moved = hooks.select(F.col("a").alias("component"), F.col("b").alias("to"))
        labels = materialise(labels.join(moved, "component", "left").select(
            "node", F.coalesce("to", "component").alias("component")), "labels")
        renamed = hooks.select("a", F.col("b").alias("a2"))
        left = open_links.join(renamed, "a").select(F.col("a2").alias("x"), F.col("b").alias("a"))
        left = left.join(renamed, "a").select(F.col("x").alias("a"), F.col("a2").alias("b"))
        open_links = materialise(left.where("a <> b").select(
            F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    return labels
