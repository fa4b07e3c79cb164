"""Connected components by repeated minimum and pointer jumping (joins and aggregates only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges(a, b)``: the smallest node that it can reach.

    Each round takes the smallest label among the neighbours (combined before the shuffle, so hubs are no
    hot groups) and then the label of that label, until nothing changes. Every round is written to the shared folder.
    """
    checkpoint_dir(edges.sparkSession)
    both = edges.select("a", "b").where("a <> b")
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")).checkpoint()
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", F.least("label", "near").alias("next"), "label")
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        new = step.join(jump, "next", "left").select(
            "node", F.least("next", F.coalesce("far", "next")).alias("next"), "label"
        ).checkpoint()
        changed = new.where("next <> label").limit(1).count()
        labels = new.select("node", F.col("next").alias("label"))
        if not changed:
            return labels
