"""Connected components of an edge table, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm.tables import stored


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of links; component is the least node reachable.

    Each round takes the least label among a node and its neighbours, then the label of that label, so the number of
    rounds is about the logarithm of the longest path. Labels are written to the shared folder each round.
    """
    ends = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = stored(ends.union(ends.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("component")), "labels")
    while True:
        seen = both.join(labels.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("beyond"))
        moved = stored(near.join(jump, "component", "left").select("node", "was", F.least("component", F.coalesce("beyond", "component")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if not moved.where("was <> component").limit(1).count():
            return labels
