"""Connected components of links, by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import scratch


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for the nodes of ``links`` (a, b).

    Each round takes the smallest label among the neighbours (pre-aggregated, so a hub does no
    harm) and then the label's own label; a round's table is written to the shared folder. Only
    one number a round, that of the changed labels, reaches the driver.
    """
    both = scratch(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = scratch(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("component").alias("least"))
        step = labels.join(near, labels["node"] == near["n"]).select("node", F.col("component").alias("old"), F.least("component", "least").alias("next"))
        own = labels.select(F.col("node").alias("m"), F.col("component").alias("jump"))
        moved = step.join(own, F.col("next") == F.col("m")).select("node", "old", F.least("next", "jump").alias("component"))
        moved = scratch(moved, "labels")
        labels = moved.select("node", "component")
        if not moved.filter(F.col("old") != F.col("component")).count():
            return labels
