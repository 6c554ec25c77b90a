"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stored


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b) to node and component, the smallest node of its component, for every node of an edge.

    Each round gives every node the smallest label among its own and its neighbours', then the label of that label
    (pointer jumping), so that long chains shorten quickly. Rounds are written to the shared folder, which ends their
    lineage; only the number of changed labels comes to the driver. All sums are pre-aggregated minima.
    """
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-edges")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("component")), "cc-labels")
    for _ in range(most_rounds):
        before = labels
        near = both.join(before, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        step = before.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "least").alias("least"))
        jump = before.select(F.col("node").alias("via"), F.col("component").alias("next"))
        labels = stored(step.join(jump, F.col("least") == F.col("via"), "left").select("node", "old", F.least("least", F.coalesce("next", "least")).alias("component")), "cc-labels")
        drop(before)
        if not labels.where("old <> component").limit(1).count():
            drop(both)
            return labels.select("node", "component")
    raise RuntimeError("components haven't settled")
