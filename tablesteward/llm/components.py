"""Connected components of an edge table by smallest labels and pointer jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesteward.session import materialize


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, label`` for every node of an edge; the label is the component's smallest node.

    A round takes the smallest label among neighbours and then the label of that
    label, so long chains shrink by half or better. Each round is a table in the
    shared folder: a lost executor costs a retry of one round, and plans stay
    short. Every aggregate is a minimum and combines before its shuffle; joins on
    a hub's key are plain ones that adaptive execution can split.
    """
    pairs = edges.select(F.col(left).alias("node"), F.col(right).alias("near")).where("node != near")
    both = materialize(pairs.union(pairs.select(F.col("near"), F.col("node"))).distinct(), "component-edges")
    labels = both.groupBy("node").agg(F.min("near").alias("near"))
    labels = materialize(labels.select("node", F.least("node", "near").alias("label")), "component-labels")
    while True:
        offers = (
            both.join(labels.select(F.col("node").alias("near"), F.col("label").alias("offer")), "near")
            .groupBy("node")
            .agg(F.min("offer").alias("offer"))
        )
        hooked = labels.join(offers, "node").select("node", "label", F.least("label", "offer").alias("better"))
        hooked = materialize(hooked, "component-hooks")
        jumps = hooked.select(F.col("node").alias("better"), F.col("better").alias("beyond"))
        jumped = hooked.join(jumps, "better").select("node", F.least("better", "beyond").alias("label"), F.col("label").alias("old"))
        labels = materialize(jumped, "component-labels")
        if labels.where("label != old").isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
