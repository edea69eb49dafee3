"""Connected components of an edge table, by spreading the smallest label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b), where label is the smallest node that can be reached.

    Each round gives a node the smallest label among its neighbours and then the label of that label, so a path of n nodes
    takes about log n rounds. Labels stay distributed and are written once a round; only a count returns to the driver.
    """
    both = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).where("u <> v")
    both = stored(both.union(both.select("v", "u")).distinct(), "edges")
    labels = stored(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        met = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stored(met.join(jump, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        changed = new.where("label <> old").limit(1).count()
        discard(labels)
        labels = new.select("node", "label")
        labels._gazeflow_path = new._gazeflow_path
        if not changed:
            discard(both)
            return labels
