"""Connected components of a graph that does not fit one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.session import materialize


def components(links: DataFrame) -> DataFrame:
    """For links (a, b) of numbers: node and label, the smallest number that can be reached from it.

    Labels spread along links and jump to the label of their label in each pass; every pass is
    stored in the shared folder, so a lost executor costs one pass at most. Nodes without links are
    not in the result.
    """
    both = links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        lower = materialize(lower, "labels")
        jump = lower.select(F.col("node").alias("label"), F.col("label").alias("further"))
        lower = lower.join(jump, "label", "left").select("node", F.least("label", "further").alias("label"), "was")
        lower = materialize(lower, "labels")
        labels = lower.select("node", "label")
        if lower.where("label <> was").isEmpty():
            return labels
