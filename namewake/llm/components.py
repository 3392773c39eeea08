"""Connected components by smallest label and pointer jumping, on joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, label), the label being the smallest node that can be reached.

    Every round takes the smallest label among the neighbours and then the label of that label, so long
    chains shorten by half a round. A hub is a skewed join, which Spark splits, and a pre-aggregated minimum;
    no group is gathered. Nodes without a link do not appear; no links give no rows; repeated links and
    self-links change nothing; links with a null end are ignored.
    """
    ends = edges.select("a", "b").where("a <> b")
    both = stored(ends.union(ends.select("b", "a")).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least("a", F.min("b")).alias("label")))
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        root = labels.select(F.col("node").alias("label"), F.col("label").alias("root"))
        new = stored(step.join(root, "label", "left").select("node", "old", F.least("label", "root").alias("label")))
        labels = new.select("node", "label")
        if new.where("label <> old").isEmpty():
            return labels
