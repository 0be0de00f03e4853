"""Connected components by label propagation with pointer jumping."""

from pyspark.sql import DataFrame, functions as F

from gazette.plans.store import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every end of ``edges`` (``a, b``): the smallest node reachable.

    Each round takes the smallest label among a node and its neighbours and then the label of that
    label. Labels are combined on the map side, so a node with very many links is no hot spot, and
    every round is written out, so no lineage grows.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        after = materialise(lower.join(jump, "low").select("node", F.col("label").alias("was"), F.least("low", "far").alias("label")))
        if after.filter("label <> was").isEmpty():
            return after.select("node", "label")
        labels = after.select("node", "label")
