"""Connected components of links between rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from .tables import written



def components(links: DataFrame) -> DataFrame:
    """(node, component): each node of the links (a, b) and the smallest node it reaches.

    Each round a node takes the smallest label among its neighbours and itself, then
    the label of that label, until nothing changes. Rounds are written to the shared
    folder; only the number of changes reaches the driver.
    """
    both = written(
        links.select("a", "b").union(links.select("b", "a")).distinct().toDF("a", "b"), "links")
    labels = written(both.groupBy("a").agg(F.min("b").alias("low"))
                           .select(F.col("a").alias("node"), F.least("a", "low").alias("component")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a")
                .agg(F.min("component").alias("near")))
        lower = written(labels.join(near, labels.node == near.a).select(
            "node", F.least("component", "near").alias("component"), F.col("component").alias("old")), "lower")
        up = lower.select(F.col("node").alias("_n"), F.col("component").alias("_up"))
        after = written(
            lower.join(up, lower.component == up._n)
            .select("node", F.col("_up").alias("component"), (F.col("_up") != F.col("old")).alias("changed")),
            "labels")
        labels = after.select("node", "component")
        if not after.filter("changed").limit(1).count():
            return labels
