"""Connected components by smallest labels, over an edge table of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tierseek.llm.common import table


def min_labels(edges: DataFrame) -> DataFrame:
    """node, label: for each end of an edge (a, b) the smallest node that it is connected with.

    First every node keeps one edge, to its smallest neighbour, and its other smaller neighbours get one to that: a group whose
    members name several hubs each then has about one edge for each member. Each round takes the smallest label among the neighbours and then the label's own label, so a path of n nodes takes
    about log n rounds. Nothing but a count of changes reaches the driver; a node with many neighbours is met by partial
    aggregates and by joins whose other side has one row for it.
    """
    down = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    low = down.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    down = low.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()
    e = table(down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = table(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = e.join(labels, e.b == labels.node).groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, labels.node == near.a).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        new = table(new)
        up = new.select(F.col("node").alias("at"), F.col("label").alias("top"))
        new = table(new.join(up, F.col("label") == F.col("at")).select("node", "old", F.least("label", "top").alias("label")))
        labels = new.select("node", "label")
        if not new.where("label <> old").limit(1).count():
            return labels
