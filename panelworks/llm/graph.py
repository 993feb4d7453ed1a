"""Connected components of a graph of links, on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelworks.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, c): for each node of ``edges`` (a, b: long) the smallest node it is connected to.

    In each round a node takes the least label among its neighbours', then the label of its label, so long chains take
    few rounds. Each round's labels are written to the shared folder; only a count of changes comes to the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct())
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("c")).withColumnRenamed("a", "v"))
    while True:
        near = both.join(labels.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("m"))
        less = labels.join(near.withColumnRenamed("a", "v"), "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        jump = labels.select(F.col("v").alias("c"), F.col("c").alias("cc"))
        new = stored(less.join(jump, "c", "left").select("v", "old", F.least("c", F.coalesce("cc", "c")).alias("c")))
        labels = new.select("v", "c")
        if not new.filter("c <> old").limit(1).count():
            return labels
