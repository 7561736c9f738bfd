"""Connected components of an edge table, by least labels and label jumps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narralake.llm.common import keep


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of (a, b): the least node of its component.

    Each round gives a node the least label among its neighbours and itself,
    then the label of that label, which halves long chains.  Labels are reduced
    before the shuffle, and the rows of a hot node are split by Spark's skewed
    join, as nothing but a partial minimum follows it.
    """
    both = keep(
        edges.where("a <> b").select("a", "b").unionByName(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "edges",
    )
    labels = keep(
        both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")), "labels"
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").select(F.col("a").alias("node"), "label")
        least = near.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        over = labels.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        jumped = least.join(over, "label", "left").select("node", F.least("label", "_next").alias("label"))
        fresh = keep(jumped, "labels")
        changed = fresh.join(labels.withColumnRenamed("label", "_was"), "node").where("label <> _was")
        done = changed.isEmpty()
        labels = fresh
        if done:
            return labels
