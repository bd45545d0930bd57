"""Connected components by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.plans.lineage import cut, drop


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of every node of ``edges`` (a, b): the smallest node it reaches.

    Each round takes the least label among the neighbours (combined on the map
    side, so a hub is no hot group) and then the label of that label, so the
    number of rounds grows with the logarithm of the longest path.  A round's
    file goes when the next one is written.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "other").where("node <> other").distinct())
    labels = cut(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    last = None
    while True:
        heard = both.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        moved = cut(near.join(jump, "next", "left").select("node", "label", F.least("next", F.coalesce("far", "next")).alias("next")))
        labels = moved.select("node", F.col("next").alias("label"))
        if last is not None:
            drop(last)
        last = moved
        if moved.where("label <> next").isEmpty():
            return labels
