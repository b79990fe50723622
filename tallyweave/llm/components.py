"""Connected components by smallest label, with joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tallyweave.session import cut, settle


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``v, label``: each vertex of ``edges`` with the smallest vertex of its component.

    Each round takes the smallest label next to a vertex and then the label of
    that label, so long chains halve. A vertex with very many edges is a partial
    minimum in every task. Rounds are cut by a checkpoint; only a count comes to
    the driver. Loops and repeated edges are allowed, an empty table gives none.
    """
    one = edges.select(F.col(a).alias("v"), F.col(b).alias("w"))
    both = settle(one.unionByName(one.select(F.col("w").alias("v"), F.col("v").alias("w"))).distinct())
    labels = cut(both.groupBy("v").agg(F.least(F.min("w"), F.first("v")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("v", "w"), "w").select("v", "label")
        low = near.unionByName(labels).groupBy("v").agg(F.min("label").alias("label"))
        jump = low.select(F.col("v").alias("label"), F.col("label").alias("next"))
        new = low.join(jump, "label", "left").select("v", F.coalesce("next", "label").alias("label"))
        new = cut(new)
        moved = new.join(labels.withColumnRenamed("label", "old"), "v").filter(F.col("label") != F.col("old"))
        labels = new
        if moved.isEmpty():
            return labels
