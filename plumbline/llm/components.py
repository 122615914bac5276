"""Connected components of a graph of links, by joins and written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for links ``a, b``: the smallest node that each can reach.

    Every round, a node and the node its label names take the smallest label of a
    neighbour, and then labels follow their own labels, so long chains shorten by
    doubling. A table is written each round; rounds grow with the logarithm of the
    longest chain. Nodes without links are not in the result.
    """
    one_way = stored(links.select("a", "b").where("a <> b").distinct())
    both = one_way.unionByName(one_way.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn(
            "label", F.least("node", "label")
        )
    )
    while True:
        crossing = (
            both.join(labels.toDF("a", "label_a"), "a")
            .join(labels.toDF("b", "label_b"), "b")
            .where("label_b < label_a")
        )
        lower = stored(
            crossing.select(F.explode(F.array("a", "label_a")).alias("node"), "label_b")
            .groupBy("node")
            .agg(F.min("label_b").alias("lower"))
        )
        if lower.isEmpty():
            discard(one_way)
            return labels
        moved = labels.join(lower, "node", "left").select(
            "node", F.least("label", F.coalesce("lower", "label")).alias("label")
        )
        ends = moved.toDF("label", "end")
        before, labels = labels, stored(
            moved.join(ends, "label").select("node", F.col("end").alias("label"))
        )
        discard(before)
        discard(lower)
