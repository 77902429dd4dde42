"""Connected components by least labels, with pointer jumping; each round is written to the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.tables import remove, settle


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of ``edges`` (a, b)."""
    spark = edges.sparkSession
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = settle(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen, labels["node"] == seen["a"]).select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("further"))
        step = step.join(jump, step["next"] == jump["at"], "left").select("node", "label", F.least("next", F.coalesce("further", "next")).alias("next"))
        step = settle(step)
        changed = not step.where("next <> label").isEmpty()
        remove(spark, labels)
        labels = step.select("node", F.col("next").alias("label"))
        if not changed:
            remove(spark, both)
            return labels
