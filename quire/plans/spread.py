"""Use of all cores where a table has fewer splits than cores, and joins that keep to a partitioning by document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Steps beyond which counting partitions would run a part of the plan.
_STEPS = ("Join", "Aggregate", "Window", "Repartition", "Sort", "Generate", "Union", "MapInArrow", "FlatMapGroups")


def spread(df: DataFrame) -> DataFrame:
    """``df``, if it is a bare scan, dealt to all cores if it has fewer partitions than half of them; tables of many splits stay as they are."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    if any(step in plan for step in _STEPS):
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def colocated(spark: SparkSession) -> None:
    """Let joins on (doc_id, page_num, ...) keep the partitioning by doc_id that both sides have, and so add no shuffle."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
