"""Reading the tables and writing intermediate ones where every executor can read them."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch where the session keeps Spark's own 64 MB; a task holds several batches at a time, in both processes.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH, "67108864b") in ("67108864b", "67108864", "64MB", "64m"):
        spark.conf.set(BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``; without that setting under the warehouse, which one machine shares with itself."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/quire-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut in the lineage that survives lost executors."""
    path = scratch(df.sparkSession)
    small_batches(df.sparkSession)
    # small row groups: a writer holds one in memory
    df.write.option("parquet.block.size", 16 << 20).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete the files of settled tables that no later step reads."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for df in tables for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now and not whenever the driver's memory fills up."""
    gc.collect()
    spark._jvm.System.gc()


def text_key(column: str = "text") -> tuple:
    """Two independent 64-bit hashes of a text; together they stand for the text."""
    text = F.coalesce(F.col(column), F.lit(""))
    return F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")
