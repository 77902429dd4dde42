"""A folder of PDF files as a stream: new files become glyph rows with the same reader as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources import pdf


def glyph_stream(spark: SparkSession, path: str, pattern: str = "*.pdf", files_per_batch: int = 100) -> DataFrame:
    source = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    rows = source.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).load(path)
    return pdf.glyphs(rows)
