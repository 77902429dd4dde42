"""``python -m quire [--mode plain|text|styled|rows|columns] [--page N] [--password P] PATH``: texts of PDF files as lines of JSON."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import layout
from quire.sources import pdf

MODES = {"plain": layout.plain_text, "text": layout.smart_text, "styled": layout.styled_sentences, "rows": layout.rows, "columns": layout.columns}


def extract(spark: SparkSession, path: str, mode: str = "plain", pages: tuple[int, ...] = (), passwords: tuple[str, ...] = ()) -> DataFrame:
    """The rows of a mode for the files of a path; doc_id is a hash of a file's path."""
    runs = pdf.for_layout(pdf.glyphs(pdf.files(spark, path), passwords))
    return MODES[mode](runs.where(F.col("page_num").isin(*pages)) if pages else runs)


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quire")
    parser.add_argument("path")
    parser.add_argument("--mode", choices=sorted(MODES), default="plain")
    parser.add_argument("--page", type=int, action="append", default=[])
    parser.add_argument("--password", action="append", default=[])
    given = parser.parse_args(arguments)
    spark = spark or SparkSession.builder.getOrCreate()
    for row in extract(spark, given.path, given.mode, tuple(given.page), tuple(given.password)).toLocalIterator():
        print(json.dumps(row.asDict(True), ensure_ascii=False))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
