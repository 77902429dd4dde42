"""Every query with SQL gives the rows that DuckDB gives; small fixtures for the functions."""

import math
import os
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

from quire.functions import documents, language
from quire.operators import layout
from quire.queries import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@cache
def tables():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    got = QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = tables().sql(ORACLE[name])
    at = [want.columns.index(c) for c in names]
    assert sorted(want.columns) == names
    rows = sorted((tuple(plain(r[c]) for c in names) for r in got.collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


@pytest.mark.parametrize(("text", "words", "sentences"), [("Hello world", 2, 1), ("Hello, world!", 2, 1), ("Hello    world", 2, 1), ("", 0, 0), ("Hello 123 world", 3, 1), ("First sentence. Second sentence.", 2 * 2, 2), ("First sentence! Second sentence? Third sentence.", 6, 3)])
def test_counts(spark, text, words, sentences):
    row = spark.range(1).select(language.word_count(F.lit(text)).alias("w"), language.sentence_count(F.lit(text)).alias("s")).first()
    assert (row.w, row.s) == (words, sentences)


def test_language_of_text_without_common_words(spark):
    rows = spark.createDataFrame([("xyz qrs",), ("the cat and the dog",)], "text string").select(language.scores(F.col("text")).alias("s"))
    name, confidence = language.detected(F.col("s"))
    assert [tuple(r) for r in rows.select(name, confidence).collect()] == [("en", 0.0), ("en", 1.0)]


@pytest.mark.parametrize(("data", "valid", "issues"), [("%PDF-1.4 " + "x" * 50 + " xref trailer startxref %%EOF", True, 0), ("no header at all in this text", False, 1), ("tiny", False, 1), ("%PDF-1.4 " + "x" * 50, False, 4)])
def test_integrity(spark, data, valid, issues):
    parts = documents.integrity(F.lit(data))
    row = spark.range(1).select(parts["valid"].alias("v"), F.size(F.filter(F.split(parts["issues"], "; "), lambda x: x != "")).alias("n")).first()
    assert (row.v, row.n) == (valid, issues)


def test_clusters_are_the_components_of_the_edges(spark):
    g = layout.synthetic(spark.read.parquet(f"{SF}/documents.parquet")).where("doc_id < 30")
    parent = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for r in layout.merge_edges(g).collect():
        a, b = root((r.doc_id, r.page_num, r.a)), root((r.doc_id, r.page_num, r.b))
        parent[max(a, b)] = min(a, b)
    for r in layout.clusters(g).collect():
        assert root((r.doc_id, r.page_num, r.seq)) == (r.doc_id, r.page_num, r.cluster)


def test_range_join_finds_each_pair_once(spark):
    glyph = spark.createDataFrame([(1, 1, 0, 100, 300, 50, 12, "top-left"), (1, 1, 1, 200, 300, 50, 12, "b"), (1, 1, 2, 100, 100, 500, 12, "wide")], "doc_id bigint, page_num bigint, seq bigint, x bigint, y bigint, w bigint, font_size bigint, s string")
    boxes = spark.createDataFrame([(1, 1, 1, 90, 160, 290, 310), (1, 1, 2, 50, 60, 50, 60), (1, 1, 3, 0, 600, 0, 800)], "doc_id bigint, page_num bigint, box_id bigint, min_x bigint, max_x bigint, min_y bigint, max_y bigint")
    got = sorted((r.box_id, r.s) for r in layout.range_join(boxes, glyph).collect())
    assert got == [(1, "top-left"), (3, "b"), (3, "top-left"), (3, "wide")]
