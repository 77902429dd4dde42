"""Scalar helpers, folds and the builder on small fixtures."""

import pytest
from pyspark.sql import functions as F

from quire.api import Extractor
from quire.functions import documents, strings
from quire.operators import layout

GLYPHS = "doc_id bigint, page_num bigint, seq bigint, phys bigint, font string, font_size double, x double, y double, w double, s string, bold boolean"


def run(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize(("raw", "want"), [(b"\xfe\xff\x00H\x00i", "Hi"), (b"\xfe\xff\x4e\x2d", "中"), (b"\xef\xbb\xbf\xc3\xa9", "é"), (b"\xe9", "é"), (b"", "")])
def test_metadata_strings(spark, raw, want):
    assert run(spark, strings.utf16_text(F.lit(bytearray(raw)))) == want


@pytest.mark.parametrize(("raw", "want"), [("<48 65 6c6c6F>", b"Hello"), ("4", b"@"), ("", b"")])
def test_hex(spark, raw, want):
    assert bytes(run(spark, strings.hex_decode(F.lit(raw)))) == want


def test_keywords_and_split(spark):
    assert run(spark, documents.keywords(F.lit(" a, b;;c ,"))) == ["a", "b", "c"]
    assert run(spark, strings.split_any(F.lit("a]b--c^"), "]-^")) == ["a", "b", "c"]


def test_hilbert_visits_each_cell_once_in_steps_of_one(spark):
    cells = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    rows = sorted((r.d, r.x, r.y) for r in cells.select("x", "y", strings.hilbert(F.col("x"), F.col("y"), 4).alias("d")).collect())
    assert [r[0] for r in rows] == list(range(256))
    assert all(abs(a[1] - b[1]) + abs(a[2] - b[2]) == 1 for a, b in zip(rows, rows[1:], strict=False))


def line(spark, *rows):
    return spark.createDataFrame([(1, p, i, int(800 - y), "Arial", 12.0, float(x), float(y), float(w), s, False) for i, (p, x, y, w, s) in enumerate(rows)], GLYPHS)


def test_lines_follow_the_running_mean(spark):
    g = line(spark, (1, 10, 100, 20, "a"), (1, 40, 98.5, 20, "b"), (1, 70, 97.6, 20, "c"), (1, 10, 96.6, 20, "d"), (2, 0, 5, 1, "e"))
    assert [r.text for r in layout.plain_text(g).orderBy("page_num").collect()] == ["a b c\nd", "e"]


def test_line_building(spark):
    near, far = line(spark, (1, 100, 300, 30, "hello"), (1, 130, 300, 30, "world")), line(spark, (1, 100, 300, 30, "hello"), (1, 200, 300, 30, "world"))
    assert layout.line_text(near).first().text == "helloworld" and layout.line_text(far).first().text == "hello world"


def test_sentences_compare_with_their_first_run(spark):
    g = line(spark, (1, 0, 100, 5, "a"), (1, 5, 104, 5, "b"), (1, 9, 108, 5, "c"))
    assert [r.s for r in layout.styled_sentences(g).orderBy("seq").collect()] == ["ab", "c"]


def test_extractor(spark, tmp_path):
    g = line(spark, (1, 0, 700, 10, "one"), (1, 20, 700, 10, "two"), (2, 0, 500, 10, "three"))
    texts = lambda e: [r.text for r in e.extract().orderBy("page_num").collect()]
    assert texts(Extractor(g)) == texts(Extractor(g).smart_ordering()) == ["one two", "three"]
    assert texts(Extractor(g).pages(2)) == ["three"]
    assert Extractor(g).mode("document").separator("|").extract().first().text == "one two|three"
    assert Extractor(g).mode("document").pages(2, 1, 2, 9).separator("|").extract().first().text == "three|one two|three"
    assert Extractor(g).mode("structured").extract().count() == 2
    assert Extractor(g).mode("structured").smart_ordering().extract().count() == 2
    assert Extractor(g).mode("map").extract().first().pages == {1: "one two", 2: "three"}
    heights = spark.createDataFrame([(1, 1, 100.0)], "doc_id bigint, page_num bigint, height double")
    assert {r.page_num: r.type for r in Extractor(g).mode("structured").page_heights(heights).extract().collect()}[1] == "Header"
    upper = lambda frames: (f.assign(text=f["text"].str.upper()) for f in frames)
    assert [r.text for r in Extractor(g).pages(2).apply(upper, "doc_id bigint, page_num bigint, text string").extract().collect()] == ["THREE"]
    Extractor(g).save(str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == ["one two", "three"]
    assert Extractor(g).mode("styled").extract().count() == 2
    with pytest.raises(ValueError, match="unknown mode"):
        Extractor(g).mode("other")
