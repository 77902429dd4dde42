"""Layout operators on small fixtures, and whole pages by brute force."""

import random

import numpy as np
import pytest

from quire.operators import layout

GLYPH = "doc_id bigint, page_num bigint, seq bigint, x double, y double, w double, font_size double, s string"
BLOCK = "doc_id bigint, page_num bigint, block_id bigint, min_x double, max_x double, min_y double, max_y double, font double, n bigint"


def test_lines_are_anchored_at_their_first_run(spark):
    ys = [100, 98.5, 97.9, 96.5, 96]
    rows = [(1, 1, i, 10.0 * (9 - i), float(y), 4.0, 10.0, str(i)) for i, y in enumerate(ys)]
    got = {r.seq: r.line for r in layout.anchored(spark.createDataFrame(rows, GLYPH), layout.PAGE, 2.0).collect()}
    assert got == {0: 1, 1: 1, 2: 2, 3: 2, 4: 2}
    assert layout.streamed_text(spark.createDataFrame(rows, GLYPH)).first().text == "1 0\n4 3 2"
    assert layout.anchored(spark.createDataFrame([], GLYPH), layout.PAGE, 2.0).count() == 0


def test_vertical_runs_and_trimming_of_plain_text(spark):
    # two columns written downwards, then a line with one vertical run in it
    down = [(1, 1, i, x, 100.0 - 30 * j, 10.0, 10.0, s, True) for i, (x, j, s) in enumerate([(50.0, 0, "a"), (50.5, 1, "b"), (50.0, 2, "c")])]
    across = [(1, 2, 0, 10.0, 20.0, 5.0, 10.0, "x", None), (1, 2, 1, 30.0, 20.0, 5.0, 10.0, "y", False), (1, 2, 2, 30.0, 5.0, 5.0, 10.0, " ", False), (1, 2, 3, 30.0, 1.0, 5.0, 10.0, "\n", False)]
    table = spark.createDataFrame(down + across, GLYPH + ", vertical boolean")
    texts = lambda **more: {r.page_num: r.text for r in layout.plain_text(table, **more).collect()}
    assert texts() == {1: "abc", 2: "x y"}
    assert texts(trim="newline") == {1: "abc", 2: "x y\n "}
    # without the column all runs are horizontal
    assert {r.page_num: r.text for r in layout.plain_text(table.drop("vertical")).collect()}[1] == "a\nb\nc"
    assert layout.plain_text(table.limit(0)).count() == 0


def test_order_within_blocks(spark):
    rows = [(1, 1, 0, 50.0, 99.0, 4.0, 10.0, "c"), (1, 1, 1, 10.0, 100.0, 4.0, 10.0, "a"), (1, 1, 2, 30.0, 97.5, 4.0, 10.0, "b"), (1, 1, 3, 5.0, 96.0, 4.0, 10.0, "d")]
    table = spark.createDataFrame(rows, GLYPH).selectExpr("*", "7L as phys")
    assert [r.seq for r in layout.within_blocks(table).orderBy("place").collect()] == [1, 2, 0, 3]


def test_band_columns(spark):
    # a narrow gap keeps the column, a wide one opens the next
    boxes = [(0, 0, 100, 80, 100), (1, 10, 100, 79, 99), (2, 120, 200, 80, 100), (3, 300, 400, 80, 100), (4, 125, 205, 50, 74)]
    rows = [(1, 1, i, float(a), float(b), float(c), float(d), 10.0, 1) for i, a, b, c, d in boxes]
    got = {r.block_id: (r.band, r.column) for r in layout.band_columns(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got[0] == got[1] == (0, 1) and got[2][1] == 1 and got[3] == (0, 2)
    assert got[4][0] == 0


def test_capped_blocks(spark):
    boxes = [(0, 0, 10), (1, 11, 21), (2, 100, 110), (3, 200, 210)]
    rows = [(1, 1, i, float(a), float(b), 0.0, 10.0, 10.0 + i, i + 1) for i, a, b in boxes] + [(2, 1, 5, 0.0, 1.0, 0.0, 1.0, 9.0, 1)]
    got = {(r.doc_id, r.block_id): r for r in layout.capped_blocks(spark.createDataFrame(rows, BLOCK), 2).collect()}
    assert sorted(got) == [(1, 0), (1, 3), (2, 5)]
    first = got[1, 0]
    assert (first.min_x, first.max_x, first.n) == (0, 110, 6) and abs(first.font - (10 * 1 + 11 * 2 + 12 * 3) / 6) < 1e-9


def brute(page, n):
    t = 2 * sum(g[6] for g in page) / len(page)
    cell = 2 * t if n >= 50 else t
    out = set()
    for i, g in enumerate(page):
        for h in page[i + 1 :]:
            (ax, ay, aw, af), (bx, by, bw, bf) = g[3:7], h[3:7]
            if any(abs((p + q / 2) // cell - (r + v / 2) // cell) > 1 for p, q, r, v in ((ax, aw, bx, bw), (ay, af, by, bf))):
                continue
            across, down = min(ax + aw, bx + bw) - max(ax, bx), min(ay + af, by + bf) - max(ay, by)
            one = down > 0 and down > 0.3 * min(af, bf) and -across < t
            two = min(aw, bw) > 0 and across > 0.6 * min(aw, bw) and 0 <= -down < 1.5 * t
            dx, dy = abs(ax + aw / 2 - bx - bw / 2), abs(ay + af / 2 - by - bf / 2)
            hg, vg = dx - (aw + bw) / 2, dy - (af + bf) / 2
            coarse = -across <= t and -down <= (1.1 if n < 1000 else 1.0) * t and hg <= t and vg <= 1.5 * t and not (hg > 0.8 * t and vg > t)
            three = dx <= 2 * dy and af <= 3 * aw and bf <= 3 * bw and abs(af - bf) <= 0.5 * max(af, bf) and max(hg, 0) < t and max(vg, 0) < 1.5 * t
            if (one or two) if n < 50 else coarse and (one or two or (n >= 1000 and three)):
                out.add((g[2], h[2]))
    return out


def test_edges_by_the_size_of_the_page(spark):
    rng = random.Random(5)
    for doc, n in enumerate((40, 300, 1100)):
        wide = 20 * n**0.5
        page = [(doc, 1, i, float(rng.randrange(int(wide))), float(rng.randrange(int(wide))), float(rng.randrange(0, 30)), float(rng.choice((8, 12, 30))), "x") for i in range(n)]
        got = {(r.a, r.b) for r in layout.merge_edges(spark.createDataFrame(page, GLYPH), sized=True).collect()}
        assert got == brute(page, n) and got


def test_smart_order_goes_through_columns(spark):
    # two columns of two lines each, emitted line by line across both; the left column is read first
    rows, at = [], 0
    for line in range(2):
        for column, x in (("L", 50.0), ("R", 400.0)):
            rows.append((1, 1, at, x, 700.0 - 14 * line, 60.0, 12.0, f"{column}{line}"))
            at += 1
    rows.append((1, 2, 0, 50.0, 700.0, 60.0, 12.0, "alone"))
    table = spark.createDataFrame(rows, GLYPH).selectExpr("*", "'F' as font", "false as bold")
    got = {r.page_num: r.text for r in layout.smart_reading_text(table).collect()}
    assert got == {1: "L0\nL1\nR0\nR1", 2: "alone"}
    blocks = {(r.page_num, r.block_id): r.text for r in layout.classify(layout.cluster_text_blocks(table), table).collect()}
    assert blocks == {(1, 0): "L0 L1", (1, 1): "R0 R1", (2, 0): "alone"}
    assert layout.smart_reading_text(table.limit(0)).count() == 0


@pytest.mark.parametrize("sized", [False, True])
def test_clusters_of_scattered_pages(spark, sized, monkeypatch):
    """Pages of all sizes of the rule, with runs of width 0 and of equal places, against the components of the edges."""
    monkeypatch.setattr(layout, "PAIRS", 500)
    rng = np.random.default_rng(3)
    rows = []
    for page, n in enumerate((1, 30, 300, 1500), 1):
        side = 40 * n**0.5
        for seq in rng.permutation(n):
            x, y = (float(v) for v in rng.uniform(-side / 2, side / 2, 2).round(1))
            rows.append((1, page, int(seq) * 3, x, y, float(rng.choice([0, 5, 20, 33.3])), float(rng.choice([6, 10, 12, 24]))))
    rows.append((1, 2, 500, *rows[5][3:]))
    glyphs = spark.createDataFrame(rows, "doc_id bigint, page_num bigint, seq bigint, x double, y double, w double, font_size double")
    parent = {r[1:3]: r[1:3] for r in rows}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for r in layout.merge_edges(glyphs, sized).collect():
        a, b = root((r.page_num, r.a)), root((r.page_num, r.b))
        parent[max(a, b)] = min(a, b)
    got = {(r.page_num, r.seq): r.cluster for r in layout.clusters(glyphs, sized).collect()}
    assert got == {v: root(v)[1] for v in parent}
    assert len(set(got.values())) > 20
