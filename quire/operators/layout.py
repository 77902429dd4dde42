"""Layout operators over positioned text runs (glyphs) and blocks.

glyphs: doc_id, page_num, seq, font, font_size, x, y, w, s, bold. All operators keep to the partitioning by doc_id that
``synthetic`` makes: a page never leaves the task that holds its document, so windows, groups and joins on
(doc_id, page_num, ...) add no shuffle (joins by ``plans.spread.colocated``); only what follows a Python call on whole pages (clusters,
edges, folds) is dealt anew once. Sides of joins grow with the corpus, so they carry a
merge hint and are never broadcast. Every order ends with seq, so results are deterministic.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quire.plans.spread import colocated

PAGE = ["doc_id", "page_num"]
WIDTH, HEIGHT = 612, 792


def synthetic(documents: DataFrame) -> DataFrame:
    """Text set on pages: 90 characters a line, 35 lines a page, a gap after each 5 lines; integers throughout."""
    colocated(documents.sparkSession)
    # a stated number: texts grow manyfold as runs, so partitions must not be merged by the texts' size
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.where("text is not null").select("doc_id", "text").repartition(parts, "doc_id")
    lines = rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    above = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("base", F.coalesce(F.sum(F.expr("length(line) div 90 + 1")).over(above), F.lit(0)))
    words = lines.select("doc_id", "line_no", "base", F.posexplode(F.split("line", " ")).alias("word_no", "s"))
    before = Window.partitionBy("doc_id", "line_no").orderBy("word_no").rowsBetween(Window.unboundedPreceding, -1)
    words = words.withColumn("off", F.coalesce(F.sum(F.length("s") + 1).over(before), F.lit(0))).where("s <> ''")
    words = words.withColumn("phys", F.expr("base + off div 90")).withColumn("k", F.expr("phys % 35"))
    size = F.when(F.expr("phys % 10 = 5"), 18).when(F.col("k") >= 25, 8).otherwise(12)
    return words.select(
        "doc_id", F.expr("phys div 35 + 1").alias("page_num"), F.expr("phys * 1000 + off % 90").alias("seq"), "phys",
        F.when(F.expr("phys % 10 = 5"), "Synth-Bold").otherwise("Synth").alias("font"), size.cast("bigint").alias("font_size"),
        F.expr("50 + 6 * (off % 90)").alias("x"), F.expr("750 - 14 * k - 40 * (k div 5)").alias("y"), (6 * F.length("s")).cast("bigint").alias("w"),
        "s", F.expr("phys % 10 = 5").alias("bold"),
    )


def joined(order: list[Column], text: Column, sep: str = "") -> Column:
    """Aggregate: texts of a group in the given order."""
    keys = [k.alias(f"o{i}") for i, k in enumerate(order)]
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*keys, text.alias("t")))), lambda r: r["t"]), sep)


def rows(glyphs: DataFrame, other: str = "x", by: str = "y") -> DataFrame:
    """Runs with one truncated coordinate: rows (by y, ordered by x) or columns (by x, ordered by y from the top)."""
    order = [F.col("x"), -F.col("y"), F.col("seq")] if by == "y" else [-F.col("y"), F.col("x"), F.col("seq")]
    return glyphs.groupBy(*PAGE, F.col(by).cast("bigint").alias("position")).agg(joined(order, F.col("s"), " ").alias("content"), F.count("*").alias("n"))


def columns(glyphs: DataFrame) -> DataFrame:
    return rows(glyphs, by="x")


def smart_text(glyphs: DataFrame, order: str = "seq") -> DataFrame:
    """Page text of ordered runs: a new line where y moves by more than 3, a space where the gap exceeds 0.3 of the font size."""
    w = Window.partitionBy(*PAGE).orderBy(order)
    gap = F.col("x") - F.lag(F.col("x") + F.col("w")).over(w)
    lead = F.when(F.abs(F.col("y") - F.lag("y").over(w)) > 3, "\n").when(gap > 0.3 * F.col("font_size"), " ").otherwise("")
    parts = glyphs.select(*PAGE, order, F.concat(F.coalesce(lead, F.lit("")), "s").alias("part"))
    return parts.groupBy(*PAGE).agg(joined([F.col(order)], F.col("part")).alias("text"))


def smart_order(glyphs: DataFrame) -> DataFrame:
    """The runs with their cluster and ``place`` on their page: runs are clustered, clusters put in reading order, and their runs in
    lines within each. One pass without joins: a cluster's runs travel with its block."""
    own = [c for c in glyphs.columns if c not in PAGE]
    runs = F.collect_list(F.struct(*own)).alias("runs")
    blocks = _labelled(glyphs).groupBy(*PAGE, F.col("cluster").alias("block_id")).agg(*_bounds(), runs)
    ordered = reading_order(blocks).select(*PAGE, F.col("block_id").alias("cluster"), F.col("place").alias("at"), F.explode("runs").alias("run"))
    lined = anchored(ordered.select(*PAGE, "cluster", "at", "run.*"), [*PAGE, "cluster"], 3.0)
    w = Window.partitionBy(*PAGE).orderBy("at", "line", "x", "seq")
    return lined.withColumn("place", F.row_number().over(w)).drop("at", "line")


def _bounds() -> list[Column]:
    return [F.min("x").alias("min_x"), F.max(F.col("x") + F.col("w")).alias("max_x"), F.min("y").alias("min_y"), F.max(F.col("y") + F.col("font_size")).alias("max_y")]


def smart_reading_text(glyphs: DataFrame) -> DataFrame:
    """Page text in smart order: cluster, order, flatten, build."""
    return smart_text(smart_order(glyphs), "place")


def cluster_text_blocks(glyphs: DataFrame) -> DataFrame:
    """Clusters as blocks with their text, as ``classify`` takes them."""
    ordered = smart_order(glyphs)
    return ordered.groupBy(*PAGE, F.col("cluster").alias("block_id")).agg(
        F.min("x").alias("min_x"), F.max(F.col("x") + F.col("w")).alias("max_x"), F.min("y").alias("min_y"), F.max(F.col("y") + F.col("font_size")).alias("max_y"),
        F.avg("font_size").alias("font"), F.max("bold").alias("bold"), joined([F.col("place")], F.col("s"), " ").alias("text"), F.min(F.struct("place", "s"))["s"].alias("first"),
    )


def page_map(texts: DataFrame) -> DataFrame:
    """doc_id and a map from page number to text."""
    return texts.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_num", "text")))).alias("pages"))


def line_text(glyphs: DataFrame, gap: float = 5.0) -> DataFrame:
    """Text of each baseline, with a space where the gap exceeds ``gap``."""
    w = Window.partitionBy(*PAGE, "y").orderBy("x", "seq")
    space = F.when(F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) > gap, " ").otherwise("")
    parts = glyphs.select(*PAGE, "y", "x", "seq", F.concat(space, "s").alias("part"))
    return parts.groupBy(*PAGE, "y").agg(joined([F.col("x"), F.col("seq")], F.col("part")).alias("text"))


def page_glyphs_text(glyphs: DataFrame) -> DataFrame:
    """All runs of a page in emission order, joined by spaces."""
    return glyphs.groupBy(*PAGE).agg(joined([F.col("seq")], F.col("s"), " ").alias("text"))


def document_text(pages: DataFrame, separator: str, order: tuple[int, ...] = ()) -> DataFrame:
    """Page texts joined by page number, or in the given order of pages, where a page may come more than once."""
    if not order:
        return pages.groupBy("doc_id").agg(joined([F.col("page_num")], F.col("text"), separator).alias("text"), F.count("*").alias("pages"))
    places = F.filter(F.transform(F.array(*map(F.lit, order)), lambda n, i: F.when(n == F.col("page_num"), i)), lambda i: i.isNotNull())
    placed = pages.select("doc_id", "text", F.explode(places).alias("place"))
    return placed.groupBy("doc_id").agg(joined([F.col("place")], F.col("text"), separator).alias("text"), F.count("*").alias("pages"))


def font_stats(glyphs: DataFrame) -> DataFrame:
    return glyphs.groupBy(*PAGE).agg(F.count("*").alias("n"), F.min("font_size").alias("min_font"), F.max("font_size").alias("max_font"), F.round(F.avg("font_size"), 6).alias("avg_font"))


def line_blocks(glyphs: DataFrame) -> DataFrame:
    """One block per physical line: bounds, mean font size, text, bold."""
    return glyphs.groupBy(*PAGE, F.col("phys").alias("block_id")).agg(
        F.min("x").alias("min_x"), F.max(F.col("x") + F.col("w")).alias("max_x"), F.min("y").alias("min_y"), F.max(F.col("y") + F.col("font_size")).alias("max_y"),
        F.avg("font_size").alias("font"), F.max("bold").alias("bold"), joined([F.col("x"), F.col("seq")], F.col("s"), " ").alias("text"), F.min(F.struct("x", "seq", "s"))["s"].alias("first"),
    )


def page_bounds(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(*PAGE).agg(F.min("min_x").alias("min_x"), F.max("max_x").alias("max_x"), F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y"))


def geometry(blocks: DataFrame) -> DataFrame:
    return blocks.select(*PAGE, "block_id", ((F.col("min_x") + F.col("max_x")) / 2).alias("cx"), ((F.col("min_y") + F.col("max_y")) / 2).alias("cy"), (F.col("max_x") - F.col("min_x")).alias("width"), (F.col("max_y") - F.col("min_y")).alias("height"))


def bands(blocks: DataFrame, tolerance: float = 10) -> DataFrame:
    """Horizontal bands: blocks from the top; a block opens a band when it lies more than ``tolerance`` below the lowest so far."""
    w = Window.partitionBy(*PAGE).orderBy(F.desc(F.col("min_y") + F.col("max_y")), "block_id")
    lowest = F.min("min_y").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("max_y") - lowest < -tolerance, 1).otherwise(0)
    return blocks.withColumn("new", new).withColumn("band", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def reading_order(blocks: DataFrame) -> DataFrame:
    top = F.max("max_y").over(Window.partitionBy(*PAGE, "band"))
    banded = bands(blocks).withColumn("top", top)
    return banded.withColumn("place", F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("top"), "min_x", "block_id")))


def sorted_blocks(blocks: DataFrame, by: str) -> DataFrame:
    """Rank of each block within its page by position, size, alphabetical, x or y."""
    orders = {
        "position": [F.desc(F.col("min_y") + F.col("max_y")), F.asc("min_x")],
        "size": [F.desc((F.col("max_x") - F.col("min_x")) * (F.col("max_y") - F.col("min_y")))],
        "alphabetical": [F.asc("first")],
        "x": [F.asc("min_x")],
        "y": [F.asc("min_y")],
    }
    return blocks.select(*PAGE, "block_id", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*orders[by], "block_id")).cast("bigint").alias("place"))


def merge_edges(glyphs: DataFrame, sized: bool = False) -> DataFrame:
    """Pairs of runs (a < b) that belong together: side by side, or stacked; candidates from neighbouring grid cells.

    Vertical overlap above 0.3 of either font and a horizontal gap below t (twice the page's mean font size); or 0.6 of the narrower
    width in common and a vertical gap below 1.5 t. ``sized`` lets the rule depend on the number of runs of the page: from 50 on cells
    are twice as wide and boxes that are far apart are left out first; from 1,000 on runs also belong together by the distance of
    their centers. There is no cap on a run's neighbours. A page is done by one call that joins its grid cells in arrays, so the
    runs are neither copied for their cells nor moved.
    """

    def edges(page: pa.Table) -> pa.Table:
        seq, cells = _boxes(page)
        found = [(np.minimum(seq[a], seq[b]), np.maximum(seq[a], seq[b])) for a, b in _pairs(*cells, sized)]
        a, b = (np.concatenate([f[i] for f in found]) if found else np.empty(0, np.int64) for i in (0, 1))
        a, b = a[a < b], b[a < b]
        return pa.table([*(pa.repeat(page[c][0], len(a)) for c in PAGE), pa.array(a), pa.array(b)], names=[*PAGE, "a", "b"])

    own = glyphs.select(*(F.col(c).cast("bigint") for c in PAGE), F.col("seq").cast("bigint").alias("seq"), "x", "y", "w", "font_size")
    return own.groupBy(*PAGE).applyInArrow(edges, "doc_id bigint, page_num bigint, a bigint, b bigint")


def clusters(glyphs: DataFrame, sized: bool = False) -> DataFrame:
    """Connected components of ``merge_edges`` on each page: doc_id, page_num, seq, cluster (its least seq)."""
    return _labelled(glyphs.select(*PAGE, "seq", "x", "y", "w", "font_size"), sized).select(*PAGE, "seq", "cluster")


#: Pairs of runs that are compared at a time.
PAIRS = 1 << 20


def _labelled(glyphs: DataFrame, sized: bool = False) -> DataFrame:
    """The runs with their ``cluster``. A page is labelled by one call that joins neighbouring grid cells in arrays, so the runs are
    neither copied for their cells nor moved."""

    def label(page: pa.Table) -> pa.Table:
        seq, cells = _boxes(page)
        first = np.arange(len(seq))
        for a, b in _pairs(*cells, sized):
            while len(a):
                a, b = first[a], first[b]
                a, b = a[a != b], b[a != b]
                np.minimum.at(first, np.maximum(a, b), np.minimum(a, b))
                while (first[first] != first).any():
                    first = first[first]
        found = np.empty(len(seq), np.int64)
        found[np.argsort(page["seq"].to_numpy(), kind="stable")] = seq[first]
        return page.append_column("cluster", pa.array(found))

    schema = StructType([*glyphs.schema.fields, StructField("cluster", LongType())])
    return glyphs.groupBy(*PAGE).applyInArrow(label, schema)


def _boxes(page: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """seq, and x, y, w and font_size, by seq."""
    seq = page["seq"].to_numpy()
    order = np.argsort(seq, kind="stable")
    return seq[order], [page[c].cast(pa.float64()).to_numpy()[order] for c in ("x", "y", "w", "font_size")]


def _pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, sized: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of runs that belong together, each pair once; some ``PAIRS`` candidates are compared at a time."""
    n, t = len(x), 2 * np.nanmean(f)
    cell = 2 * t if sized and n >= 50 else t
    cell = cell if cell > 0 else 1
    cx, cy = (np.floor(np.nan_to_num(c / cell)).astype(np.int64) for c in (x + w / 2, y + f / 2))
    wide = int(cy.max() - cy.min()) + 3
    key = (cx - cx.min()) * wide + (cy - cy.min())
    order = np.argsort(key, kind="stable")
    held = key[order]
    for step in (0, 1, wide - 1, wide, wide + 1):
        first, past = np.searchsorted(held, key + step, "left"), np.searchsorted(held, key + step, "right")
        done = np.concatenate([[0], np.cumsum(past - first)])
        at = 0
        while at < n:
            stop = max(at + 1, int(np.searchsorted(done, done[at] + PAIRS, "right")) - 1)
            counts = past[at:stop] - first[at:stop]
            a = np.repeat(np.arange(at, stop), counts)
            b = order[np.repeat(first[at:stop] - (done[at:stop] - done[at]), counts) + np.arange(len(a))]
            at = stop
            if not step:  # within a cell each pair shows up from both sides
                a, b = a[a < b], b[a < b]
            belong = _belong(x, y, w, f, t, n if sized else 0, a, b)
            yield a[belong], b[belong]


def _belong(x: np.ndarray, y: np.ndarray, w: np.ndarray, f: np.ndarray, t: float, n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rules of ``merge_edges`` on arrays; n is 0 for the one rule of all pages."""
    down = np.minimum(y[a] + f[a], y[b] + f[b]) - np.maximum(y[a], y[b])
    along = np.minimum(x[a] + w[a], x[b] + w[b]) - np.maximum(x[a], x[b])
    low, thin = np.minimum(f[a], f[b]), np.minimum(w[a], w[b])
    merge = ((down > 0.3 * low) & (down > 0) & (-along < t)) | ((thin > 0) & (along > 0.6 * thin) & (-down >= 0) & (-down < 1.5 * t))
    if n < 50:
        return merge
    dx, dy = np.abs((x[a] + w[a] / 2) - (x[b] + w[b] / 2)), np.abs((y[a] + f[a] / 2) - (y[b] + f[b] / 2))
    gap_x, gap_y = dx - (w[a] + w[b]) / 2, dy - (f[a] + f[b]) / 2
    reach = 1.1 if n < 1000 else 1.0
    near = (-along <= t) & (-down <= reach * t) & (gap_x <= t) & (gap_y <= 1.5 * t) & ~((gap_x > 0.8 * t) & (gap_y > t))
    if n < 1000:
        return near & merge
    like = (f[a] <= 3 * w[a]) & (f[b] <= 3 * w[b]) & (np.abs(f[a] - f[b]) <= 0.5 * np.maximum(f[a], f[b]))
    close = (dx <= 2 * dy) & like & (np.maximum(gap_x, 0) < t) & (np.maximum(gap_y, 0) < 1.5 * t)
    return near & (merge | close)


def range_join(boxes: DataFrame, glyphs: DataFrame, cell: int = 64) -> DataFrame:
    """Boxes (doc_id, page_num, box_id, min_x, max_x, min_y, max_y) with the runs they touch (closed intervals).

    Both sides are exploded to the grid cells they cover and joined on the cell, so no nested loop is planned; a pair is
    kept in the first cell that both cover, which makes it unique without a distinct.
    """
    def cells(lo: str, hi: str) -> Column:
        return F.sequence(F.floor(F.expr(f"({lo}) / {cell}")), F.floor(F.expr(f"({hi}) / {cell}")))

    a = boxes.withColumn("cx", F.explode(cells("min_x", "max_x"))).withColumn("cy", F.explode(cells("min_y", "max_y")))
    b = glyphs.withColumn("cx", F.explode(cells("x", "x + w"))).withColumn("cy", F.explode(cells("y", "y + font_size")))
    both = a.join(b.hint("merge"), [*PAGE, "cx", "cy"]).where("x <= max_x and x + w >= min_x and y <= max_y and y + font_size >= min_y")
    return both.where(F.expr(f"cx = greatest(floor(min_x / {cell}), floor(x / {cell})) and cy = greatest(floor(min_y / {cell}), floor(y / {cell}))")).drop("cx", "cy")


def classify(blocks: DataFrame, glyphs: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Type of each block by its place, fonts, text and the runs around it (its box grown by three times its font size).

    ``pages`` (doc_id, page_num, height) are the pages' heights (MediaBox); without a row a page is ``HEIGHT`` high. The first rule that fits decides: Unknown, Header, Footer, Caption, List, Footnote, Title, Paragraph.
    """
    grown = blocks.select(*PAGE, F.col("block_id").alias("box_id"), (F.col("min_x") - 3 * F.col("font")).alias("min_x"), (F.col("max_x") + 3 * F.col("font")).alias("max_x"), (F.col("min_y") - 3 * F.col("font")).alias("min_y"), (F.col("max_y") + 3 * F.col("font")).alias("max_y"))
    context = range_join(grown, glyphs.select(*PAGE, "x", "y", "w", "font_size", "s"))
    context = context.groupBy(*PAGE, F.col("box_id").alias("block_id")).agg(
        F.max(F.lower("s").rlike(r"figure|table|fig\.")).alias("near_caption"), F.max(F.col("s").rlike(LIST)).alias("near_list"),
        F.max(F.col("s").rlike(r"\[\d+\]|[⁰¹²³⁴-⁹₀-₉]")).alias("near_note"), F.avg("font_size").alias("near_font"),
    )
    page = glyphs.groupBy(*PAGE).agg(F.avg("font_size").alias("page_font"), F.max("font_size").alias("page_max"))
    out = blocks.join(context.hint("merge"), [*PAGE, "block_id"], "left").join(page.hint("merge"), PAGE)
    if pages is not None:
        out = out.join(pages.select(*PAGE, F.col("height").alias("page_height")).hint("merge"), PAGE, "left")
    height = F.coalesce("page_height", F.lit(HEIGHT)) if pages is not None else F.lit(HEIGHT)
    cy = (F.col("min_y") + F.col("max_y")) / 2
    first_words = F.filter(F.split("first", r"\s+"), lambda x: x != "")
    capital = F.size(F.filter(first_words, lambda x: x.rlike(r"^[A-Z\x{80}-\x{5BF}\x{600}-\x{7BF}]"))) > 0.6 * F.size(first_words)
    title = ((F.col("font") > 1.2 * F.col("page_font")) | F.col("bold")) & (F.octet_length("first") <= 100) & (F.size(first_words) >= 1) & (capital | F.col("bold"))
    kind = (
        F.when(F.trim("text") == "", "Unknown")
        .when(cy > 0.9 * height, "Header")
        .when(cy < 0.1 * height, "Footer")
        .when(F.col("text").rlike(r"^(Figure|Table|Fig\.|Tab\.)\s+\d+") | F.coalesce("near_caption", F.lit(False)), "Caption")
        .when(F.col("text").rlike(LIST) | F.coalesce("near_list", F.lit(False)), "List")
        .when(((F.col("font") < 0.8 * F.col("page_font")) & (cy < 0.3 * height)) | F.coalesce("near_note", F.lit(False)), "Footnote")
        .when(title | (F.col("font") > 1.2 * F.col("near_font")), "Title")
        .otherwise("Paragraph")
    )
    ratio = (F.col("font") - F.col("page_font")) / (F.col("page_max") - F.col("page_font"))
    level = F.when(F.col("page_max") == F.col("page_font"), 1).when(ratio > 0.8, 1).when(ratio > 0.6, 2).when(ratio > 0.4, 3).when(ratio > 0.2, 4).otherwise(5)
    return out.select(*PAGE, "block_id", kind.alias("type"), F.when(kind == "Title", level).otherwise(0).cast("bigint").alias("level"), "text")


LIST = r"^(\d+\.|[•\-\*]|\([a-z]\)|\([0-9]+\))\s"


def context(blocks: DataFrame, glyphs: DataFrame, reach: float = 3) -> DataFrame:
    """For each block the number of runs in its box grown by ``reach`` times its font size (its own runs included)."""
    grown = blocks.select(*PAGE, F.col("block_id").alias("box_id"), *[(F.col(c) + sign * reach * F.col("font")).alias(c) for c, sign in (("min_x", -1), ("max_x", 1), ("min_y", -1), ("max_y", 1))])
    return range_join(grown, glyphs.select(*PAGE, "x", "y", "w", "font_size")).groupBy(*PAGE, F.col("box_id").alias("block_id")).agg(F.count("*").alias("n"))


def within(blocks: DataFrame, radius: float) -> DataFrame:
    """Pairs of blocks of a page whose centers are at most ``radius`` apart: an equi-join on cells of that size."""
    c = geometry(blocks).select(*PAGE, "block_id", "cx", "cy", F.floor(F.col("cx") / radius).alias("gx"), F.floor(F.col("cy") / radius).alias("gy"))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    a = c.withColumn("d", F.explode(steps)).select(*PAGE, F.col("block_id").alias("a"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), (F.col("gx") + F.col("d.i")).alias("gx"), (F.col("gy") + F.col("d.j")).alias("gy"))
    both = a.join(c.withColumnRenamed("block_id", "b").hint("merge"), [*PAGE, "gx", "gy"])
    return both.where((F.col("a") != F.col("b")) & (F.pow(F.col("ax") - F.col("cx"), 2) + F.pow(F.col("ay") - F.col("cy"), 2) <= radius * radius)).select(*PAGE, "a", "b")


def memory_cost(glyphs: DataFrame) -> DataFrame:
    """Bytes that a page's runs are taken to need: 128 each and their text."""
    return glyphs.groupBy(*PAGE).agg(F.sum(F.octet_length("s") + 128).cast("bigint").alias("cost"))


def plain_text(glyphs: DataFrame, tolerance: float = 2.0, trim: str = "blank") -> DataFrame:
    """Page text: from the top, a new line where a run is farther than ``tolerance`` from the mean of the line so far.

    Where a column ``vertical`` is true, x stands for y and the way down for x; lines of vertical runs alone get no spaces. ``trim``:
    blanks at both ends go (blank), or only line ends at the end (newline).

    The running mean is a fold over a page's runs, so each page is folded by one call; a page is bounded by its paper.
    """
    import pandas as pd

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values(["y", "x", "seq"], ascending=[False, True, True])
        lines: list[list] = []
        mean = 0.0
        for r in page.itertuples(index=False):
            at = r.x if r.vertical else r.y
            if not lines or abs(at - mean) > tolerance:
                lines.append([])
                mean = 0.0
            lines[-1].append(r)
            mean += (at - mean) / len(lines[-1])
        texts = []
        for line in lines:
            out, edge = "", None
            upright = all(r.vertical for r in line)
            for r in sorted(line, key=lambda r: (-r.y if r.vertical else r.x, r.seq)):
                out += (" " if edge is not None and not upright and r.x - edge > max(0.2 * r.font_size, 0.5) else "") + r.s
                edge = r.x + r.w
            texts.append(out)
        text = "\n".join(texts)
        text = text.rstrip("\n") if trim == "newline" else text.strip(" \t\r\n")
        return pd.DataFrame({"doc_id": page["doc_id"].iloc[:1], "page_num": page["page_num"].iloc[:1], "text": [text]})

    if trim not in ("blank", "newline"):
        raise ValueError(f"unknown trim {trim!r}")
    vertical = F.coalesce(F.col("vertical"), F.lit(False)) if "vertical" in glyphs.columns else F.lit(False)
    runs = glyphs.select(*PAGE, "seq", "x", "y", "w", "font_size", "s", vertical.alias("vertical"))
    return runs.groupBy(*PAGE).applyInPandas(fold, "doc_id bigint, page_num bigint, text string")


def styled_sentences(glyphs: DataFrame) -> DataFrame:
    """Consecutive runs of one font, a size within 0.1 and a baseline within 5 of the run that began the sentence."""
    import pandas as pd

    def fold(page: pd.DataFrame) -> pd.DataFrame:
        out: list[list] = []
        for r in page.sort_values("seq").itertuples(index=False):
            if out and (h := out[-1])[3] == r.font and abs(h[4] - r.font_size) <= 0.1 and abs(h[5] - r.y) <= 5 and h[6]:
                h[6] += r.s
            else:
                out.append([r.doc_id, r.page_num, r.seq, r.font, r.font_size, r.y, r.s])
        return pd.DataFrame(out, columns=["doc_id", "page_num", "seq", "font", "font_size", "y", "s"])

    schema = "doc_id bigint, page_num bigint, seq bigint, font string, font_size double, y double, s string"
    return glyphs.select(*PAGE, "seq", "font", F.col("font_size").cast("double"), F.col("y").cast("double"), "s").groupBy(*PAGE).applyInPandas(fold, schema)


def cluster_blocks(glyphs: DataFrame, clusters: DataFrame) -> DataFrame:
    """Bounds, mean font size and number of runs of each cluster."""
    runs = glyphs.join(clusters.hint("merge"), [*PAGE, "seq"])
    return runs.groupBy(*PAGE, F.col("cluster").alias("block_id")).agg(
        F.min("x").alias("min_x"), F.max(F.col("x") + F.col("w")).alias("max_x"), F.min("y").alias("min_y"), F.max(F.col("y") + F.col("font_size")).alias("max_y"), F.avg("font_size").alias("font"), F.count("*").alias("n")
    )


def capped_blocks(blocks: DataFrame, most: int) -> DataFrame:
    """Blocks of each page merged, always the two whose centers are closest (ties: the first pair by id), until ``most`` are left.

    Blocks are as from ``cluster_blocks``; a merged one has the lesser id and the mean font size of its runs.
    """
    import pandas as pd

    names = ["block_id", "min_x", "max_x", "min_y", "max_y", "font", "n"]

    def merge(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("block_id")
        cells = page[names].to_numpy(np.float64)
        while len(cells) > max(most, 1):
            x, y = cells[:, 1] + cells[:, 2], cells[:, 3] + cells[:, 4]
            far = np.subtract.outer(x, x) ** 2 + np.subtract.outer(y, y) ** 2
            far[np.tril_indices(len(cells))] = np.inf
            i, j = divmod(int(far.argmin()), len(cells))
            a, b = cells[i], cells[j]
            cells[i] = [a[0], min(a[1], b[1]), max(a[2], b[2]), min(a[3], b[3]), max(a[4], b[4]), (a[5] * a[6] + b[5] * b[6]) / (a[6] + b[6]), a[6] + b[6]]
            cells = np.delete(cells, j, axis=0)
        out = pd.DataFrame(cells, columns=names).astype({"block_id": "int64", "n": "int64"})
        return out.assign(doc_id=page["doc_id"].iloc[0], page_num=page["page_num"].iloc[0])[[*PAGE, *names]]

    schema = "doc_id bigint, page_num bigint, block_id bigint, min_x double, max_x double, min_y double, max_y double, font double, n bigint"
    return blocks.groupBy(*PAGE).applyInPandas(merge, schema)


def band_columns(blocks: DataFrame) -> DataFrame:
    """Columns within each band (doc_id, page_num, block_id, band, column): from left to right, a gap of more than 5 % of the
    page's width to the last block opens a column; a block that shares a fifth of the lower height with the last block joins it;
    another joins the first closed column whose mean edges are as close as that gap, else the open one."""
    import pandas as pd

    w = Window.partitionBy(*PAGE)
    wide = F.max("max_x").over(w) - F.min("min_x").over(w)
    banded = bands(blocks.withColumn("reach", wide * 0.05))

    def place(page: pd.DataFrame) -> pd.DataFrame:
        rows = page.sort_values(["band", "min_x", "block_id"]).itertuples(index=False)
        out = [(r.doc_id, r.page_num, r.block_id, r.band, i) for _, band in groupby(rows, lambda r: r.band) for i, c in enumerate(split(list(band)), 1) for r in c]
        return pd.DataFrame(out, columns=["doc_id", "page_num", "block_id", "band", "column"])

    def split(rows: list) -> list[list]:
        columns: list[list] = [[rows[0]]]
        for r in rows[1:]:
            last = columns[-1][-1]
            shared, low = min(last.max_y, r.max_y) - max(last.min_y, r.min_y), min(last.max_y - last.min_y, r.max_y - r.min_y)
            if r.min_x - last.max_x > r.reach:
                columns.append([r])
                continue
            fits = columns[-1]
            if not (shared > 0 and low > 0 and shared >= 0.2 * low):
                for c in columns[:-1]:
                    if abs(r.min_x - sum(b.min_x for b in c) / len(c)) < r.reach and abs(r.max_x - sum(b.max_x for b in c) / len(c)) < r.reach:
                        fits = c
                        break
            fits.append(r)
        return columns

    columns = ["block_id", "band", "reach", "min_x", "max_x", "min_y", "max_y"]
    return banded.select(*PAGE, *columns).groupBy(*PAGE).applyInPandas(place, "doc_id bigint, page_num bigint, block_id bigint, band bigint, column bigint")


def anchored(glyphs: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """The runs with the number of their line: from the top, a line begins where y is more than ``tolerance`` below the first run
    of the line before. Lines are found by a fold over the distinct y of a group, in the JVM."""
    others = [c for c in glyphs.columns if c not in keys]
    grouped = glyphs.groupBy(*keys).agg(F.collect_list(F.struct(*others)).alias("runs"), F.sort_array(F.collect_set(F.col("y").cast("double")), asc=False).alias("ys"))
    tops = F.aggregate("ys", F.array().cast("array<double>"), lambda tops, y: F.when(F.coalesce(F.try_element_at(tops, F.lit(-1)) - y <= tolerance, F.lit(False)), tops).otherwise(F.concat(tops, F.array(y))))
    # a generator of one row, so that the fold is done once for a group and not for each run
    runs = grouped.select(*keys, "runs", F.explode(F.array(tops)).alias("tops")).select(*keys, "tops", F.explode("runs").alias("run"))
    line = F.size(F.filter("tops", lambda top: top >= F.col("run.y"))).cast("bigint")
    return runs.select(*keys, "run.*", line.alias("line"))


def streamed_text(glyphs: DataFrame, tolerance: float = 2.0, gap: float = 5.0) -> DataFrame:
    """Page text by anchored lines, each from left to right with a space where the gap exceeds ``gap``."""
    lined = anchored(glyphs.select(*PAGE, "x", "y", "w", "seq", "s"), PAGE, tolerance)
    w = Window.partitionBy(*PAGE, "line").orderBy("x", "seq")
    space = F.when(F.col("x") - F.lag(F.col("x") + F.col("w")).over(w) > gap, " ").otherwise("")
    lines = lined.withColumn("part", F.concat(space, "s")).groupBy(*PAGE, "line").agg(joined([F.col("x"), F.col("seq")], F.col("part")).alias("text"))
    return lines.groupBy(*PAGE).agg(joined([F.col("line")], F.col("text"), "\n").alias("text"))


def within_blocks(glyphs: DataFrame, block: str = "phys", tolerance: float = 3.0) -> DataFrame:
    """Place of each run in its block: anchored lines from the top, each from left to right."""
    lined = anchored(glyphs.select(*PAGE, block, "x", "y", "seq"), [*PAGE, block], tolerance)
    return lined.select(*PAGE, F.col(block).alias("block_id"), "seq", F.row_number().over(Window.partitionBy(*PAGE, block).orderBy("line", "x", "seq")).cast("bigint").alias("place"))


def asymmetric(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """Whether two centers lie rather side by side than above each other."""
    return F.abs(a[0] - b[0]) > 2 * F.abs(a[1] - b[1])


def parted(a: tuple[Column, Column], b: tuple[Column, Column], sides: Column) -> Column:
    """Whether two centers are so far apart that an image may lie between; ``sides`` is the sum of both boxes' sides."""
    return (F.abs(a[0] - b[0]) > sides / 2) | (F.abs(a[1] - b[1]) > sides / 2)


def neighbours(blocks: DataFrame) -> DataFrame:
    """Each block but the first of a page with the one before it by position, and how the two lie."""
    w = Window.partitionBy(*PAGE).orderBy(F.desc("cy"), "block_id")
    g = geometry(blocks)
    g = g.select(*g.columns, *[F.lag(c).over(w).alias(f"p_{c}") for c in ("block_id", "cx", "cy", "width", "height")]).where("p_block_id is not null")
    here, before = (F.col("cx"), F.col("cy")), (F.col("p_cx"), F.col("p_cy"))
    return g.select(*PAGE, "block_id", F.col("p_block_id").alias("before"), asymmetric(here, before).alias("asymmetric"), parted(here, before, F.expr("width + height + p_width + p_height")).alias("parted"))
