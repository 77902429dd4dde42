"""PDF files as DataFrames: glyphs, page texts, metadata and errors, in batch and as a stream.

Input is any DataFrame with ``path`` and ``content`` (as from the binaryFile source); a document is read in one task and its
failure is a row with an error, which doesn't stop the job.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators.layout import anchored, joined
from quire.sources.pdfkernel import Document, Ref, Run, page_runs, page_strings, shown

GLYPHS = "path string, page_num bigint, seq bigint, font string, font_size double, x double, y double, w double, s string, vertical boolean, error string"
METADATA = "path string, version string, pages bigint, info map<string,string>, recovered boolean, error string"
#: Glyph rows, and characters of page texts, in a batch that a task hands over.
BATCH, CHARACTERS = 50_000, 4_000_000


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def glyphs(documents: DataFrame, passwords: tuple[str, ...] = (), metrics: bool = False) -> DataFrame:
    """A row per character; for a page or document that can't be read a row with the error and no character.

    ``passwords`` are tried on encrypted documents, after the empty one. With ``metrics`` characters without an entry in Widths take
    the width that a composite font's tables or an embedded Type 1 program give; else their width is 0. ``vertical`` marks
    characters of fonts in vertical writing.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for rows in _each(batches, passwords, metrics, _rows_of):
            held.append(rows)
            n += rows.num_rows
            if n >= BATCH:
                yield from pa.Table.from_batches(held).combine_chunks().to_batches(BATCH)
                held, n = [], 0
        yield from pa.Table.from_batches(held, _SCHEMA).combine_chunks().to_batches(BATCH)

    return documents.select("path", "content").mapInArrow(work, GLYPHS)


def _each(batches: Iterator[pa.RecordBatch], passwords: tuple[str, ...], metrics: bool, of: Callable) -> Iterator:
    """``of(path, page, runs, error)`` of every page; for a page or document that can't be read, or whose runs make ``of`` fail, that
    of the error."""
    for batch in batches:
        for path, content in zip(*batch.columns[:2], strict=True):
            path, content = path.as_py(), content.as_py() or b""
            try:
                doc = Document.open(content, passwords)
                pages = doc.pages()
            except Exception as e:  # whatever a damaged file leads to is that file's error
                yield of(path, None, None, _said(e))
                continue
            for number, page in enumerate(pages, 1):
                try:
                    out = of(path, number, page_runs(doc, page, metrics=metrics), None)
                except Exception as e:
                    out = of(path, number, None, _said(e))
                yield out


_SCHEMA = pa.schema(list(zip((f.split()[0] for f in GLYPHS.split(", ")), [pa.string(), pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * 4, pa.string(), pa.bool_(), pa.string()], strict=True)))


def _rows_of(path: str, page: int | None, runs: list[Run] | None, error: str | None) -> pa.RecordBatch:
    """Rows of the glyph table."""
    if runs is None:
        return pa.record_batch([pa.array([v], f.type) for v, f in zip([path, page, *[None] * 8, error], _SCHEMA, strict=True)], schema=_SCHEMA)
    sizes = [len(r.x) for r in runs]
    if not (n := sum(sizes)):
        return pa.record_batch([pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)
    places = [np.concatenate([_floats(v, k) for v, k in zip(column, sizes, strict=True)]) for column in zip(*((r.x, r.y, r.w) for r in runs), strict=True)]
    per_run = [pa.array([of(r) for r in runs], kind) for of, kind in ((lambda r: r.font, pa.string()), (lambda r: float(r.size), pa.float64()), (lambda r: r.vertical, pa.bool_()))]
    font, size, vertical = (c.take(pa.array(np.repeat(np.arange(len(runs)), sizes))) for c in per_run)
    texts = pa.array([s for r in runs for s in r.s], pa.string())
    return pa.record_batch([pa.repeat(pa.scalar(path, pa.string()), n), pa.repeat(page, n), pa.array(np.arange(n)), font, size, *map(pa.array, places), texts, vertical, pa.nulls(n, pa.string())], schema=_SCHEMA)


def _floats(v, n: int) -> np.ndarray:
    return np.asarray(v, float) if isinstance(v, (np.ndarray, list)) else np.full(n, float(v))


def page_texts(documents: DataFrame, passwords: tuple[str, ...] = (), tolerance: float = 2.0) -> DataFrame:
    """The rows of ``page_text(glyphs(documents, passwords), tolerance)``, made by the task that reads a page, so that no character
    is a row and nothing is dealt anew; and a row with the error and no text for a page or document that can't be read."""
    return _by_page(documents, passwords, {"text": "string"}, lambda runs: (t,) if (t := _lined(runs, tolerance)) is not None else None)


def page_extents(documents: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    """How many rows of ``glyphs`` a page has, and the ends of their x, x + w and y; pages without characters have no row, and errors are
    rows as in ``page_texts``."""
    return _by_page(documents, passwords, {"n": "bigint", "left_edge": "double", "right_edge": "double", "bottom": "double", "top": "double"}, _extent)


def _extent(runs: list[Run]) -> tuple | None:
    if not runs:
        return None
    ends = []
    for r in runs:
        x, w, y = (_floats(v, 1) for v in (r.x, r.w, r.y))
        ends.append((x.min(), (x + w).max(), y.min(), y.max()))
    left, right, bottom, top = zip(*ends, strict=True)
    return sum(len(r.x) for r in runs), min(left), max(right), min(bottom), max(top)


def _by_page(documents: DataFrame, passwords: tuple[str, ...], fields: dict[str, str], of: Callable) -> DataFrame:
    """A row of ``fields`` for every page of which ``of`` makes one from its runs, and for every error."""
    kinds = {"path": "string", "page_num": "bigint", **fields, "error": "string"}

    def row(path, page, runs, error):
        values = [None] * len(fields) if error is not None else of(runs)
        for v in values or ():
            if isinstance(v, str):
                v.encode()  # what isn't Unicode text is an error of its page
        return values and (path, page, *values, error)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.record_batch([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for r in _each(batches, passwords, False, row):
            if r:
                rows.append(r)
                size += sum(len(v) for v in r if isinstance(v, str))
            if len(rows) >= BATCH or size >= CHARACTERS:
                yield batch(rows)
                rows, size = [], 0
        yield batch(rows)

    return documents.select("path", "content").mapInArrow(work, ", ".join(f"{n} {k}" for n, k in kinds.items()))


def _lined(runs: list[Run], tolerance: float) -> str | None:
    """The text of a page as ``page_text`` has it: a fold over the distinct y from the top, and within a line from left to right."""
    flat, bent = [], []  # strings of one y, and what has a y for each character
    for i, r in enumerate(runs):
        if isinstance(r.y, (np.ndarray, list)) or "\n" in r.s:
            at = np.array([k for k, s in enumerate(r.s) if s != "\n"], int)
            bent.append((i, _floats(r.y, len(r.x))[at], _floats(r.x, 0)[at], [r.s[k] for k in at]))
        else:
            flat.append((i, float(r.y), r.x, r.s))
    tops: list[float] = []  # negative, so that they ascend
    for y in sorted({y for _, y, *_ in flat}.union(*(y.tolist() for _, y, *_ in bent)), reverse=True):
        if not tops or -tops[-1] - y > tolerance:
            tops.append(-y)
    lines: list[list] = [[] for _ in tops]
    for i, y, x, s in flat:
        lines[bisect_right(tops, -y) - 1].append((i, x, s))
    for i, y, x, s in bent:
        line = np.searchsorted(tops, -y, "right") - 1
        order = np.argsort(line, kind="stable")
        for at in np.split(order, np.flatnonzero(np.diff(line[order])) + 1) if len(order) else []:
            lines[line[at[0]]].append((i, x[at], [s[k] for k in at]))
    return "\n".join(map(_in_order, lines)) if lines else None


def _in_order(parts: list[tuple]) -> str:
    """The texts of a line's characters by x; those of one x stay as they came."""
    parts.sort(key=lambda part: part[0])
    x = parts[0][1] if len(parts) == 1 else np.concatenate([x for _, x, _ in parts])
    if (x[1:] >= x[:-1]).all():
        return "".join(["".join(s) for *_, s in parts])
    texts = [c for *_, s in parts for c in s]
    return "".join([texts[i] for i in np.argsort(x, kind="stable")])


def _said(error: Exception) -> str:
    return str(error) if isinstance(error, ValueError) else f"{type(error).__name__}: {error}"


def for_layout(glyphs: DataFrame) -> DataFrame:
    """The characters as runs for the layout operators, with a hash of the path as doc_id; errors and line marks are left out."""
    shown = glyphs.where("error is null and s <> '\n'")
    return shown.select(F.xxhash64("path").alias("doc_id"), "page_num", "seq", "font", "font_size", "x", "y", "w", "s", F.lower("font").rlike("bold|black").alias("bold"), F.floor("y").alias("phys"), "vertical")


def page_text(glyphs: DataFrame, tolerance: float = 2.0) -> DataFrame:
    """Characters of a page by lines from the top, each from left to right; a line holds what is at most ``tolerance`` below its first."""
    shown = glyphs.where("s is not null and s <> '\n'").select("path", "page_num", "x", "y", "seq", "s")
    lined = anchored(shown, ["path", "page_num"], tolerance)
    lines = lined.groupBy("path", "page_num", "line").agg(joined([F.col("x"), F.col("seq")], F.col("s")).alias("t"))
    return lines.groupBy("path", "page_num").agg(joined([F.col("line")], F.col("t"), "\n").alias("text"))


def lined(strings: DataFrame, by: str = "y") -> DataFrame:
    """The part ``strings`` by truncated coordinate: rows (by y, from left to right) or columns (by x, from the top); empty strings
    are left out."""
    shown = strings.where("s <> ''")
    order = [F.col("x"), F.col("seq")] if by == "y" else [-F.col("y"), F.col("seq")]
    return shown.groupBy("path", "page_num", F.col(by).cast("bigint").alias("position")).agg(joined(order, F.col("s"), " ").alias("content"), F.count("*").alias("n"))


def metadata(documents: DataFrame, passwords: tuple[str, ...] = ()) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = content or b""
                at = content.find(b"PDF-", 0, 4096)
                version = content[at + 4 : at + 7].decode("latin-1") if at >= 0 else None
                try:
                    doc = Document.open(content, passwords)
                    rows.append((path, version, len(doc.pages()), list(doc.info().items()), doc.recovered, None))
                except Exception as e:
                    rows.append((path, version, None, None, None, _said(e)))
            kinds = [pa.string(), pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "version", "pages", "info", "recovered", "error"])

    return documents.select("path", "content").mapInArrow(work, METADATA)


#: Further tables of a document: columns after path, Arrow types, and the rows of an open document.
_PARTS = {
    "outline": ({"seq": "bigint", "depth": "bigint", "title": "string"}, lambda doc: [(i, *e) for i, e in enumerate(doc.outline())]),
    "page_fonts": ({"page_num": "bigint", "name": "string", "base_font": "string", "subtype": "string"}, lambda doc: [(n, *f) for n, p in enumerate(doc.pages(), 1) for f in doc.page_fonts(p)]),
    "rects": ({"page_num": "bigint", "seq": "bigint", "min_x": "double", "min_y": "double", "max_x": "double", "max_y": "double"}, lambda doc: [(n, i, *map(float, r)) for n, p in enumerate(doc.pages(), 1) for i, r in enumerate(_rects(doc, p))]),
    "strings": ({"page_num": "bigint", "seq": "bigint", "x": "double", "y": "double", "s": "string"}, lambda doc: [(n, i, float(x), float(y), s) for n, p in enumerate(doc.pages(), 1) for i, (x, y, s) in enumerate(page_strings(doc, p))]),
    "objects": ({"num": "bigint", "value": "string"}, lambda doc: [(n, shown(doc.resolve(Ref(n, 0)))) for n in sorted(doc.places) if doc.places[n]]),
    "linearization": ({"name": "string", "value": "string"}, lambda doc: sorted(doc.linearization().items())),
    "trailer": ({"name": "string", "value": "string"}, lambda doc: sorted((k, shown(v)) for k, v in doc.trailer.items())),
}
_ARROW = {"bigint": pa.int64(), "double": pa.float64(), "string": pa.string()}


def _rects(doc: Document, page: dict) -> list:
    out: list = []
    page_runs(doc, page, out)
    return out


def part(documents: DataFrame, name: str, passwords: tuple[str, ...] = ()) -> DataFrame:
    """A further table of the documents: outline, page_fonts, rects, strings (whole strings, placed by Tm alone), objects, linearization or trailer; unreadable documents are
    rows with an error."""
    fields, rows_of = _PARTS[name]
    kinds = {"path": "string", **fields, "error": "string"}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rows = [(path, *r, None) for r in rows_of(Document.open(content or b"", passwords))]
                except Exception as e:
                    rows = [(path, *[None] * len(fields), _said(e))]
                columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.record_batch([pa.array(c, _ARROW[k]) for c, k in zip(columns, kinds.values(), strict=True)], list(kinds))

    return documents.select("path", "content").mapInArrow(work, ", ".join(f"{n} {k}" for n, k in kinds.items()))
