"""A fluent builder over the layout operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import layout

if TYPE_CHECKING:
    import pandas as pd


@dataclass(frozen=True)
class Extractor:
    """``Extractor(glyphs).pages(1, 2).mode("plain").smart_ordering().extract()``; every call gives a new builder.

    Modes: plain (page texts), document (one text per document, of chosen pages in the order they are given), map (page number to text), styled (sentences of one style),
    structured (classified blocks). With smart ordering runs are clustered, clusters put in reading order and blocks are clusters; else
    texts follow baselines and blocks are lines. ``heights`` (doc_id, page_num, height) are the pages' heights for structured ones.
    """

    glyphs: DataFrame
    kind: str = "plain"
    chosen: tuple[int, ...] = ()
    smart: bool = False
    between: str = "\n"
    heights: DataFrame | None = None
    callback: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]] | None = None
    schema: str = ""

    def pages(self, *numbers: int) -> Extractor:
        return replace(self, chosen=numbers)

    def mode(self, kind: str) -> Extractor:
        if kind not in ("plain", "document", "map", "styled", "structured"):
            raise ValueError(f"unknown mode {kind!r}")
        return replace(self, kind=kind)

    def smart_ordering(self, on: bool = True) -> Extractor:
        return replace(self, smart=on)

    def separator(self, text: str) -> Extractor:
        return replace(self, between=text)

    def page_heights(self, pages: DataFrame) -> Extractor:
        return replace(self, heights=pages)

    def apply(self, callback: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> Extractor:
        """A function of the caller over the result's rows, in Arrow batches."""
        return replace(self, callback=callback, schema=schema)

    def extract(self) -> DataFrame:
        out = self._rows()
        return out.mapInPandas(self.callback, self.schema) if self.callback else out

    def save(self, path: str) -> None:
        """Write the texts as lines of text files, a folder of them, each task its own."""
        self.extract().select("text").write.text(path)

    def _rows(self) -> DataFrame:
        rows = self.glyphs.where(F.col("page_num").isin(*self.chosen)) if self.chosen else self.glyphs
        if self.kind == "styled":
            return layout.styled_sentences(rows)
        if self.kind == "structured":
            return layout.classify(layout.cluster_text_blocks(rows) if self.smart else layout.line_blocks(rows), rows, self.heights)
        texts = layout.smart_reading_text(rows) if self.smart else layout.plain_text(rows)
        if self.kind == "map":
            return layout.page_map(texts)
        return texts if self.kind == "plain" else layout.document_text(texts, self.between, self.chosen)
