"""Benchmark decontamination: approximate occurrences of test items in documents.

Texts are compared as words: in lower case, runs of letters, digits and marks of any script; punctuation, symbols and spaces of any
script part words, and in scripts that are written without spaces each character is a word. An item of n words has an error
budget of k = floor(BUDGET * n) word edits (none below seven words). It is split into k + 1 pieces of nearly equal length; wherever it
occurs with at most k edits, one piece occurs unchanged (pigeonhole). Pieces are found by the hash of their words: a document's
windows of each piece length are looked up in the sorted hashes, behind a bitmap that drops most windows at
once. Each hit fixes where the item could lie, and Myers' bit-parallel algorithm (an item's words are the bits of one
integer) finds the least number of edits there, compared by whole words and not by hash. The same algorithm, run backwards from
where the best stretch ends, finds where it begins.

The items are sent to the tasks in blocks of at most ``BLOCK_BYTES`` of text, one after the other, each searched in all documents; so
neither the driver nor a task holds more than one, however many items there are. What a block finds is written by text and joined to
the documents at the end. With one block (the usual case) there is one pass and no shuffle.

Edge cases: null or empty items and items without a word match nothing; null and empty documents match nothing; repeated
items are found each; repeated documents give their findings again; ids of items may be null and of any type; of equally good places
of an item the first to end counts, and of its beginnings the last; a text of any length is searched whole; with no items
nothing is found; an empty table gives an empty result; other columns are kept by ``flag`` unless named like its result, which
replaces them.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrowtext import Words, binary_array, chunks, utf8, window_hashes
from quire.llm.tables import remove, settle, text_key

BUDGET, BLOCK_BYTES = 0.15, 8 << 20
_BITS = 20

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = True
_WORD[128:] = True

#: First and last characters of scripts that are written without spaces between words.
UNSPACED = [(0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)]


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 0 part of a word, 1 between words, 2 a word of its own."""
    out = np.zeros(0x110000, np.uint8)
    for a, b in UNSPACED:
        out[a : b + 1] = 2
    for c in [*range(0x80, 0x20000), *range(0xE0000, 0xE0200)]:
        if unicodedata.category(chr(c))[0] in "PSZC":
            out[c] = 1
    return out


def split_words(buf: np.ndarray, off: np.ndarray) -> Words:
    """Words of lower-cased UTF-8 bytes, never across documents."""
    inside, n = _WORD[buf], len(buf)
    alone = np.zeros(n + 1, bool)  # a word begins here whatever stands before
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        b0 = buf[lead].astype(np.int64)
        size = 2 + (b0 >= 0xE0) + (b0 >= 0xF0)
        byte = lambda k: buf[np.minimum(lead + k, n - 1)].astype(np.int64) & 0x3F
        point = np.where(size == 2, (b0 & 0x1F) << 6 | byte(1), np.where(size == 3, (b0 & 0x0F) << 12 | byte(1) << 6 | byte(2), (b0 & 0x07) << 18 | byte(1) << 12 | byte(2) << 6 | byte(3)))
        kind = _kinds()[np.minimum(point, 0x10FFFF)]
        for k in range(4):
            inside[(lead + k)[(kind == 1) & (size > k)]] = False
        own = kind == 2
        alone[lead[own]] = alone[(lead + size)[own]] = True
    before, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    before[1:] = after[:n] = inside
    before[off] = after[off] = False
    starts = np.flatnonzero(inside & (~before[:n] | alone[:n]))
    return Words(starts, np.flatnonzero(inside & (~after[1:] | alone[1:])) + 1, np.searchsorted(starts, off), inside)


def text_words(text: str | None) -> list[bytes]:
    buf, off = utf8(pc.utf8_lower(pa.array([text or ""])))
    w = split_words(buf, off)
    return [buf[a:b].tobytes() for a, b in zip(w.starts, w.ends, strict=True)]


def myers(masks: dict, size: int, text: list, anchored: bool = False) -> tuple[int, int]:
    """Least edits between the item and any stretch of ``text``, and where the first best stretch ends (exclusive).

    ``anchored``: only stretches from the first word on.
    """
    full, high = (1 << size) - 1, 1 << (size - 1)
    pv, mv, score = full, 0, size
    best, at = size, 0
    for j, t in enumerate(text, 1):
        eq = masks.get(t, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ph << 1 | anchored
        mh <<= 1
        pv = (mh | ~(xv | ph)) & full
        mv = ph & xv & full
        if score < best:
            best, at = score, j
    return best, at


class Index:
    """Pieces of a block of items by hash."""

    def __init__(self, items: list[tuple], budget: float = BUDGET):
        self.items = []
        rows = []
        for item, text in items:
            own = text_words(text)
            n = len(own)
            if not n:
                continue
            k = int(budget * n)
            hashes = np.array([xxhash.xxh3_64_intdigest(x) for x in own], np.uint64)
            masks: dict = {}
            for i, x in enumerate(own):
                masks[x] = masks.get(x, 0) | 1 << i
            cuts = [i * n // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows.append((b - a, int(window_hashes(hashes[a:b], b - a)[0]), len(self.items), a))
            self.items.append((item, n, k, masks))
        self.tables = {}
        for size in sorted({r[0] for r in rows}):
            own = sorted(r[1:] for r in rows if r[0] == size)
            keys = np.array([r[0] for r in own], np.uint64)
            there = np.zeros(1 << _BITS, bool)
            there[keys >> np.uint64(64 - _BITS)] = True
            self.tables[size] = (keys, there, [r[1:] for r in own])

    def search(self, texts: pa.Array) -> list[list[tuple]]:
        """Per document: (item_id, distance, first word) of the items found, by item_id."""
        buf, off = utf8(pc.utf8_lower(texts))
        w = split_words(buf, off)
        found: list[dict] = [{} for _ in range(len(off) - 1)]
        if not len(w.starts) or not self.tables:
            return [[] for _ in found]
        coded = binary_array(buf[w.inside], w.ends - w.starts).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        codes = coded.indices.to_numpy(zero_copy_only=False)
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes]
        tried: set = set()
        for size, (keys, there, places) in self.tables.items():
            own = window_hashes(h, size)
            at = np.flatnonzero(there[own >> np.uint64(64 - _BITS)])
            if not len(at):
                continue
            low, high = np.searchsorted(keys, own[at], "left"), np.searchsorted(keys, own[at], "right")
            docs = np.searchsorted(w.first, at, side="right") - 1
            for p, d, a, b in zip(at.tolist(), docs.tolist(), low.tolist(), high.tolist(), strict=True):
                if a == b or p + size > w.first[d + 1]:
                    continue
                for j in range(a, b):
                    number, offset = places[j]
                    item, n, k, masks = self.items[number]
                    # one window for hits whose places differ by little; it is wide enough for each of them
                    begin = (p - offset) // (k + 1) * (k + 1)
                    if (number, d, begin) in tried:
                        continue
                    tried.add((number, d, begin))
                    lo = max(int(w.first[d]), begin - k)
                    hi = min(int(w.first[d + 1]), begin + n + 2 * k + 1)
                    distance, end = myers(masks, n, [distinct[c] for c in codes[lo:hi].tolist()])
                    if distance <= k:
                        back = {x: int(f"{m:0{n}b}"[::-1], 2) for x, m in masks.items()}
                        _, size_there = myers(back, n, [distinct[c] for c in codes[lo : lo + end][::-1].tolist()], anchored=True)
                        found[d][number] = min(found[d].get(number, (n + 1, 0)), (distance, lo + end - size_there - int(w.first[d])))
        return [sorted(((self.items[i][0], *v) for i, v in x.items()), key=lambda v: (v[0] is not None, v)) for x in found]


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> tuple[int, Iterator[list[tuple]]]:
    """The number of blocks of about ``limit`` bytes of text, and the items by block."""
    rows = benchmark.select("item_id", "text").where(F.length("text") > 0)
    total = rows.select(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = max(1, -(-total // limit))
    return n, ([tuple(r) for r in (rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) if n > 1 else rows).collect()] for b in range(n))


def found_type(benchmark: DataFrame) -> str:
    return f"array<struct<item_id:{benchmark.schema['item_id'].dataType.simpleString()},distance:int,first_word:bigint>>"


def flag(documents: DataFrame, benchmark: DataFrame, budget: float = BUDGET, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``documents`` with ``found``: the items that occur in the text, with distance and place, by item_id (null first)."""
    spark, kind = documents.sparkSession, found_type(benchmark)
    documents = documents.drop("found")
    n, own = blocks(benchmark, block_bytes)
    if n == 1:
        items = next(own)
        return _search(documents, items, budget, kind) if items else documents.withColumn("found", F.array().cast(kind))
    # findings by text, a block at a time: neither the documents nor the items are held or written more than once
    k1, k2 = text_key()
    texts = documents.select(k1, k2, "text")
    parts = [settle(_search(texts, items, budget, kind).where(F.size("found") > 0).select("k1", "k2", "found").dropDuplicates(["k1", "k2"])) for items in own if items]
    found = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(F.flatten(F.collect_list("found")).alias("found"))
    found = settle(found.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.array_sort("found").alias("found")))
    remove(spark, *parts)
    keyed = documents.withColumns({"_k1": k1, "_k2": k2}).join(found.hint("merge"), ["_k1", "_k2"], "left")
    return keyed.select(*[F.col(f"`{c}`") for c in documents.columns], F.coalesce("found", F.array().cast(kind)).alias("found"))


def _search(documents: DataFrame, items: list[tuple], budget: float, found: str) -> DataFrame:
    at = documents.columns.index("text")
    shared = documents.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_BYTES of text
    schema = documents.withColumn("found", F.array().cast(found)).schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        index = Index(shared.value, budget)
        kind = to_arrow_type(schema["found"].dataType)
        for part in chunks(batches, "text"):
            rows = [[{"item_id": i, "distance": s, "first_word": p} for i, s, p in g] for g in index.search(part.column(at))]
            yield pa.record_batch([*part.columns, pa.array(rows, kind)], [*part.schema.names, "found"])

    return documents.mapInArrow(work, schema)


def findings(documents: DataFrame, benchmark: DataFrame, budget: float = BUDGET) -> DataFrame:
    """doc_id, item_id, distance, first_word: a row for each document and item that occurs in it."""
    out = flag(documents.select("doc_id", "text"), benchmark, budget)
    return out.select("doc_id", F.explode("found").alias("f")).select("doc_id", "f.*")
