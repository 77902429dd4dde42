"""Suffix-array dedup: removal of every byte that a string of LENGTH bytes covers which also starts elsewhere.

Sorting all suffixes of a corpus moves every byte many times. Here bucket-pointer refinement is applied to those
suffixes alone that can matter:

1. Initial buckets. For each window of LENGTH bytes, the q-gram (Q bytes) with the least hash inside it is its
   anchor (winnowing). Equal windows have equal anchors at equal places, and a text has about 2 / (LENGTH - Q) anchors
   a byte. Only anchors leave the task, once for all copies of a text; buckets (anchor hash) with one member can hold no
   repeat and end here.
2. Refinement. The contexts of the anchors that are left (the bytes of the windows that belong to an anchor) are dealt by bucket.
   Each window start gets the rank of its Q-gram among all Q-grams as its bucket's identifier. Buckets are then refined by
   sorting on pairs of identifiers: a start's own and that at a later offset (Q to 2Q by the one at +Q, then 2Q to LENGTH by
   the 2Q identifier at +2Q, which the step before has just made; the last step overlaps where the length isn't Q times a
   power of two). The rank of the pair is the new identifier. Starts that are alone in their bucket end at once.
3. The starts that remain are repeats; their windows are joined to spans and cut out of each text.

Identifiers after the first are ranks and so exact; the first is a 64-bit hash of Q symbols, so two different strings would have
to share that hash at each of their places to be taken for equal. Exact copies of whole texts are held once (a text is known by
two independent 64-bit hashes) and are repeats throughout.

Memory. A task refines some PIECE bytes of buckets at a time; a larger bucket of up to HOT_BYTES is refined by blocks of offsets
from the anchor, STARTS window starts at a time. A bucket beyond HOT_BYTES isn't gathered: each of its windows becomes a row,
counted by a pre-aggregated group-by. All three give the same result.

Lengths are counted in symbols, and LENGTH bytes are the default. ``word_spans`` takes words (runs of bytes other than ASCII white
space, each by a 64-bit hash) as the symbols, so that a repeat of so many words is found however short they are. An anchor there has
few windows, of which each is many bytes of symbols; so their 64-bit identifiers are dealt by bucket in place of the context.

Edge cases: null text: empty; texts of fewer than LENGTH bytes keep all bytes; very long texts are hashed whole, in one piece;
repeated rows are copies of each other (ties of ids don't matter, as texts are known by their content); with no repeats nothing is
removed; an empty table gives an empty result; other columns pass (``strip``) or are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrowtext import binary_array, chunks, mix, utf8, words
from quire.llm.tables import release, remove, settle, text_key

LENGTH, Q = 400, 100
#: Words of a passage that is one by its words.
PASSAGE = 51
#: Bytes hashed at a time; temporaries take some fifty times that.
PIECE = 1 << 20
#: Contexts of one bucket that a task may gather, in bytes; and the window starts it refines at a time.
HOT_BYTES, STARTS = 16 << 20, 1 << 18
_P = 0x9E3779B97F4A7C15
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
#: Bytes of a symbol that stands for a word.
WORD = 8
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        for j, base in enumerate((_P, pow(_P, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[j] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def symbols(column: pa.Array, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of a column of texts and n + 1 offsets: bytes (unit 1) or hashes of words (unit WORD)."""
    buf, off = utf8(column)
    if unit == 1:
        return buf, off
    w = words(buf, off)
    return w.hashes(buf), w.first


def stored(column: pa.Array, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """The same of a column that holds symbols already."""
    buf, off = utf8(column)
    return (buf, off) if unit == 1 else (np.frombuffer(buf.tobytes(), np.uint64), off // unit)


def prefix(buf: np.ndarray) -> np.ndarray:
    up, _ = _power(len(buf) + 1)
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((_BYTES[buf] if buf.dtype == np.uint8 else mix(buf)) * up[:-1], out=out[1:])
    return out


def grams(sums: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` bytes from each position; equal bytes have equal hashes wherever they are."""
    _, down = _power(len(sums))
    return mix((sums[at + size] - sums[at]) * down[at])


def anchors(buf: np.ndarray, off: np.ndarray, length: int = LENGTH, q: int = Q) -> tuple[np.ndarray, ...]:
    """document, hash, position, first and last window start of each anchor (positions within the document)."""
    n, width = len(buf), length - q + 1
    none = np.zeros(0, np.int64)
    sizes = np.diff(off)
    if n < length or not (sizes >= length).any():
        return none, none.astype(np.uint64), none, none, none
    h = grams(prefix(buf), np.arange(n - q + 1), q)
    # the order of grams: 32 bits of the hash, then the place; the least key tells the leftmost least gram
    key = (h >> np.uint64(32) << np.uint64(32)) | np.arange(len(h), dtype=np.uint64)
    blocks = -(-len(key) // width)
    padded = np.full(blocks * width + width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    square = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(square, axis=1).ravel()
    behind = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.flatnonzero(np.repeat(off[1:], sizes)[: n - length + 1] - np.arange(n - length + 1) >= length)
    own = (np.minimum(behind[starts], ahead[starts + width - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (own[1:] != own[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    doc = np.searchsorted(off, starts[first], side="right") - 1
    base = off[doc]
    return doc, h[own[first]], own[first] - base, starts[first] - base, starts[last] - base


def _anchors(batches: Iterator[pa.RecordBatch], length: int, q: int, unit: int) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text", PIECE):
        doc, h, at, lo, hi = anchors(*symbols(part.column(2), unit), length, q)
        k1, k2 = (part.column(i).to_numpy()[doc] for i in (0, 1))
        yield pa.record_batch([pa.array(h.view(np.int64)), pa.array(k1), pa.array(k2), pa.array(at), pa.array(lo), pa.array(hi)], ["bucket", "k1", "k2", "at", "lo", "hi"])


def _pick(part: pa.RecordBatch, unit: int):
    """Rows of joined texts and anchors as flat arrays: text, offsets, row of each anchor, and its columns."""
    buf, off = symbols(part.column(2), unit)
    lists = part.column(3)
    flat = lists.flatten()
    row = np.repeat(np.arange(part.num_rows), np.diff(lists.offsets.to_numpy()))
    return buf, off, row, *(flat.field(i).to_numpy() for i in range(5))


_CONTEXTS = "bucket bigint, k1 bigint, k2 bigint, at bigint, lo bigint, context binary, window bigint"


def _contexts(batches: Iterator[pa.RecordBatch], length: int, unit: int, hot: int) -> Iterator[pa.RecordBatch]:
    """A row with the context of each anchor, or, where its bucket is beyond ``hot``, a row with the identifier of each window."""
    names = [x.split()[0] for x in _CONTEXTS.split(", ")]
    for part in chunks(batches, "text", PIECE):
        buf, off, row, bucket, at, lo, hi, n = _pick(part, unit)
        if not len(row):
            continue
        k1, k2 = (part.column(i).to_numpy()[row] for i in (0, 1))
        ids = grams(prefix(buf), np.arange(len(buf) - length + 1), length) if unit == WORD or (n > hot).any() else None
        # of words a window's identifier stands in place of its symbols
        data, more = (buf.tobytes(), length) if unit == 1 else (ids.tobytes(), 1)
        few = np.flatnonzero(n <= hot)
        for a in range(0, len(few), 2048):
            s = few[a : a + 2048]
            texts = [data[x:y] for x, y in zip(((off[row[s]] + lo[s]) * unit).tolist(), ((off[row[s]] + hi[s] + more) * unit).tolist(), strict=True)]
            yield pa.record_batch([*(pa.array(c[s]) for c in (bucket, k1, k2, at, lo)), pa.array(texts, pa.binary()), pa.nulls(len(s), pa.int64())], names)
        many = np.flatnonzero(n > hot)
        for a in range(0, len(many), 512):
            s = many[a : a + 512]
            size = hi[s] - lo[s] + 1
            which = np.repeat(s, size)
            start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[s], size)
            h = ids[off[row[which]] + start]
            yield pa.record_batch([*(pa.array(c[which]) for c in (bucket, k1, k2, at)), pa.array(start), pa.nulls(len(h), pa.binary()), pa.array(h.view(np.int64))], names)


def _ranks(values: np.ndarray) -> np.ndarray:
    return np.unique(values.ravel(), return_inverse=True)[1].reshape(values.shape).astype(np.uint64)


def _offsets(length: int, q: int) -> list[int]:
    """Where the q-grams of a string lie that its identifiers are made from; neighbours are joined first, then neighbours of those."""
    out, size = [0], q
    while size < length:
        gap = min(size, length - size)
        out, size = [*out, *(o + gap for o in out)], size + gap
    return out


def _repeated(buf: np.ndarray, off: np.ndarray, which: np.ndarray, at: np.ndarray, length: int, q: int) -> np.ndarray:
    """Which of the window starts (context, place in it; ordered by context) have an equal window among them."""

    def hashes(own: np.ndarray, places: list[int]) -> np.ndarray:
        out = np.empty((len(places), len(own)), np.uint64)
        held = which[own]
        c = 0
        while c < len(off) - 1:
            d = max(c + 1, int(np.searchsorted(off, off[c] + PIECE, "right")) - 1)
            a, b = np.searchsorted(held, [c, d])
            if a < b:
                sums = prefix(buf[off[c] : off[d]])
                base = off[held[a:b]] - off[c] + at[own[a:b]]
                for j, p in enumerate(places):
                    out[j, a:b] = grams(sums, base + p, q)
            c = d
        return out

    own = np.arange(len(which))
    first = _ranks(hashes(own, [0]))[0]
    own = own[np.bincount(first.astype(np.int64))[first.astype(np.int64)] > 1]
    if not len(own):
        return own
    ids = _ranks(hashes(own, _offsets(length, q)))
    while len(ids) > 1:
        ids = _ranks((ids[::2] << np.uint64(32)) | ids[1::2])
    last = ids[0].astype(np.int64)
    return own[np.bincount(last)[last] > 1]


def refine(contexts: pa.Array, bucket: np.ndarray, back: np.ndarray, length: int = LENGTH, q: int = Q, unit: int = 1, starts: int = STARTS, reach: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, first and last repeated window start (within the context), for contexts that have one.

    ``bucket``: the initial bucket of each context's anchor; all contexts of a bucket are given together. ``back``: the place of
    the anchor in the context. Equal windows lie equally far from their anchors, so blocks of that distance (below ``reach``) are
    refined apart.
    """
    buf, off = stored(contexts, unit)
    count = np.diff(off) - length + 1
    n, width = len(count), reach or length - q + 1
    step = width if count.sum() <= starts else max(1, starts // max(n, 1))
    low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
    for r in range(0, width, step):
        # starts whose distance to the anchor is r .. r + step - 1
        a, b = np.maximum(0, back - r - step + 1), np.minimum(count - 1, back - r)
        size = np.maximum(b - a + 1, 0)
        which = np.repeat(np.arange(n), size)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
        alive = _repeated(buf, off, which, at, length, q)
        np.minimum.at(low, which[alive], at[alive])
        np.maximum.at(high, which[alive], at[alive])
    rows = np.flatnonzero(high >= 0)
    return rows, low[rows], high[rows]


def _refined(batches: Iterator[pa.RecordBatch], length: int, q: int, unit: int) -> Iterator[pa.RecordBatch]:
    """Whole buckets, some megabytes at a time; rows come sorted by bucket."""

    def work(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        column = lambda i: t.column(i).to_numpy()
        lo = column(4)
        size = (length, q) if unit == 1 else (1, 1)
        rows, first, last = refine(t.column(5), column(0), column(3) - lo, *size, unit, reach=length - q + 1)
        lo = lo[rows]
        return pa.record_batch([pa.array(column(1)[rows]), pa.array(column(2)[rows]), pa.array(lo + first), pa.array(lo + last + length)], ["k1", "k2", "a", "b"])

    held, size = [], 0
    for batch in batches:
        at = 0
        bucket = batch.column(0).to_numpy()
        ends = np.append(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket))
        if held and len(bucket) and held[-1].column(0)[-1].as_py() != bucket[0]:
            ends = np.insert(ends, 0, 0)
        per_row = batch.nbytes / max(1, batch.num_rows)
        for e in ends[:-1].tolist():
            if size + (e - at) * per_row >= PIECE:
                held.append(batch.slice(at, e - at))
                yield work(held)
                held, size, at = [], 0, e
        held.append(batch.slice(at))
        size += (len(bucket) - at) * per_row
    if held:
        yield work(held)


def _hot(length: int, q: int, unit: int) -> int:
    """Anchors whose contexts, or identifiers of windows, fit in HOT_BYTES."""
    return max(1, HOT_BYTES // (2 * length - q if unit == 1 else (length - q + 1) * unit))


def spans(documents: DataFrame, hot: int | None = None, length: int = LENGTH, q: int = Q) -> DataFrame:
    """k1, k2 (the text's key), spans array<struct<a, b>>: stretches of bytes to remove, by distinct text; they may overlap.

    A stretch may end beyond the text (copies); it is cut there.
    """
    text = F.coalesce("text", F.lit(""))
    return _spans(documents.select(*text_key(), text.alias("text")), hot, length, q, 1)


def word_spans(documents: DataFrame, least: int = PASSAGE, hot: int | None = None) -> DataFrame:
    """As ``spans``, of every ``least`` words that also start elsewhere, whatever white space is between them; stretches of words."""
    text = F.coalesce("text", F.lit(""))
    return _spans(documents.select(*text_key(), text.alias("text")), hot, least, max(1, least // 4 + (least % 4 > 0)), WORD)


def _spans(rows: DataFrame, hot: int | None, length: int, q: int, unit: int) -> DataFrame:
    """``rows``: k1, k2 and the text, whose symbols are of ``unit`` bytes."""
    spark = rows.sparkSession
    hot = hot or _hot(length, q, unit)
    rows = rows.where(F.octet_length("text") >= (length if unit == 1 else 2 * length - 1))
    found = rows.mapInArrow(lambda batches: _anchors(batches, length, q, unit), "bucket bigint, k1 bigint, k2 bigint, at bigint, lo bigint, hi bigint")
    # copies of a text have the same anchors, which are held once from here on
    found = settle(found.distinct())
    # both sides are read anew for the join, so Spark may split a very common bucket's rows
    places = settle(found.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"))
    shared = settle(found.join(places.hint("merge"), "bucket"))
    remove(spark, found, places)
    release(spark)
    texts = rows.dropDuplicates(["k1", "k2"])

    lists = shared.groupBy("k1", "k2").agg(F.collect_list(F.struct("bucket", "at", "lo", "hi", "n")).alias("anchors"))  # of one text
    texts = texts.join(lists.hint("merge"), ["k1", "k2"]).select("k1", "k2", "text", "anchors")
    met = settle(texts.mapInArrow(lambda batches: _contexts(batches, length, unit, hot), _CONTEXTS))
    release(spark)
    contexts = met.where("context is not null").select("bucket", "k1", "k2", "at", "lo", "context")
    out = contexts.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(lambda batches: _refined(batches, length, q, unit), "k1 bigint, k2 bigint, a bigint, b bigint")
    made = [settle(out)]
    windows = met.where("context is null").select("bucket", "window", "k1", "k2", "lo")
    if not windows.isEmpty():
        twice = settle(windows.groupBy("bucket", "window").agg(F.count("*").alias("n")).where("n > 1"))
        made.append(settle(windows.join(twice.hint("merge"), ["bucket", "window"]).select("k1", "k2", F.col("lo").alias("a"), (F.col("lo") + length).alias("b"))))
        remove(spark, twice)
    remove(spark, met)
    remove(spark, shared)
    release(spark)
    copies = rows.groupBy("k1", "k2").agg(F.count("*").alias("n")).where("n > 1")
    found = reduce(DataFrame.unionByName, [*made, copies.select("k1", "k2", F.lit(0).cast("bigint").alias("a"), F.lit(1 << 40).cast("bigint").alias("b"))])
    out = settle(found.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "b")).alias("spans")))
    remove(spark, *made)
    release(spark)
    return out


def union(pairs: list) -> list[tuple[int, int]]:
    """Maximal stretches covered by (a, b) pairs."""
    out: list[list[int]] = []
    for a, b in sorted(pairs):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def cut(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    at, kept = 0, []
    for a, b in removed:
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]])


def _with_spans(documents: DataFrame, hot: int | None, length: int, q: int, least_words: int | None) -> DataFrame:
    found = {"_spans": spans(documents, hot, length, q)}
    if least_words:
        found["_words"] = word_spans(documents, least_words, hot)
    out = documents.withColumns({"_k1": text_key()[0], "_k2": text_key()[1]})
    for name, part in found.items():
        part = part.select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2"), F.col("spans").alias(name))
        out = out.join(part.hint("merge"), ["_k1", "_k2"], "left")
    return out


def _words_in(data: bytes, pairs: list | None, least: int) -> tuple[list[tuple[int, int]], int]:
    """Stretches of bytes and number of words of stretches of words; none in a text of fewer than ``least`` words."""
    if not pairs:
        return [], 0
    w = words(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    n = len(w.starts)
    if n < least:
        return [], 0
    runs = union([(p["a"], min(p["b"], n)) for p in pairs])
    return [(int(w.starts[a]), int(w.ends[b - 1])) for a, b in runs], sum(b - a for a, b in runs)


def digests(documents: DataFrame, hot: int | None = None, least_words: int = PASSAGE) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``documents`` (doc_id, text), and n_passage_words: its words in
    passages of ``least_words`` words that also start elsewhere, whatever their bytes and white space."""
    rows = _with_spans(documents.select("doc_id", "text"), hot, LENGTH, Q, least_words).select("doc_id", "text", "_spans", "_words")
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, n_passage_words bigint"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", PIECE):
            out = []
            for text, pairs, more in zip(*(part.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                data = (text or "").encode()
                removed = union([(p["a"], min(p["b"], len(data))) for p in pairs or ()])
                out.append((len(data), sum(b - a for a, b in removed), len(removed), hashlib.sha256(cut(data, removed)).hexdigest(), _words_in(data, more, least_words)[1]))
            columns = list(zip(*out, strict=True))
            yield pa.record_batch([part.column(0), *(pa.array(c, pa.string() if i == 3 else pa.int64()) for i, c in enumerate(columns))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_words"])

    return rows.mapInArrow(work, schema)


def strip(documents: DataFrame, hot: int | None = None, length: int = LENGTH, q: int = Q, least_words: int | None = None) -> DataFrame:
    """``documents`` with repeats cut out of ``text``; parts of characters at the edges of a cut go too.

    With ``least_words`` repeats of so many words go as well, from the first byte of their first word to the last of their last.
    """
    # names that no column of the caller can clash with
    plain = documents.toDF(*("text" if c == "text" else f"_c{i}" for i, c in enumerate(documents.columns)))
    found = ["_spans", "_words"] if least_words else ["_spans"]
    rows = _with_spans(plain, hot, length, q, least_words).select(*plain.columns, *found)
    at = plain.columns.index("text")
    last = len(plain.columns)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text", PIECE):
            texts = []
            by_word = part.column(last + 1).to_pylist() if least_words else [None] * part.num_rows
            for text, pairs, more in zip(part.column(at).to_pylist(), part.column(last).to_pylist(), by_word, strict=True):
                if pairs or more:
                    data = text.encode()
                    removed = [(p["a"], min(p["b"], len(data))) for p in pairs or ()]
                    removed += _words_in(data, more, least_words or 0)[0]
                    text = cut(data, union(removed)).decode("utf-8", "ignore")
                texts.append(text)
            columns = part.columns[:last]
            columns[at] = pa.array(texts, part.schema.field(at).type)
            yield pa.record_batch(columns, part.schema.names[:last])

    return rows.mapInArrow(work, plain.schema).toDF(*documents.columns)
