"""Columns of text as flat numpy arrays: bytes, document offsets, words and lines.

Arrow hands a string column to Python as one UTF-8 buffer with offsets. The functions here
work on that buffer directly, so no Python object exists per document or per word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Text bytes that are worked on at a time; numpy temporaries are a small multiple of this.
CHUNK_BYTES = 4 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def chunks(batches, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into pieces of about ``limit`` bytes of ``column`` (one row at least)."""
    for batch in batches:
        n, at = batch.num_rows, 0
        if n == 0:
            continue
        _, off = utf8(batch.column(batch.schema.get_field_index(column)))
        while at < n:
            to = int(np.searchsorted(off, off[at] + limit, side="right")) - 1
            to = min(n, max(to, at + 1))
            yield batch.slice(at, to - at)
            at = to


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]], off - off[0]


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def binary_array(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """A binary array over consecutive slices of ``values``."""
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(values))])


@dataclass
class Words:
    """Maximal runs of bytes other than ASCII white space, which never cross documents."""

    starts: np.ndarray  # byte position of each word
    ends: np.ndarray
    first: np.ndarray  # n + 1 offsets: the words of document d are first[d]:first[d + 1]
    inside: np.ndarray  # for each byte: part of a word

    def codes(self, buf: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
        """Exact codes of the words within this piece and the distinct words."""
        got = binary_array(buf[self.inside], self.ends - self.starts).dictionary_encode()
        return got.indices.to_numpy(zero_copy_only=False).astype(np.int64), got.dictionary.to_pylist()

    def hashes(self, buf: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word's bytes, the same in every piece and on every machine."""
        codes, distinct = self.codes(buf)
        if not distinct:
            return np.zeros(0, np.uint64)
        return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))[codes]


def words(buf: np.ndarray, off: np.ndarray) -> Words:
    inside = ~_SPACE[buf]
    n = len(buf)
    before = np.zeros(n + 1, bool)
    before[1:] = inside
    before[off] = False  # a document's first byte has no byte before it
    after = np.zeros(n + 1, bool)
    after[:n] = inside
    after[off] = False
    starts = np.flatnonzero(inside & ~before[:n])
    # the byte that follows i is i + 1, unless a document starts there
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return Words(starts, ends, np.searchsorted(starts, off), inside)


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit integers (the constants are those of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive values; entry i covers i .. i + k - 1."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for j in range(k):
        out = out * _MUL + h[j : j + n]
    return mix(out)


def per_document(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` over first[d]:first[d + 1]."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[first[1:]] - total[first[:-1]]
