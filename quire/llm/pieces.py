"""SentencePiece encoding and decoding in batches of numpy arrays.

Two kinds of model are read from a ``.model`` file (a protobuf, parsed here):

* unigram: Viterbi. The words of one length advance together; at each end position the substrings of every
  piece length are hashed, the hashes probe the sorted piece keys, and a vectorised maximum over the scores
  stores the backpointers.
* BPE: the best path by summed scores isn't what such a model means, so Viterbi gives other ids than the library does.
  Here too the words of one length advance together; pairs of neighbouring pieces probe sorted keys, a vectorised
  maximum picks each word's best merge (leftmost of equal ones), and all words apply theirs at once.

Texts are cut before each run of spaces (no piece goes on across one, which is checked when a model is loaded),
each distinct part of a batch is encoded once, and documents are put together from the parts. Characters without a
piece become byte pieces, or the unknown id if the model has none (one for a run of them). Models that normalise characters or white
space, or have pieces defined by users, are refused.

Edge cases: null and empty texts have no ids; U+2581 counts as a space, as in the library; ties go to the leftmost merge;
very long parts are encoded with a heap in O(n log n) instead of a matrix; repeated rows give repeated results.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quire.llm.arrowtext import binary_array, chunks, utf8

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Parts of more characters than this are encoded one by one with a heap.
LONGEST = 48
NONE = np.int64(1 << 40)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; fixed-width fields as their bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else 8 if kind == 1 else 4
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Pieces, scores and kinds of a SentencePiece model."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        scores, kinds, self.unigram, self.prefix = [], [], True, True
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f.get(1, b"").decode())
                scores.append(np.frombuffer(f[2], "<f4")[0] if 2 in f else 0.0)
                kinds.append(f.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
                if trainer.get(3, 1) not in (1, 2):
                    raise ValueError("only unigram and BPE models are read")
                if trainer.get(24, 0):
                    raise ValueError("white space as a suffix isn't supported")
                self.unigram = trainer.get(3, 1) == 1
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2):
                    raise ValueError("the model changes characters by a map, which isn't supported")
                if rules.get(4, 1):
                    raise ValueError("the model removes extra white space, which isn't supported")
                if not rules.get(5, 1):
                    raise ValueError("the model keeps spaces as they are, which isn't supported")
                self.prefix = bool(rules.get(3, 1))
        self.scores, self.kinds = np.array(scores, np.float64), np.array(kinds)
        self.unknown = int(np.flatnonzero(self.kinds == 2)[0])
        if (self.kinds == 4).any():
            raise ValueError("pieces defined by users go before all others, which isn't supported")
        self.ids = {p: i for i, p in enumerate(self.pieces) if self.kinds[i] == 1}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece goes on across a space")
        self.byte_ids = np.full(256, -1, np.int64)
        for i in np.flatnonzero(self.kinds == 6):
            self.byte_ids[int(self.pieces[i][3:5], 16)] = i
        self.char_ids = np.full(0x110000, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.char_ids[ord(p)] = i
        self.char_ids[0x20] = self.char_ids[ord(SPACE)]
        order = np.argsort(-self.scores, kind="stable")
        self.rank = np.empty(len(order), np.int64)  # ids by falling score; equal scores share a rank
        falling = self.scores[order]
        self.rank[order] = np.concatenate([[0], np.cumsum(falling[1:] < falling[:-1])])
        if self.unigram:
            self._keys()
        else:
            self._pairs()
        self.text = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for b, i in enumerate(self.byte_ids):
            if i >= 0:
                self.text[i] = bytes([b])
        for i in np.flatnonzero(self.kinds == 3):
            self.text[i] = b""
        self.text[self.unknown] = " ⁇ ".encode()

    # -- BPE ------------------------------------------------------------------------------------------
    def _pairs(self) -> None:
        pairs = {}
        for p, i in self.ids.items():
            for k in range(1, len(p)):
                if (a := self.ids.get(p[:k])) is not None and (b := self.ids.get(p[k:])) is not None:
                    pairs[(a << 20) | b] = i
        keys = np.fromiter(pairs, np.int64, len(pairs))
        order = np.argsort(keys)
        self.pair_keys, self.pair_ids = keys[order], np.fromiter(pairs.values(), np.int64, len(pairs))[order]
        # the sorted keys are probed from the place where their left id begins
        self.pair_first = np.searchsorted(self.pair_keys, np.arange(len(self.pieces) + 1, dtype=np.int64) << 20)
        self.steps = int(np.diff(self.pair_first).max(initial=1)).bit_length()
        self.known = pairs
        bits = 22
        self.table_shift, self.table = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        clashes = []
        for j, h in enumerate((self.pair_keys.astype(np.uint64) * _FIB) >> self.table_shift):
            if self.table[h] < 0:
                self.table[h] = j
            else:
                clashes.append(j)
        self.clash_keys, self.clash_ids = self.pair_keys[clashes], self.pair_ids[clashes]
        self.clash_at = np.zeros(1 << bits, bool)
        self.clash_at[((self.clash_keys.astype(np.uint64) * _FIB) >> self.table_shift)] = True

    def _merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair merges to, or -1; slots that several keys share are resolved in the sorted keys."""
        key = (left << 20) | right
        h = (key.astype(np.uint64) * _FIB) >> self.table_shift
        j = self.table[h]
        out = np.where((j >= 0) & (self.pair_keys[j] == key), self.pair_ids[j], -1)
        again = np.flatnonzero((out < 0) & self.clash_at[h] & (left >= 0) & (right >= 0))
        if len(again):
            at = np.minimum(np.searchsorted(self.clash_keys, key[again]), len(self.clash_keys) - 1)
            out[again] = np.where(self.clash_keys[at] == key[again], self.clash_ids[at], -1)
        out[(left < 0) | (right < 0)] = -1
        return out

    def _merge(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """s: symbols of n words of one length. Returns the final symbols, left-aligned, and their counts."""
        n, width = s.shape
        count = np.full(n, width, np.int64)
        final = s.copy()
        rows = np.arange(n)
        to = self._merged(s[:, :-1].ravel(), s[:, 1:].ravel()).reshape(n, width - 1) if width > 1 else np.zeros((n, 0), np.int64)
        cost = np.where(to >= 0, self.rank[to], NONE)
        cols = np.arange(width)
        while s.shape[1] > 1:
            at = cost.argmin(1)
            here = np.arange(len(s))
            live = cost[here, at] < NONE
            done = ~live
            if done.any():
                final[rows[done], : s.shape[1]] = s[done]
                s, cost, to, rows, at = s[live], cost[live], to[live], rows[live], at[live]
                here = np.arange(len(s))
            if not len(s):
                return final, count
            s[here, at] = to[here, at]
            width = s.shape[1]
            later = cols[: width - 1] > at[:, None]
            s = np.where(later, s[:, 1:], s[:, :-1])
            count[rows] -= 1
            if width == 2:
                break
            # pairs after the merged one move left; the two that touch it are looked up anew
            moved = cols[: width - 2] > at[:, None] - 1
            to = np.where(moved, to[:, 1:], to[:, :-1])
            cost = np.where(moved, cost[:, 1:], cost[:, :-1])
            for off in (-1, 0):
                k = at + off
                ok = np.flatnonzero((k >= 0) & (k < width - 2))
                got = self._merged(s[ok, k[ok]], s[ok, k[ok] + 1])
                to[ok, k[ok]] = got
                cost[ok, k[ok]] = np.where(got >= 0, self.rank[got], NONE)
        if len(s):
            final[rows, : s.shape[1]] = s
        return final, count

    def _merge_long(self, s: list[int]) -> list[int]:
        n = len(s)
        left, right, live = list(range(-1, n - 1)), [*range(1, n), -1], [True] * n
        heap: list = []

        def push(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and s[a] >= 0 and s[b] >= 0 and (i := self.known.get((s[a] << 20) | s[b])) is not None:
                heapq.heappush(heap, (int(self.rank[i]), a, b, s[a], s[b], i))

        for k in range(n - 1):
            push(k, k + 1)
        while heap:
            _, a, b, x, y, i = heapq.heappop(heap)
            if not live[a] or not live[b] or s[a] != x or s[b] != y or right[a] != b:
                continue
            s[a], live[b] = i, False
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            push(left[a], a)
            push(a, right[a])
        return [s[k] for k in range(n) if live[k]]

    # -- unigram --------------------------------------------------------------------------------------
    def _keys(self) -> None:
        names = list(self.ids)
        h = np.array([_text_hash(p.replace(SPACE, " ")) for p in names], np.uint64)
        order = np.argsort(h)
        self.keys, self.key_ids = h[order], np.array([self.ids[names[i]] for i in order])
        self.longest = max(map(len, names))
        self.missing = float(self.scores[list(self.ids.values())].min()) - 10.0

    def _viterbi(self, c: np.ndarray) -> list[np.ndarray]:
        """c: code points of n words of one length. Best paths as arrays of ids (-1: a character without a piece)."""
        n, width = c.shape
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back, piece = np.zeros((n, width + 1), np.int64), np.full((n, width + 1), -1, np.int64)
        for end in range(1, width + 1):
            h = np.zeros(n, np.uint64)
            power = np.uint64(1)
            for start in range(end - 1, max(-1, end - 1 - self.longest), -1):
                h = h + (c[:, start].astype(np.uint64) + np.uint64(1)) * power
                power = np.uint64(int(power) * int(_FIB) % (1 << 64))
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                found = self.keys[at] == h
                i = np.where(found, self.key_ids[at], -1)
                score = np.where(found, self.scores[i], self.missing if start == end - 1 else -np.inf)
                total = best[:, start] + score
                # of equal totals the longer last piece wins, as starts come in falling order and ties replace
                better = total >= best[:, end]
                better &= total > -np.inf
                best[better, end], back[better, end], piece[better, end] = total[better], start, i[better]
        out = []
        for r in range(n):
            path, end = [], width
            while end:
                path.append(piece[r, end] if piece[r, end] >= 0 else -1 - c[r, end - 1])
                end = back[r, end]
            out.append(np.array(path[::-1], np.int64))
        return out

    # -- both -----------------------------------------------------------------------------------------
    def _expand(self, cp: int) -> list[int]:
        """Ids of a character that has no piece."""
        if self.byte_ids[0] >= 0:
            return self.byte_ids[list(chr(cp).encode())].tolist()
        return [self.unknown]

    def encode_parts(self, parts: list[bytes]) -> pa.Array:
        """Ids of each distinct part as a list array."""
        texts = [p.decode() for p in parts]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes, out=first[1:])
        ids: list = [None] * len(texts)
        symbols = self.char_ids[points]
        symbols = np.where(symbols < 0, -1 - points, symbols)
        lengths = np.zeros(len(texts), np.int64)
        blocks = []
        for width in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == width)
            at = first[rows][:, None] + np.arange(width)
            if self.unigram:
                for step in range(0, len(rows), 4096):
                    for r, path in zip(rows[step : step + 4096], self._viterbi(points[at[step : step + 4096]]), strict=True):
                        blocks.append((np.array([r]), path))
                        lengths[r] = len(path)
            elif width > LONGEST:
                for r in rows.tolist():
                    path = np.array(self._merge_long(symbols[first[r] : first[r + 1]].tolist()), np.int64)
                    blocks.append((np.array([r]), path))
                    lengths[r] = len(path)
            else:
                final, count = self._merge(symbols[at])
                lengths[rows] = count
                blocks.append((rows, final[np.arange(width) < count[:, None]]))
        off = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(lengths, out=off[1:])
        flat = np.zeros(off[-1], np.int64)
        for rows, values in blocks:
            n = lengths[rows]
            at = np.repeat(off[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(len(values))
            flat[at] = values
        if (odd := np.flatnonzero(flat < 0)).size:  # characters without a piece
            more = [self._expand(int(-1 - flat[k])) for k in odd]
            extra = np.zeros(len(flat), np.int64)
            extra[odd] = [len(m) - 1 for m in more]
            grown = np.repeat(flat, extra + 1)
            shift = np.cumsum(extra) - extra
            for k, m in zip(odd, more, strict=True):
                grown[k + shift[k] : k + shift[k] + len(m)] = m
            total = np.zeros(len(flat) + 1, np.int64)
            np.cumsum(extra + 1, out=total[1:])
            off, flat = total[off], grown
        return pa.LargeListArray.from_arrays(pa.array(off), pa.array(flat.astype(np.int32)))

    def encode(self, texts: pa.Array) -> pa.LargeListArray:
        """Ids of each text."""
        buf, off = utf8(texts)
        if SPACE.encode() in buf.tobytes():
            fixed = pa.array([(t or "").replace(SPACE, " ") for t in texts.to_pylist()], pa.large_string())
            buf, off = utf8(fixed)
        sizes = np.diff(off)
        lead = (sizes > 0) & self.prefix
        if self.prefix:  # a space before each text that isn't empty
            wide = np.full(len(buf) + int(lead.sum()), 0x20, np.uint8)
            shift = np.cumsum(lead)
            wide[np.arange(len(buf)) + np.repeat(shift, sizes)] = buf
            off = np.concatenate([[0], np.cumsum(sizes + lead)])
            buf = wide
        if not len(buf):
            return pa.LargeListArray.from_arrays(pa.array(np.zeros(len(off), np.int64)), pa.array([], pa.int32()))
        space = buf == 0x20
        cut = np.zeros(len(buf) + 1, bool)
        cut[1:-1] = space[1:] & ~space[:-1]
        cut[off[:-1][sizes > 0]] = True
        starts = np.flatnonzero(cut[:-1])
        lengths = np.diff(np.append(starts, len(buf)))
        coded = binary_array(buf, lengths).dictionary_encode()
        found = self.encode_parts(coded.dictionary.to_pylist()).take(coded.indices)
        first = np.searchsorted(starts, off)  # the first part of each text
        ends = found.offsets.to_numpy()
        flat, ends = found.flatten(), ends[first] - ends[0]
        if self.byte_ids[0] < 0:  # neighbouring unknown characters of a text are one unknown id
            values = flat.to_numpy(zero_copy_only=False)
            again = np.zeros(len(values) + 1, bool)
            again[1:-1] = (values[1:] == self.unknown) & (values[:-1] == self.unknown)
            again[ends] = False
            flat, ends = pa.array(values[~again[:-1]]), ends - np.concatenate([[0], np.cumsum(again)])[ends]
        return pa.LargeListArray.from_arrays(pa.array(ends), flat)

    def decode(self, ids: pa.LargeListArray) -> list[str]:
        """Texts of lists of ids."""
        flat, off = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy()
        off = off - off[0]
        pieces = pa.array(self.text, pa.large_binary()).take(pa.array(flat))
        data, at = utf8(pieces)
        whole, at = data.tobytes(), at[off]
        cut = 1 if self.prefix else 0
        return [(x[cut:] if x[:1] == b" " else x).decode("utf-8", "replace") for x in (whole[a:b] for a, b in zip(at[:-1], at[1:], strict=True))]


_FIB = np.uint64(0x9E3779B97F4A7C15)


def _text_hash(text: str) -> int:
    out, power = 0, 1
    for ch in reversed(text):
        out = (out + (ord(ch) + 1) * power) % (1 << 64)
        power = power * int(_FIB) % (1 << 64)
    return out


@lru_cache(maxsize=2)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def encode(documents: DataFrame, model: str = MODEL, text: str = "text", ids: str = "token_ids", exact: str | None = None) -> DataFrame:
    """``documents`` with the column ``ids`` (array<int>) and, if named, ``exact``: decoding gives the text again. Columns of these names are replaced."""
    new = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(exact, T.BooleanType())] if exact else [])]
    names = [f.name for f in new]
    own = [f for f in documents.schema if f.name not in names]
    rest = documents.drop(*names)
    at = [f.name for f in own].index(text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for part in chunks(batches, text):
            got = m.encode(part.column(at))
            columns = [got.cast(pa.list_(pa.int32()))]
            if exact:
                columns.append(pa.array([x == (t or "").replace(SPACE, " ") for x, t in zip(m.decode(got), part.column(at).to_pylist(), strict=True)], pa.bool_()))
            yield pa.record_batch([*part.columns, *columns], [*part.schema.names, *names])

    return rest.mapInArrow(work, T.StructType([*rest.schema.fields, *new]))


def digests(documents: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids_hash (xxh3 of the little-endian ids, hexadecimal), n_bytes_decoded and exact: decoding gives the text again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = load(model)
        for part in chunks(batches, "text"):
            got = m.encode(part.column(1))
            back = m.decode(got)
            off, flat = got.offsets.to_numpy(), got.flatten().to_numpy(zero_copy_only=False)
            off = off - off[0]
            hashes = [xxhash.xxh3_128_hexdigest(flat[a:b].tobytes()) for a, b in zip(off[:-1], off[1:], strict=True)]
            exact = [x == (t or "").replace(SPACE, " ") for x, t in zip(back, part.column(1).to_pylist(), strict=True)]
            sizes = [len(x.encode()) for x in back]
            yield pa.record_batch([part.column(0), pa.array(np.diff(off)), pa.array(hashes), pa.array(sizes, pa.int64()), pa.array(exact)], ["doc_id", "n_tokens", "ids_hash", "n_bytes_decoded", "exact"])

    rows = documents.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(work, f"doc_id {kind}, n_tokens bigint, ids_hash string, n_bytes_decoded bigint, exact boolean")
