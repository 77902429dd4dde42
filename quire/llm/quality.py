"""Quality rules: statistics of whole texts, a base rule, and an isolation forest on the statistics.

Statistics (numpy over Arrow buffers, whole texts): see ``statistics``. The forest (Liu, Ting, Zhou 2008) is
built of ``TREES`` trees, each of ``PSI`` documents of a bounded sample of labelled rows, split at random values of
random features; documents with short path lengths are anomalous. Bound: the ``SAMPLE`` labelled documents with the smallest hashes
of their ids; corpus rows are all scored, one by one, with that model.

The sample is split by hashes of ids. On a quarter trees grow; anomalies must be rare there, so of its rows with quality 0 only so
many are used as make ``RARE`` of those with quality 1. On a half, which no tree has seen, the threshold is calibrated: the lowest
score that rejects no more than ``LOSS`` of the rows with quality 1, so that clean documents stay. On the last quarter recall and
loss are measured (``Forest.held_out``), which nothing else is drawn from.

The shares of duplicate lines and repeated words aren't among the features: the base rule has taken what they tell, clean documents
have some too, and with them the forest tells less (README: figures on held-out rows).

Edge cases: a null text has no words; with n_words < 20 a document fails the base rule (so null and empty texts do); very long texts
are counted whole; labels with a null id or quality are ignored, and of several labels of an id the least counts; without labels of
both kinds there is no threshold and the base rule alone decides; repeated rows give repeated results, and equal scores (ties) equal
verdicts; an empty table gives an empty result; other columns pass, but those named like a result are replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.arrowtext import binary_array, chunks, mix, per_document, utf8, window_hashes, words

SAMPLE, TREES, PSI, RARE, LOSS, SEED = 8192, 100, 256, 0.015, 0.004, 20240601
WINDOW = 8
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FEATURES = ["symbols_per_word", "echo_share", "word_length"]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def statistics(texts: pa.Array) -> dict[str, np.ndarray]:
    """Per document: the five counts and the features of the forest.

    n_words; word_chars (code points in words); n_symbols (``#*$%&|<>``); n_dup_lines (lines with a word, equal to an
    earlier line); n_repeat_words (words covered by 8-word windows that occur twice or more in the text).
    """
    buf, off = utf8(texts)
    n = len(off) - 1
    w = words(buf, off)
    total = lambda flags: per_document(flags, off)
    out = {"n_words": np.diff(w.first), "word_chars": total(w.inside & ((buf & 0xC0) != 0x80)), "n_symbols": total(_SYMBOL[buf])}
    codes, _ = w.codes(buf)
    out["n_dup_lines"] = _duplicate_lines(buf, off, w)
    out["n_repeat_words"] = _repeated_words(codes, w.first)
    echo = np.zeros(len(codes), bool)
    echo[1:] = codes[1:] == codes[:-1]
    echo[w.first[:-1][w.first[:-1] < len(codes)]] = False
    chars, count = np.maximum(out["word_chars"], 1), np.maximum(out["n_words"], 1)
    share = lambda x, of: np.round(x / of, 6)
    out["symbols_per_word"] = share(out["n_symbols"], count)
    out["echo_share"] = share(per_document(echo, w.first), count)
    out["word_length"] = share(out["word_chars"], count)
    return out


def _duplicate_lines(buf, off, w):
    n = len(off) - 1
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate([off[:-1], breaks + 1]), kind="stable")
    # a document's last line ends at its end, every other at its line break
    doc_of_break = np.searchsorted(off, breaks, side="right") - 1
    doc = np.sort(np.concatenate([np.arange(n), doc_of_break]), kind="stable")
    ends = np.sort(np.concatenate([off[1:], breaks]), kind="stable")
    at = np.zeros(len(buf) + 1, np.int64)
    at[w.starts + 1] = 1
    np.cumsum(at, out=at)
    worded = at[ends] > at[starts]
    lines = binary_array(buf[buf != 10], ends - starts)
    codes = lines.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    again = pd.Series(doc * (len(codes) + 1) + codes).duplicated(keep="first").to_numpy() & worded
    return np.bincount(doc[again], minlength=n).astype(np.int64)


def _repeated_words(codes, first):
    n = len(first) - 1
    out = np.zeros(n, np.int64)
    if len(codes) < WINDOW:
        return out
    h = window_hashes(codes.astype(np.uint64) + np.uint64(1), WINDOW)
    for d in range(n):
        a, b = first[d], first[d + 1]
        own = h[a : b - WINDOW + 1]
        if b - a <= WINDOW:
            continue
        s = np.sort(own)
        twice = s[1:][s[1:] == s[:-1]]
        if not len(twice):
            continue
        at = np.flatnonzero(np.isin(own, twice))
        if not _equal_where_hashes_are(codes[a:b], own, at):
            at = _exact_repeats(codes[a:b])
        edge = np.zeros(b - a + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        out[d] = np.count_nonzero(np.cumsum(edge[:-1]) > 0)
    return out


def _equal_where_hashes_are(codes, own, at) -> bool:
    order = at[np.argsort(own[at], kind="stable")]
    same = own[order[1:]] == own[order[:-1]]
    left, right = order[:-1][same], order[1:][same]
    return all(np.array_equal(codes[left + j], codes[right + j]) for j in range(WINDOW))


def _exact_repeats(codes) -> np.ndarray:
    _, which, count = np.unique(np.lib.stride_tricks.sliding_window_view(codes, WINDOW), axis=0, return_inverse=True, return_counts=True)
    return np.flatnonzero(count[which.ravel()] > 1)


def base_failed(n_words, n_repeat_words):
    return (n_words < 20) | (100 * n_repeat_words > 30 * n_words)


@dataclass
class Forest:
    """Trees as arrays: node i splits feature[i] at cut[i] into children 2i + 1 and 2i + 2; leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    length: np.ndarray  # path length that ends at a node
    norm: float
    threshold: float | None = None
    #: Rows that nothing was drawn from: (recall of quality 0, their number, loss of quality 1, their number); the base rule's rows are left out.
    held_out: tuple[float, int, float, int] | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for f, c, p in zip(self.feature, self.cut, self.length, strict=True):
            node = np.zeros(len(x), np.int64)
            while True:
                k = f[node]
                inner = k >= 0
                if not inner.any():
                    break
                step = 2 * node + 1 + (x[rows, np.maximum(k, 0)] >= c[node])
                node = np.where(inner, step, node)
            total += p[node]
        return 2.0 ** (-total / (len(self.feature) * self.norm))


def _mean_path(n: float) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, psi: int = PSI, seed: int = SEED) -> Forest:
    rng = np.random.default_rng(seed)
    psi = min(psi, len(x))
    depth = max(1, int(np.ceil(np.log2(max(psi, 2)))))
    size = 2 ** (depth + 1) - 1
    feature, cut, length = np.full((trees, size), -1, np.int16), np.zeros((trees, size)), np.zeros((trees, size))
    for t in range(trees):
        stack = [(0, 0, x[rng.choice(len(x), psi, replace=False)])]
        while stack:
            i, d, own = stack.pop()
            lo, hi = own.min(0), own.max(0)
            open_ = np.flatnonzero(hi > lo)
            if d == depth or len(own) < 2 or not len(open_):
                length[t, i] = d + _mean_path(len(own))
                continue
            k = rng.choice(open_)
            c = rng.uniform(lo[k], hi[k])
            c = c if c > lo[k] else hi[k]
            feature[t, i], cut[t, i] = k, c
            right = own[:, k] >= c
            stack += [(2 * i + 1, d + 1, own[~right]), (2 * i + 2, d + 1, own[right])]
    return Forest(feature, cut, length, max(_mean_path(psi), 1.0))


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """The forest and its threshold from at most ``sample`` labelled documents; None without both kinds of label."""
    picked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = picked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most ``sample`` rows of two integers
    rows = rows.mapInArrow(_features, "doc_id bigint, quality int, failed boolean, " + ", ".join(f"{f} double" for f in FEATURES))
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "failed", *FEATURES)).alias("x")).select("doc_id", "x.*")  # a row per id
    got = rows.toPandas()
    got = got[~got.failed]
    good, bad = got.quality.to_numpy() > 0, got.quality.to_numpy() <= 0
    if not good.any() or not bad.any():
        return None
    x = got[FEATURES].to_numpy(float)
    order = np.argsort(_shuffled(got.doc_id.to_numpy()))  # rows come in any order; the forest must not depend on it
    x, good = x[order], good[order]
    part = np.sort(_shuffled(got.doc_id.to_numpy())) % np.uint64(4)
    grown, fitted, held = part == 0, (part == 1) | (part == 2), part == 3
    if not (grown & good).any() or not (fitted & good).any():
        return None
    rare = np.flatnonzero(grown & ~good)[: max(1, int(RARE * (grown & good).sum()))]
    forest = grow(x[np.sort(np.concatenate([np.flatnonzero(grown & good), rare]))])
    scores = np.sort(forest.scores(x[fitted & good]))
    allowed = int(LOSS * len(scores))
    forest.threshold = float(np.nextafter(scores[len(scores) - 1 - allowed], np.inf))
    rejected = forest.scores(x) >= forest.threshold
    share = lambda rows: (float(rejected[rows].mean()) if rows.any() else 0.0, int(rows.sum()))
    forest.held_out = (*share(held & ~good), *share(held & good))
    return forest


def _shuffled(ids: np.ndarray) -> np.ndarray:
    return mix(ids.astype(np.uint64))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in chunks(batches, "text"):
        s = statistics(part.column(1))
        columns = [part.column(0).cast(pa.int64()), part.column(2).cast(pa.int32()), pa.array(base_failed(s["n_words"], s["n_repeat_words"]))]
        yield pa.record_batch([*columns, *[pa.array(s[f]) for f in FEATURES]], ["doc_id", "quality", "failed", *FEATURES])


def judge(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """All columns of ``documents`` with the five counts, base_failed, score and kept, which replace columns of these names."""
    forest = fit(documents, labels)
    own = [f for f in documents.schema if f.name not in {*COUNTS, "base_failed", "score", "kept"}]
    schema = documents.select(*[F.col(f"`{f.name}`") for f in own]).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    schema = schema.add("base_failed", "boolean").add("score", "double").add("kept", "boolean")
    at = [f.name for f in own].index("text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, "text"):
            s = statistics(part.column(at))
            failed = base_failed(s["n_words"], s["n_repeat_words"])
            score = forest.scores(np.stack([s[f] for f in FEATURES], 1)) if forest else np.zeros(len(failed))
            kept = ~failed & ((score < forest.threshold) if forest else True)
            more = [*[pa.array(s[c], pa.int64()) for c in COUNTS], pa.array(failed), pa.array(score), pa.array(kept)]
            yield pa.record_batch([*part.columns, *more], [*part.schema.names, *COUNTS, "base_failed", "score", "kept"])

    return documents.select(*[F.col(f"`{f.name}`") for f in own]).mapInArrow(work, schema)
