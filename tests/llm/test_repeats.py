"""Suffix-array dedup against a brute-force version."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quire.llm import repeats


def brute(rows):
    texts = [(i, (t or "").encode()) for i, t in rows]
    n = repeats.LENGTH
    seen = Counter(x[p : p + n] for _, x in texts for p in range(len(x) - n + 1))
    out = []
    for i, x in texts:
        gone = bytearray(len(x))
        for p in range(len(x) - n + 1):
            if seen[x[p : p + n]] > 1:
                gone[p : p + n] = b"\1" * n
        spans = sum(gone[j] and not (j and gone[j - 1]) for j in range(len(x)))
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        out.append((i, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus():
    rng = random.Random(5)
    words = ["the", "of", "été", "thing", "ähre", "lorem", "ipsum", "x"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(50)) for _ in range(n))
    passage, other = prose(120), prose(90)
    rows = [(i, prose(rng.randrange(1, 300))) for i in range(20)]
    rows += [(20 + i, prose(40) + passage + prose(rng.randrange(60))) for i in range(6)]
    rows += [(30, other + " mid " + other), (31, None), (32, ""), (33, "a" * 1500), (34, "ab" * 300), (35, "a" * 400)]
    rows += [(36, rows[3][1]), (36, rows[3][1]), (None, prose(200)), (37, passage[:399]), (38, passage[:401])]
    near = prose(400)
    rows += [(40 + i, near[: 150 * i] + "#" + near[150 * i :]) for i in range(8)]
    return rows


@pytest.mark.parametrize("hot", [None, 3])
def test_digests_match_brute_force(spark, hot):
    rows = corpus()
    got = repeats.digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), hot)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == brute(rows)


def test_large_buckets_are_refined_by_blocks():
    rng = random.Random(3)
    passage = bytes(rng.randrange(256) for _ in range(700))
    contexts = [passage[:300] + b"x" + passage[301:], passage, passage[:690] + b"yyyyyyyyyy", bytes(rng.randrange(256) for _ in range(700))]
    args = (pa.array(contexts, pa.binary()), np.zeros(4, np.int64), np.full(4, 300))
    whole = [x.tolist() for x in repeats.refine(*args)]
    for starts in (1 << 20, 256, 4, 1):
        assert [x.tolist() for x in repeats.refine(*args, starts=starts)] == whole
    # starts 0..290 are shared by the second and third, 301.. don't exist; the first shares no window, as byte 300 differs
    assert whole == [[1, 2], [0, 0], [290, 290]]


def test_passages_over_many_partitions(spark):
    # what a cluster sees: more partitions than rows of a group, passages from 400 bytes on, one very long text
    rng = random.Random(11)
    word = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n))
    rows = [(i, word(rng.randrange(30, 200))) for i in range(60)]
    passages = [word(200)[: rng.randrange(400, 500)] for _ in range(6)]
    rows += [(100 + i, word(40) + "|" + passages[i % 6] + "|" + word(30)) for i in range(24)]
    rows += [(200, word(30_000) + "|" + passages[0] + "|")]
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = {r.doc_id: r for r in repeats.digests(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(29)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for i in range(24):
        assert got[100 + i].n_removed >= len(passages[i % 6]) and got[100 + i].n_spans == 1 and got[100 + i].n_passage_words > 50
    assert got[200].n_spans == 1 and all(got[i].n_removed == 0 == got[i].n_passage_words for i in range(60))


def test_passages_below_400_bytes_are_told(spark):
    rng = random.Random(12)
    word = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(n))
    passage = word(51)
    rows = [(i, word(40) + " " + passage.replace(" ", " " * (1 + i)) + " " + word(9)) for i in range(3)] + [(9, word(100)), (10, " " * 300), (11, " " * 300), (12, None)]
    got = {r.doc_id: r for r in repeats.digests(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert [got[i].n_passage_words for i in (0, 1, 2, 9, 10, 11, 12)] == [51, 51, 51, 0, 0, 0, 0]
    assert [got[i].n_removed for i in (0, 1, 2, 9)] == [0, 0, 0, 0]


def test_empty_table_and_other_columns(spark):
    assert repeats.digests(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0
    rows = [(1, "é" * 300, 7), (2, "é" * 300, 8), (3, None, 9)]
    got = repeats.strip(spark.createDataFrame(rows, "doc_id bigint, text string, k1 int")).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "", 7), (2, "", 8), (3, None, 9)]


def brute_words(rows, least):
    """Texts without the repeats of LENGTH bytes and of ``least`` words."""
    gone = [bytearray(len((t or "").encode())) for _, t in rows]
    texts = [(t or "").encode() for _, t in rows]
    runs = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", x)] for x in texts]
    for parts in (
        [[(x[p : p + repeats.LENGTH], p, p + repeats.LENGTH) for p in range(len(x) - repeats.LENGTH + 1)] for x in texts],
        [[(tuple(x[a:b] for a, b in w[p : p + least]), w[p][0], w[p + least - 1][1]) for p in range(len(w) - least + 1)] for x, w in zip(texts, runs, strict=True)],
    ):
        seen = Counter(key for part in parts for key, _, _ in part)
        for own, part in zip(gone, parts, strict=True):
            for key, a, b in part:
                if seen[key] > 1:
                    own[a:b] = b"\1" * (b - a)
    return [(i, bytes(c for c, g in zip(x, own, strict=True) if not g).decode("utf-8", "ignore") if t is not None else None) for (i, t), x, own in zip(rows, texts, gone, strict=True)]


@pytest.mark.parametrize("hot", [None, 3])
def test_passages_of_over_50_words_match_brute_force(spark, hot):
    rng = random.Random(8)
    word = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(n))
    passage, short = word(51), word(50)
    assert len(passage) < 250
    rows = corpus() + [(60 + i, word(30) + " " + passage + "\n" + word(20)) for i in range(3)]
    rows += [(70, word(30) + " " + passage.replace(" ", "\n ") + " end"), (71, word(9) + " " + short + " x"), (72, word(9) + " " + short + " y")]
    rows += [(73, word(55)), (74, "a " * 60), (75, passage), (76, passage)]
    got = repeats.strip(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), hot, least_words=51)
    want = brute_words(rows, 51)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    left = dict(want)
    assert passage.split()[9] + " " + passage.split()[10] not in left[61] and short in left[71]


def test_lengths_that_are_no_power_of_two_times_q(spark):
    rng = random.Random(9)
    piece = "".join(rng.choice("abcdef") for _ in range(90))
    rows = [(1, "x" + piece + "yz"), (2, "uv" + piece + "w"), (3, "r" + piece[:89] + "s")]
    got = repeats.strip(spark.createDataFrame(rows, "doc_id bigint, text string"), length=90, q=25).orderBy("doc_id").collect()
    assert [r.text for r in got] == ["xyz", "uvw", rows[2][1]]
