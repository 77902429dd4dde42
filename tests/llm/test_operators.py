"""Edge cases and brute-force versions of the operators that aren't tested in files of their own."""

import base64
import hashlib
import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, licences, pieces, quality, tokencounts, urlfilter, warc

DOCS = "doc_id bigint, text string, n_words string"
ODD = [(None, "some words here", "x"), (1, None, None), (2, "", "y"), (3, " \n ", "z"), (3, " \n ", "z"), (4, "wörd " * 9000, "long")]


def docs(spark, rows=ODD, schema=DOCS):
    return spark.createDataFrame(rows, schema)


# -- 1 licences
def test_licences(spark):
    rows = [(1, "Intro.\nReleased under the MIT License.\nmore", ""), (2, "licensed UNDER the apache license; version 2.0", ""), (3, "Licensed under CC BY-NC 4.0.", ""), (4, "nothing of the kind " * 40, "")]
    found = licences.scan(docs(spark, rows + ODD)).collect()
    got = sorted((r.doc_id, r.line_no, r.licence, r.dice) for r in found if r.line_no is not None)
    assert got == [(1, 0, "MIT", 0.8), (1, 2, "MIT", 1.0), (2, 1, "Apache-2.0", 1.0), (3, 1, "CC-BY-NC-4.0", 1.0)]
    got = sorted((r.doc_id, r.first_word, r.licence, r.dice) for r in found if r.line_no is None)
    assert got == [(1, 1, "MIT", 1.0), (2, 0, "Apache-2.0", 1.0), (3, 0, "CC-BY-NC-4.0", 1.0)]
    assert licences.scan(docs(spark, [])).collect() == []
    assert licences.scan(docs(spark, []), []).collect() == []
    assert licences.scan(docs(spark, rows), [("x", None), ("y", "")]).collect() == []


def test_licences_within_lines_and_files(spark):
    rng = random.Random(1)
    mit = max((t for n, t in licences.TEMPLATES if n == "MIT"), key=len).split()
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(n))
    wrapped = "\n".join(" ".join(mit[i : i + 9]) for i in range(0, len(mit), 9))
    edited = [w if i % 40 else "other" for i, w in enumerate(mit)]
    rows = [(1, prose(300) + "\n\n" + wrapped + "\n\n" + prose(4000), "MIT"), (2, prose(20) + " Released under the MIT License. " + prose(30), "MIT"), (3, prose(5) + " " + " ".join(edited), "MIT")]
    rows += [(4, "Permission is hereby granted " + prose(50), ""), (5, prose(30_000) + " Licensed under\n the Apache License,\nVersion 2.0. " + prose(9), "Apache-2.0"), (6, " ".join(mit[3:]), "MIT"), (6, " ".join(mit[3:]), "MIT")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, licence string")
    got = sorted((r.doc_id, r.first_word, r.licence) for r in licences.scan(table).collect() if r.line_no is None)
    assert got == [(1, 300, "MIT"), (2, 20, "MIT"), (3, 5, "MIT"), (5, 30_000, "Apache-2.0"), (6, 0, "MIT"), (6, 0, "MIT")]


# -- 2 decontamination
def edits(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row)


def whole_edits(item, text):
    row = list(range(len(text) + 1))
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (w != t)))
        row = new
    return row[-1]


def test_decontamination_ids_places_and_scripts(spark):
    item = [f"w{i}" for i in range(14)]
    more = "答案是四十二号房间里的红色盒子"
    items = [("a", " ".join(item)), (None, " ".join(item)), ("b", more), ("c", "one two three"), ("d", None)]
    rows = [(1, "x y " + " ".join([*item[:7], "new", *item[7:]]) + " z"), (2, "问：他说“" + more[:8] + "的" + more[8:] + "”。"), (3, "he said “one two three”—and"), (4, " ".join(f"v{i}" for i in range(40_000)) + " " + " ".join(item))]
    bench = spark.createDataFrame(items, "item_id string, text string")
    table = spark.createDataFrame([(d, t, "old") for d, t in rows], "doc_id bigint, text string, found string")
    for limit in (decontaminate.BLOCK_BYTES, 100):
        got = {r.doc_id: [tuple(x) for x in r.found] for r in decontaminate.flag(table, bench, block_bytes=limit).collect()}
        assert got == {1: [(None, 1, 2), ("a", 1, 2)], 2: [("b", 1, 3)], 3: [("c", 0, 2)], 4: [(None, 0, 40_000), ("a", 0, 40_000)]}


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: rng.choice("abcdefghij") + str(rng.randrange(20))
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 8, 20, 45])))) for i in range(12)] + [(50, None), (51, ""), (52, "!!")]
    rows = [(i, " ".join(word() for _ in range(80))) for i in range(20)]
    for d in range(40):
        item, own = rng.choice(items[:12])
        own = own.split()
        for _ in range(rng.randrange(0, 8)):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], [word()], [own[k], word()]])
            own = own or ["x"]
        lead = [word() for _ in range(rng.randrange(5))]
        rows.append((100 + d, " ".join([*lead, *(w.upper() for w in own), word()])))
    rows += [(None, None), (200, ""), (201, items[0][1] + ", " + items[1][1])]
    want = set()
    plain = lambda t: re.findall(r"[^\W_]+", (t or "").lower())  # noqa: E731  a tokeniser of the test's own
    for d, t in rows:
        words = plain(t)
        for i, x in items:
            own = plain(x)
            limit = int(decontaminate.BUDGET * len(own))
            if own and (e := edits(own, words)) <= limit:
                want.add((d, i, e))
    table = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(2)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    for limit in (decontaminate.BLOCK_BYTES, 500):  # one block of items, several blocks
        out = decontaminate.flag(table, bench, block_bytes=limit).select("doc_id", F.explode("found").alias("f"))
        assert {(r.doc_id, r.f.item_id, r.f.distance) for r in out.collect()} == want
        places = {(r.doc_id, r.f.item_id): (r.f.first_word, r.f.distance) for r in out.collect()}
        for (d, i), (first, distance) in places.items():
            own, words = plain(dict(items)[i]), plain(dict(rows)[d])
            assert any(whole_edits(own, words[first:end]) == distance for end in range(first, min(len(words), first + 2 * len(own)) + 1))
    assert decontaminate.findings(table, bench.limit(0)).count() == 0
    assert decontaminate.findings(table.limit(0), bench).count() == 0


# -- 3 chat
def test_chat_round_trip_and_folding(spark):
    said = r"\### Assistant: </turn> ok \\b #\h"
    log = [(1, 0, "message", "user", said), (1, 1, "message", "assistant", "drop"), (1, 2, "regenerate", "assistant", None), (1, 3, "delta", "assistant", "a"), (1, 4, "delta", "assistant", said)]
    log += [(2, 0, "message", None, None), (2, 0, "message", None, None), (None, 5, None, "us:er\n: x", ""), (3, 1, "delta", "assistant", "alone"), (4, 1, "message", "user", "x"), (4, 2, "edit", "user", "y")]
    out = chat.format_chats(spark.createDataFrame(log, "conv_id bigint, seq bigint, kind string, role string, text string"))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in out.select("conv_id", chat.parse(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", said), ("assistant", "a" + said)], 2: [("", ""), ("", "")], None: [("us:er\n: x", "")], 3: [("assistant", "alone")], 4: [("user", "y")]}
    assert chat.format_chats(spark.createDataFrame([], "conv_id bigint, seq bigint, kind string, role string, text string")).count() == 0


def test_chat_other_columns_and_long_texts(spark):
    long = "a#\\</turn>" * 50_000
    log = [(1, 0, "message", "user", "hi", "x", 1), (1, 1, "message", "assistant", long, "y", 2)]
    out = chat.format_chats(spark.createDataFrame(log, "conv_id bigint, seq bigint, kind string, role string, text string, formatted string, message int"))
    assert [tuple(t) for t in out.select(chat.parse(F.col("formatted")).alias("t")).first().t] == [("user", "hi"), ("assistant", long)]


# -- 5 WARC
def test_warc_reads_by_ranges_whatever_the_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "TASK_BYTES", 4_000)
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2000))), "own", 7) for i in range(60)]
    _, index = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string, path string, offset int"), archive_bytes=1 << 20)
    assert index.select("path").distinct().count() == 1
    back = warc.read(index)
    assert back.rdd.getNumPartitions() >= 4  # one archive, several tasks
    assert {(r.page_id, bytes(r.payload).decode()) for r in back.collect()} == {(r[0], r[2]) for r in rows}


def test_warc(spark):
    rows = [(5, "http://a/\r\nX: y", "same"), (3, None, "same"), (7, "http://b/", None), (8, "http://c/", ""), (None, "http://d/", "same"), (9, "http://e/", "\r\n\r\nWARC/1.1 " + "ü" * 70_000), (3, None, "same")]
    _, index = warc.write(spark.createDataFrame(rows, "page_id bigint, url string, html string"), archive_bytes=60_000)
    got = warc.read(index).collect()
    seen = sorted([(r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in got], key=str)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"same": 3, "": 7}
    want = []
    for i, _, h in rows:
        f = first.get(h or "", i)
        want.append((i, "response" if i == f else "revisit", None if i == f else f, len((h or "").encode()), digest(h)))
    assert seen == sorted(want, key=str)
    _, index = warc.write(spark.createDataFrame([], "page_id bigint, url string, html string"))
    assert warc.read(index).count() == 0


# -- 6 token counts
def test_token_counts(spark):
    tokenizers = pytest.importorskip("tokenizers")
    own = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    own.encode_special_tokens = True
    texts = ["hello world", "", None, "<|endoftext|>", "été " * 700, "hello world", "x"]
    sizes = [len(own.encode(t or "", add_special_tokens=False).ids) for t in texts]
    table = docs(spark, [(i, t, "") for i, t in enumerate(texts)])
    hist = tokencounts.histogram(table)
    for r in hist.collect():
        over = [s for s in sizes if s >= r.length]
        assert (r.n_docs, r.docs_at_least, r.tokens_at_least) == (sizes.count(r.length), len(over), sum(over))
        assert r.truncated_total == sum(min(s, r.length) for s in sizes)
        assert r["quantile"] == sum(s <= r.length for s in sizes) / len(sizes)
    limits = [0, 1, 2, 100, 10_000]
    asked = tokencounts.totals(hist, spark.createDataFrame([(x,) for x in limits], "context bigint"))
    assert sorted(map(tuple, asked.collect())) == [(x, sum(s > x for s in sizes), sum(min(s, x) for s in sizes)) for x in limits]
    assert tokencounts.histogram(docs(spark, [])).count() == 0


# -- 7 quality
def brute_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if count[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, again = set(), 0
    for line in text.split("\n"):
        again += bool(re.search(r"[^\x20\x09-\x0D]", line)) and line in seen
        seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(covered)


def test_quality_statistics_and_verdicts(spark):
    rng = random.Random(8)
    word = lambda: rng.choice("aeiou") + rng.choice(["n", "st", "é", "x"]) * rng.randrange(1, 4)
    rows = [(i, "\n".join(" ".join(word() for _ in range(12)) for _ in range(6)), "") for i in range(150)]
    rows += [(200 + i, " ".join(word() + "###" for _ in range(60)), "") for i in range(12)]
    rows += [(300, "a b c d e f g h " * 9, ""), (301, "x\n\nx\n \nx\r\nx", "")] + ODD
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(200 + i, 0, 0) for i in range(6)] + [(None, 1, 0), (1, None, 0)], "doc_id bigint, quality int, toxic int")
    table = docs(spark, rows).repartition(3)
    got = quality.judge(table, labels).collect()
    assert len(got) == len(rows)
    texts = Counter((r.doc_id, r.text) for r in got)
    assert texts == Counter((i, t) for i, t, _ in rows)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_statistics(r.text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    clean = [r.kept for r in got if (r.doc_id or 999) < 150 and r.doc_id not in (1, 2, 3, 4)]
    assert sum(clean) >= 0.95 * len(clean)
    held_out = [r.kept for r in got if 206 <= (r.doc_id or 0) < 212]
    assert sum(held_out) == 0
    none = quality.judge(table, labels.limit(0)).collect()
    assert all(r.kept == (not r.base_failed) for r in none)
    assert quality.judge(docs(spark, []), labels).count() == 0


# -- 9 SentencePiece
def test_sentencepiece_matches_the_library(spark):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(2)
    texts = ["Hello  world\n\tx", " a", "   ", "▁x", "a\xa0b ﬁ ①", "日本語 é🎉\x00", "x" * 500 + " " + "ab" * 300, "aaaa" * 30, None, ""]
    texts += ["".join(rng.choice("abcdefghi éß\n.,0123456789中") for _ in range(rng.randrange(80))) for _ in range(300)]
    rows = [(i, t, "") for i, t in enumerate(texts)]
    got = {r.doc_id: r.token_ids for r in pieces.encode(docs(spark, rows).repartition(2)).collect()}
    for i, t in enumerate(texts):
        assert got[i] == library.encode(t or "")
    model = pieces.load(pieces.MODEL)
    assert model.decode(model.encode(pa.array(texts, pa.string()))) == [(t or "").replace("▁", " ") for t in texts]
    assert all(r.exact for r in pieces.digests(docs(spark)).collect())
    assert pieces.encode(docs(spark, [])).count() == 0


def test_unigram_models_use_viterbi():
    sentencepiece = pytest.importorskip("sentencepiece")
    string = lambda k, v: bytes([k << 3 | 2, len(v)]) + v
    names = [("<unk>", 0.0, 2), ("▁", -3.0, 1), *((c, -4.0 - i / 7, 1) for i, c in enumerate("abcdé")), ("▁a", -2.5, 1), ("ab", -5.1, 1), ("bc", -5.3, 1), ("abc", -8.1, 1), ("cd", -4.4, 1), ("▁ab", -6.2, 1)]
    import struct

    data = b"".join(string(1, string(1, n.encode()) + b"\x15" + struct.pack("<f", s) + bytes([24, k])) for n, s, k in names)
    data += string(2, bytes([24, 1])) + string(3, bytes([24, 1, 32, 0]) + string(1, b"identity"))
    library = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdé z") for _ in range(rng.randrange(1, 14))) for _ in range(200)]
    texts += ["azzb", "zz z zz", "z", "a zz", "ab" * 23, "ab" * 24 + "c", "zab" * 40]
    got = pieces.Model(data).encode(pa.array(texts)).to_pylist()
    assert got == [library.encode(t) for t in texts]
    for bad in (bytes([24, 1, 32, 1]), bytes([24, 1, 32, 0]) + string(2, b"map"), bytes([24, 1])):
        with pytest.raises(ValueError):
            pieces.Model(data + string(3, bad))
    with pytest.raises(ValueError):
        pieces.Model(data + string(1, string(1, b"<own>") + bytes([24, 4])))


def test_parts_on_both_sides_of_the_heap(spark):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdeinorst") for _ in range(n)) for n in (46, 47, 48, 49, 50, 51, 200) for _ in range(20)] + [c * n for c in "a=é" for n in (46, 47, 48, 49, 50, 300)]
    assert pieces.load(pieces.MODEL).encode(pa.array(texts)).to_pylist() == [library.encode(t) for t in texts]


# -- 10 URL filter
def test_url_filter(spark):
    rules = urlfilter.rules_table(spark, [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow")])
    urls = [None, "no scheme", "http://", "HTTP://A.COM/x?y", "http://b.example.com/en/1", "http://www.example.com/en/", "http://example.com/EN/", "http://example.com", "http://com/", "x://ample.com.net/en/#", "http://notexample.com/en/", "http://a.com?x=/en/"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(3, urls[3]), (None, urls[4])] + [(100 + i, f"http://h{i}.net/p{i}") for i in range(500)]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(spark.createDataFrame(rows, "page_id bigint, url string"), rules).collect()}
    assert got[0] == got[1] == ("", "", None, "allow") and got[2] == ("", "", None, "allow")
    assert got[3] == ("a.com", "/x", "com/", "allow")
    assert got[4] == ("b.example.com", "/en/1", "example.com/en/", "block") == got[None]
    assert got[5] == ("www.example.com", "/en/", "www.example.com/en/", "allow")
    assert got[6] == ("example.com", "/EN/", "com/", "allow")
    assert got[7] == ("example.com", "", None, "allow")
    assert got[8] == ("com", "/", "com/", "allow")
    assert got[9] == ("ample.com.net", "/en/", None, "allow")
    assert got[10][2] == "com/" and got[11][1:3] == ("", None)
    assert all(got[100 + i] == (f"h{i}.net", f"/p{i}", None, "allow") for i in range(500))
    assert urlfilter.judge(spark.createDataFrame([], "page_id bigint, url string"), rules).count() == 0
    assert urlfilter.judge(spark.createDataFrame(rows[:3], "page_id bigint, url string"), rules.limit(0)).count() == 3


def test_cascade_is_exact_over_its_universe(spark):
    listed = spark.range(300).select(F.concat(F.lit("k"), "id").alias("key"))
    universe = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"))
    cascade = urlfilter.build(listed, universe)
    assert universe.where(cascade.holds(F.col("key"))).count() == 300 == listed.where(cascade.holds(F.col("key"))).count()
