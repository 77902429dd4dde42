"""The pipeline against its stages done by brute force (the forest's verdicts are taken from the operator)."""

import random

import pytest
from pyspark.sql import functions as F
from test_ngramjoin import brute as brute_components
from test_operators import edits
from test_repeats import brute as brute_repeats

import corpus_pipeline
from quire.llm import decontaminate, pieces, quality, repeats

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, found string"


def test_pipeline_matches_brute_force(spark, tmp_path):
    library = pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(6)
    word = lambda: rng.choice(["ab", "été", "cor", "dune", "x"]) + str(rng.randrange(60))
    prose = lambda n: " ".join(word() for _ in range(n))
    passage, items = prose(110), [(i, prose(25)) for i in range(3)]
    texts = [prose(rng.randrange(5, 160)) for _ in range(40)]
    texts += [t + " end" for t in texts[:6]] + [texts[7]] * 3 + [prose(30) + " " + passage + " " + prose(30) for _ in range(4)]
    texts += [prose(30) + " " + x + " " + prose(10) for _, x in items] + [None, "", "### " * 50] + [prose(40).replace(" ", "## ") for _ in range(5)]
    rows = [(i, t, "en", "s", len(t or ""), f"f{i}") for i, t in enumerate(texts)] + [(None, prose(50), None, None, None, None)]
    sf = str(tmp_path)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    labels = [(i, 1, 0) for i in range(30)] + [(len(texts) - 1, 0, 0), (len(texts) - 2, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")

    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).where("kept").select("doc_id", "text")
    kept = [tuple(r) for r in judged.collect()]
    component = {d: c for d, _, c in brute_components(kept)}
    kept = [(d, t) for d, t in kept if d is None or component[d] == d]
    whole = dict(kept)
    left = {}
    for d, _, n_removed, _, _ in brute_repeats(kept):
        left[d] = whole[d] if not n_removed else None
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    cut = {r.doc_id: r.text for r in repeats.strip(spark.createDataFrame(kept, "doc_id bigint, text string")).collect()}
    assert all(cut[d] == t for d, t in left.items() if t is not None) and any(t is None for t in left.values())
    want = set()
    for d, t in cut.items():
        words = decontaminate.text_words(t)
        if all(edits(own := decontaminate.text_words(x), words) > int(decontaminate.BUDGET * len(own)) for _, x in items):
            want.add(d)
    assert set(got) == want and len(want) < len(kept)
    for d, r in got.items():
        assert r.text == cut[d] and r.token_ids == library.encode(cut[d]) and r.n_chars == len(cut[d])
        assert r.found == (f"f{d}" if d is not None else None)


def test_empty_tables(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([], SCHEMA).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(f"{sf}/benchmark.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [*spark.createDataFrame([], SCHEMA).columns]
    assert corpus_pipeline.run(spark, sf).withColumn("n", F.size("token_ids")).count() == 0


def test_near_duplicates_take_five_words_and_080(spark):
    # one word of 50 differs: 41 of 51 shingles of five words are common (0.804), 43 of 51 of four (0.843)
    words = [f"w{i}" for i in range(50)]
    near = [*words[:25], "other", *words[26:]]
    far = [*near[:40], "more", *near[41:]]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far[::-1]))]
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id bigint, text string"), "").collect()
    assert sorted(r.doc_id for r in got) == [1, 3]


def test_last_stage_decodes_its_ids(spark):
    rows = [(1, "plain words", "x"), (2, "été  #\n▁ 漢字", "y"), (3, "", "z")]
    got = corpus_pipeline.sentencepiece(spark, spark.createDataFrame(rows, "doc_id bigint, text string, decoded_exact string"), "").collect()
    assert all(r.decoded_exact is True for r in got) and {r.doc_id for r in got if r.token_ids} == {1, 2}
