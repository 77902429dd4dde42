"""A corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next stage's docs.
All but the last return the columns of documents; other columns, whatever their names, pass through.

1. quality rules: documents that the base rule or the isolation forest rejects go.
2. n-gram Jaccard join (5-word shingles, 0.8): of each group the document with the smallest id stays. Rows without an id
   can't be a group's document by id and stay; rows that share an id stay or go together, equal ones as one.
3. suffix-array dedup: bytes of repeated 400-byte strings and repeated passages of over 50 words go from the texts; n_chars is
   counted anew.
4. benchmark decontamination: documents that hold a test item go.
5. SentencePiece: the token ids of each text, and decoded_exact: decoding them gives the text again (columns of these names are
   replaced).

Null and empty texts fail the base rule of stage 1; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontaminate, ngramjoin, pieces, quality, repeats
from quire.llm.tables import settle, table, text_key


def _plain(docs: DataFrame) -> DataFrame:
    """Columns other than doc_id and text under names that no operator uses."""
    return docs.toDF(*(c if c in ("doc_id", "text") else f"_{i}" for i, c in enumerate(docs.columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    kept = quality.judge(plain, table(spark, sf_dir, "labels")).where("kept")
    return kept.select(plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    stay = ngramjoin.join(plain.select("doc_id", "text"), k=5, percent=80).where("doc_id = component_id").select("doc_id").distinct()
    k1, k2 = text_key()
    # the ids grow with the corpus, so they are never broadcast, however few they are
    kept = plain.join(stay.hint("merge"), "doc_id", "left_semi").withColumns({"k1": k1, "k2": k2}).dropDuplicates(["doc_id", "k1", "k2"]).select(plain.columns)
    return kept.unionByName(plain.where("doc_id is null")).toDF(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    out = repeats.strip(plain, least_words=51).toDF(*docs.columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    plain = _plain(docs)
    flagged = decontaminate.flag(plain, table(spark, sf_dir, "benchmark"))
    return flagged.where(F.size("found") == 0).select(plain.columns).toDF(*docs.columns)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode(docs, exact="decoded_exact")


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", suffix_dedup),
    ("benchmark decontamination", decontamination),
    ("SentencePiece", sentencepiece),
]

#: The isolation forest, the approximate matches and the encoding aren't expressible in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
