"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer.

Each text is encoded once and only its length leaves the task; documents are then aggregated by length (with
a partial count before the shuffle). All further figures come from that histogram, whose rows are bounded by the
longest document, not by the corpus. Suffix sums are made in two steps, within blocks of lengths and then over
the blocks, so no task holds more than one block.

For every length L that occurs: n_docs, docs_at_least (documents of L tokens or more), tokens_at_least (their
tokens), truncated_total (tokens kept when each document is cut at L: the sum of min(length, L)) and
quantile (share of documents with at most L tokens). ``totals`` answers any other context limit from these rows.

Edge cases: null and empty texts have zero tokens and count as documents; very long texts are encoded whole; strings of special tokens inside a text are
ordinary text; repeated rows count each time; an empty table gives an empty histogram; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.arrowtext import chunks
from quire.llm.tables import settle

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Byte-level BPE's split of a text into words, as the vocabulary's publisher states it (a fixed value).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Lengths in a block: suffix sums are made within blocks and then over blocks.
BLOCK = 1024


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def lengths(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """length: the number of tokens of each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(vocabulary)
        for part in chunks(batches, "text"):
            texts = part.column(0).to_pylist()
            yield pa.record_batch([pa.array([len(own.encode_ordinary(t)) if t else 0 for t in texts], pa.int64())], ["length"])

    return documents.select("text").mapInArrow(count, "length bigint")


def histogram(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    # written, as it is read twice below and the texts are to be encoded once
    counts = settle(lengths(documents, vocabulary).groupBy("length").agg(F.count("*").alias("n_docs")))
    counts = counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    within = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, 0)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("b_docs"), F.sum("tokens").alias("b_tokens"))
    # one row per block of lengths: max length / BLOCK rows
    above = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("b_docs").over(above), F.lit(0)).alias("a_docs"), F.coalesce(F.sum("b_tokens").over(above), F.lit(0)).alias("a_tokens"), F.sum("b_docs").over(everything).alias("all_docs"), F.sum("b_tokens").over(everything).alias("all_tokens"))
    out = counts.withColumn("w_docs", F.sum("n_docs").over(within)).withColumn("w_tokens", F.sum("tokens").over(within)).join(blocks, "block")
    docs, tokens = F.col("w_docs") + F.col("a_docs"), F.col("w_tokens") + F.col("a_tokens")
    return out.select(
        "length", "n_docs", docs.alias("docs_at_least"), tokens.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens + F.col("length") * docs).alias("truncated_total"),
        ((F.col("all_docs") - docs + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def totals(histogram: DataFrame, limits: DataFrame) -> DataFrame:
    """For each ``context`` of ``limits``: documents that exceed it and tokens kept when texts are cut there.

    The histogram row that answers a limit is that of the smallest length above it: the last one before the limit if both stand in one
    falling order. One task sorts them; there are no more rows than lengths (the longest document's at most) and limits.
    """
    none = F.lit(None).cast("bigint")
    rows = histogram.select(F.col("length").alias("at"), F.lit(1).alias("kind"), none.alias("context"), "docs_at_least", "tokens_at_least")
    asked = limits.select("context").distinct().select(F.col("context").alias("at"), F.lit(0).alias("kind"), "context", none.alias("docs_at_least"), none.alias("tokens_at_least"))
    falling = Window.orderBy(F.desc("at"), "kind")
    before, everything = falling.rowsBetween(Window.unboundedPreceding, 0), falling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = lambda c, w: F.coalesce(F.max(c).over(w), F.lit(0))  # noqa: E731  they rise as lengths fall
    out = rows.unionByName(asked).select("kind", "context", last("docs_at_least", before).alias("over"), last("tokens_at_least", before).alias("above"), last("tokens_at_least", everything).alias("t"))
    return out.where("kind = 0").select("context", F.col("over").alias("docs_cut"), F.expr("t - above + context * over").alias("tokens_kept"))
