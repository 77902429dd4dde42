"""Language detection and text statistics as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Common words by language, in the order in which languages are compared.
WORDS = {
    "en": ["the", "be", "to", "of", "and", "a", "in", "that", "have", "i", "it", "for", "not", "on", "with", "he", "as", "you", "do", "at"],
    "fr": ["le", "de", "et", "un", "il", "être", "et", "à", "dans", "ne", "la", "les", "son", "que", "pour", "se", "ce", "d'", "en", "du"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "es": ["el", "de", "que", "y", "a", "en", "un", "es", "se", "no", "te", "lo", "le", "da", "su", "por", "son", "con", "para", "al"],
}
SPACE = r"[\s\x{0085}\p{Z}]+"


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda x: x != "")


def scores(text: Column) -> Column:
    """Share of the words that are common in each language: struct<n, en, fr, de, es> of counts."""
    own = words(F.lower(text))
    clean = F.filter(F.transform(own, lambda x: F.regexp_replace(x, r"[^\p{L}\p{N}]", "")), lambda x: F.octet_length(x) > 1)

    def common(own: list[str]):
        return lambda x: x.isin(own)

    hits = [F.size(F.filter(clean, common(w))).alias(k) for k, w in WORDS.items()]
    return F.struct(F.size(own).alias("n"), *hits)


def detected(s: Column) -> tuple[Column, Column]:
    """Language and confidence of a ``scores`` struct: the first of the greatest; 0.25 + 0.75 * its share of all hits."""
    counts = [s[k] for k in WORDS]
    best, total = F.greatest(*counts), reduce(lambda a, b: a + b, counts)
    name = reduce(lambda rest, k: F.when(s[k] == best, k).otherwise(rest), reversed(WORDS), F.lit("en"))
    confidence = F.when(total == 0, 0.0).otherwise(F.round(0.25 + 0.75 * best / total, 6))
    return name, confidence


def word_count(text: Column) -> Column:
    return F.size(F.filter(words(text), lambda x: x.rlike(r"[\p{L}\p{Nd}]"))).cast("bigint")


def sentence_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}][^.!?\r\n]*(?:[.!?]|\z)")).cast("bigint")


def unique_chars(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def readable(text: Column) -> Column:
    """Three runs of four letters or more, and a fiftieth of the bytes are spaces."""
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return (F.trim(text) != "") & (F.regexp_count(text, F.lit(r"\p{L}{4,}")) >= 3) & (spaces / F.octet_length(text) >= 0.02)
