"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import chat, decontaminate, licences, ngramjoin, pieces, quality, repeats, tokencounts, urlfilter, warc
from quire.llm.tables import table

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op1_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.findings(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    said = F.lit(r"\### Assistant: </turn> ok")
    planted = spark.range(2).select(F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    log = rows.unionByName(planted).select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    out = chat.format_chats(log)
    turns = chat.parse(F.col("formatted"))
    loss = chat.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), ""))
    out = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("bigint").alias("formatted_chars"))
    return out.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("bigint").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.histogram(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rules_table(spark, RULES))


QUERIES = {f.__name__: f for f in (op1_licence_scan, op2_decontaminate, op3_chat_format, op4_suffix_dedup, op5_warc, op6_token_counts, op7_quality_rules, op8_ngram_join, op9_sentencepiece, op10_url_filter)}

_ESCAPED = r"replace(replace(replace({0}, '\', '\b'), '#', '\h'), '</turn>', '<\sturn>')"
_KINDS = licences.sequences(licences.TEMPLATES)
_quoted = lambda grams: "[" + ", ".join(f"'{g}'" for g in grams) + "]"
_NAMED = ", ".join(f"('{name}', {t}, {len(seq)}, {_quoted(sorted(set(seq)))})" for t, (name, seq) in enumerate(_KINDS))
_SIGNS = ", ".join(f"('{g}', {t}, {o})" for g, at in licences.places(_KINDS, 0.8).items() for t, o in at)

ORACLE = {
    "op1_licence_scan": rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT r, doc_id, CAST(unnest(range(1, len(string_split(text, chr(10))) + 1)) AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS segment FROM docs
  UNION ALL SELECT r, doc_id, 0, text FROM docs WHERE contains(text, chr(10))),
worded AS (SELECT r, doc_id, line_no, string_split(trim(regexp_replace(lower(segment), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM lines),
near AS (SELECT * FROM worded WHERE len(list_distinct(w)) <= 1000 AND w[1] <> ''),
grams AS (SELECT r, doc_id, line_no, CASE WHEN len(w) > 1 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) ELSE w END AS g FROM near),
templates(licence, t, size, grams) AS (VALUES {_NAMED}),
signs(g, t, o) AS (VALUES {_SIGNS}),
sized AS (SELECT grams.*, licence, t, templates.grams AS tg FROM grams JOIN templates ON len(g) * 0.6 <= len(templates.grams) AND len(templates.grams) * 0.6 <= len(g)),
scored AS (SELECT r, doc_id, line_no, licence, len(g) AS n_bigrams, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM sized),
whole AS (SELECT r, doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS w FROM docs),
seqs AS (SELECT r, doc_id, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS s FROM whole WHERE len(w) > 1),
spots AS (SELECT r, unnest(range(0, len(s))) AS i, unnest(s) AS g FROM seqs),
starts AS (SELECT DISTINCT r, t, i - o AS start FROM spots JOIN signs USING (g)),
cuts AS (SELECT r, doc_id, t, licence, start, start + size AS stop, templates.grams AS tg, list_distinct(s[greatest(start, 0) + 1 : start + size]) AS g FROM starts JOIN seqs USING (r) JOIN templates USING (t)),
windows AS (SELECT r, doc_id, t, licence, start, stop, len(g) AS n_bigrams, 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) AS dice FROM cuts WHERE 2.0::DOUBLE * len(list_intersect(g, tg)) / (len(g) + len(tg)) >= 0.8)
SELECT doc_id, line_no, NULL::BIGINT AS first_word, licence, CAST(n_bigrams AS BIGINT) AS n_bigrams, round(dice, 6) AS dice FROM scored WHERE dice >= 0.8
QUALIFY row_number() OVER (PARTITION BY r, line_no ORDER BY dice DESC, licence) = 1
UNION ALL SELECT doc_id, NULL, greatest(start, 0), licence, CAST(n_bigrams AS BIGINT), round(dice, 6) FROM windows x
WHERE NOT EXISTS (SELECT 1 FROM windows y WHERE y.r = x.r AND y.start <= x.stop AND x.start <= y.stop
  AND (y.dice > x.dice OR y.dice = x.dice AND (y.licence < x.licence OR y.licence = x.licence AND (y.start < x.start OR y.start = x.start AND y.t < x.t))))""",
    "op3_chat_format": rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(replace({_ESCAPED.format("role")}, ':', '\c')) + length({_ESCAPED.format("text")}) + 14) AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id""",
    "op5_warc": """
WITH hashed AS (SELECT page_id, coalesce(url, '') AS url, sha1(coalesce(html, '')) AS hex, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
firsts AS (SELECT *, min(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM hashed)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, url
FROM firsts""",
    "op8_ngram_join": r"""
WITH RECURSIVE worded AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (SELECT r, doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) END AS s FROM worded),
grams AS (SELECT r, unnest(s) AS g FROM sets),
common AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN sets a ON a.r = x JOIN sets b ON b.r = y WHERE 100 * c >= 85 * (len(a.s) + len(b.s) - c)),
twoway AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached(r, t) AS (SELECT r, r FROM sets UNION SELECT reached.r, twoway.y FROM reached JOIN twoway ON twoway.x = reached.t)
SELECT any_value(a.doc_id) AS doc_id, CAST(any_value(len(a.s)) AS BIGINT) AS n_shingles, min(b.doc_id) AS component_id
FROM reached JOIN sets a ON a.r = reached.r JOIN sets b ON b.r = reached.t GROUP BY reached.r""",
    "op10_url_filter": r"""
WITH cut AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*'), '') AS path FROM cut),
rules(h, p, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path, h || p AS rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC NULLS LAST) = 1""",
}
