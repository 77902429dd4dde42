"""URL filters: longest-match allow and block rules kept as Bloom filter cascades.

A rule is (host, path, action). It fits a url if the url's host is the rule's host or a subdomain of it and the
url's path starts with the rule's path. A url therefore has a small set of candidate keys: each suffix of its
host joined with each prefix of its path that is as long as some rule's path. Which of them are listed is
answered by a cascade of Bloom filters. Level 1 holds the listed keys; level 2 those keys of the corpus that
level 1 takes for listed; level 3 the listed keys that level 2 takes for those; and so on, until a level has no
false positive among the keys it must tell apart. Over the key universe of the corpus it was built on, the
answer is exact, and a lookup needs no join: the filters are literals in the expression.

Two cascades answer a key: one tells listed keys from all others of the corpus, and one, built on the list alone, tells those that
block from those that allow. The corpus's keys are made and written once; each level reads only the keys that the level before
got wrong, written as well.

Size: level 1 gets a false-positive rate of 0.7 * listed / universe, so every level holds no more keys than
about the list has, whatever the corpus; the whole takes about 1.5 * log2(universe / listed) bits a listed key.
Only those bits reach the driver and the tasks, never the corpus's keys, and a level beyond ``MOST_BYTES`` (some tens of millions
of rules) is an error and not a plan that no driver holds. Only DataFrame functions are used.

Of the keys that match, the longest wins (of equal ones, that with the longer host). With no match the verdict
is the method's: a url none of whose keys is listed isn't blocked, so ``allow``.

Edge cases: a null url, or one without ``://``, has an empty host and path and matches nothing; an empty host
has no keys; a very long url is judged whole; repeated urls and null page ids give a row each; rules with a null host are ignored and a null path counts
as empty; of several rules with one key a block wins (ties of length: see above); with no rules every url is allowed; an empty
table gives an empty result; other columns of pages and rules are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.tables import remove, settle

#: Bytes of one level.
MOST_BYTES = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ``://``: host up to ``/ ? #`` with A-Z lowered, then the path up to ``? #``."""
    at = F.instr(url, F.lit("://"))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"(?s)^([^?#]*)", 1)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit("")), F.coalesce(path, F.lit(""))


def keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Candidate keys, longest first: array<struct<size, host_size, key>>."""
    labels = F.split(host, r"\.", -1)
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hosts = F.filter(hosts, lambda h: h != "")
    paths = F.array_distinct(F.array(*[F.substring(path, F.lit(1), F.lit(n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    both = F.flatten(F.transform(hosts, lambda h: F.transform(paths, lambda p: F.struct((F.length(h) + F.length(p)).alias("size"), F.length(h).alias("host_size"), F.concat(h, F.lit("\n"), p).alias("key")))))
    return F.sort_array(F.array_distinct(both), asc=False)


@dataclass
class Level:
    words: list[int]
    bits: int
    hashes: int
    salt: int

    def holds(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        tests = []
        for p in positions(key, self.bits, self.hashes, self.salt):
            tests.append(F.get(words, F.shiftrightunsigned(p, 6).cast("int")).bitwiseAND(bit(p)) != 0)
        return reduce(lambda a, b: a & b, tests)


def bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position.bitwiseAND(F.lit(63).cast("bigint")).cast("int"))


def positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    a, b = F.xxhash64(F.lit(2 * salt), key), F.xxhash64(F.lit(2 * salt + 1), key)
    return [F.pmod(F.pmod(a, F.lit(bits).cast("bigint")) + F.lit(i).cast("bigint") * F.pmod(b, F.lit(bits).cast("bigint")), F.lit(bits).cast("bigint")) for i in range(hashes)]


def level(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of the column ``key`` (n distinct values) as 64-bit words; sized by n alone."""
    bits = max(64, math.ceil(1.4427 * n * math.log2(1 / rate) / 64) * 64)
    hashes = max(1, round(math.log2(1 / rate)))
    if bits > 8 * MOST_BYTES:
        raise ValueError(f"a filter of {n} keys takes {bits // 8} bytes; the bound is {MOST_BYTES}")
    at = keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, salt))).alias("p"))
    got = at.groupBy(F.shiftrightunsigned("p", 6).alias("w")).agg(F.bit_or(bit(F.col("p"))).alias("v")).collect()
    words = [0] * (bits // 64)
    for w, v in got:
        words[w] = v
    return Level(words, bits, hashes, salt)


@dataclass
class Cascade:
    levels: list[Level]

    def holds(self, key: Column) -> Column:
        """Odd depth of the last level that holds the key: listed."""
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels), 0, -1):
            out = F.when(self.levels[depth - 1].holds(key), out).otherwise(F.lit(depth % 2 == 0))
        return out if self.levels else F.lit(False)


def build(listed: DataFrame, universe: DataFrame, most_levels: int = 60) -> Cascade:
    """The cascade that tells the keys of ``listed`` from all others of ``universe`` (both: column ``key``)."""
    spark = listed.sparkSession
    listed = settle(listed.select("key").where("key is not null").distinct())
    n = listed.count()
    if not n:
        return Cascade([])
    others = settle(universe.select("key").distinct().join(listed, "key", "left_anti"))
    total = max(n, others.count())
    rate = min(0.5, 0.7071 * n / total)
    levels: list[Level] = []
    held, against = listed, others
    while True:
        levels.append(level(held, n, rate, len(levels)))
        wrong = settle(against.where(levels[-1].holds(F.col("key"))))
        n = wrong.count()
        remove(spark, against)  # its keys that this level tells are told for good
        if not n:
            remove(spark, held, wrong)
            return Cascade(levels)
        if len(levels) == most_levels:
            raise RuntimeError(f"no cascade within {most_levels} levels")
        held, against, rate = wrong, held, 0.5


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule and verdict by ``rules`` (host, path, action)."""
    rules = rules.where(F.col("host").isNotNull()).select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "action")
    rules = rules.groupBy("host", "path").agg(F.max("action").alias("action"))  # block sorts after allow
    rules = settle(rules.where("action in ('allow', 'block')").withColumn("key", F.concat("host", F.lit("\n"), "path")))
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    host, path = host_and_path(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    universe = parts.select("host", "path").distinct().select(F.explode(keys(F.col("host"), F.col("path"), lengths)["key"]).alias("key"))
    listed = build(rules, universe)
    blocked = build(rules.where("action = 'block'"), rules)
    remove(pages.sparkSession, rules)
    own = keys(F.col("host"), F.col("path"), lengths)
    found = parts.withColumn("found", F.get(F.filter(own, lambda k: listed.holds(k["key"])), F.lit(0)))
    verdict = F.when(F.col("found").isNotNull() & blocked.holds(F.col("found.key")), "block").otherwise("allow")
    return found.select("page_id", "host", "path", F.replace(F.col("found.key"), F.lit("\n"), F.lit("")).alias("rule"), verdict.alias("verdict"))


def rules_table(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    parts = F.explode(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in rows]))
    return spark.range(1).select(parts.alias("r")).select("r.*")
