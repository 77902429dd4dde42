"""N-gram Jaccard join: exact components of documents whose shingle sets have a Jaccard similarity of 0.85 or more.

A document is the set of its 4-word shingles (64-bit hashes; with fewer words the whole sequence is one shingle). Shingle
length and similarity are parameters of ``join``, from which all bounds follow; figures here are those of 4 words and 0.85.
Documents with one set are one node. Two sets of sizes a and b that link differ in at most
H = floor(15 (a + b) / 185) shingles.

Candidates (universe partition, pigeonhole). Sizes are split into bands so that a set can only link within its own band
or a neighbouring one. Each band has a scheme that hashes the universe of shingles into segments; a set takes part in its
own scheme and, if a partner there is possible, in the next one. A segment is allotted a share v of the error
budget by what it costs to index, the shares adding up to more than H, so that in one segment two linked sets differ by less
than v:

* v = 2 in bands with H <= ``SMALL``: few, large segments; each is indexed with its one-deletion neighbourhood (the segment and
  the segment less each of its shingles), which costs a row for each shingle but is selective where sets are small.
* v = 1 in larger bands: H + 1 and some spare segments, indexed as they are.
* v = 0 for an empty segment, which half the corpus may share. If the other segments of a set don't add up to H + 1 it
  indexes its empty ones after all. A pair is found by either set that has enough without them; if neither has, both index them.

Bounds. A shingle that no other candidate has can't be shared, so with u such shingles a set of n links only with
sets of at most (n - u) * 185 / 85 - n shingles (and not at all if u > 0.15 n). This drops documents that share a common
passage, and copies with too many edits, before any pair is formed. And each set has a sketch of ``SKETCH`` parities: bit i tells
whether it has an odd number of the shingles that hash to i. Two sets differ in at least as many shingles as their sketches
in bits, so a pair whose sketches differ in more than H bits isn't formed.

Identity. A node is known by a 64-bit hash of its set, beside which each row carries a second one. Hashes that two different sets
share are looked for in all rows and remade from both (``_sets``), so a node is never two sets, as far as 128 bits tell.

Verification. Each node is first compared with the most central member it meets (the one that meets most others), so
groups of near copies fall together in a star. Then only pairs are left that share a segment, are within each other's
bounds and aren't connected yet; all of them are compared by their whole sets, word by word and not by hash. No pair is formed
within what is connected.

Edge cases: null and empty texts, and texts without a word, have no shingles and link with nothing; repeated rows and ties are
connected; a very long text is one set and is compared whole; a null doc_id is never a component's id (unless all ids of the component are null) but connects others; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.arrowtext import chunks, lower_ascii, mix, utf8, window_hashes, words
from quire.llm.components import components
from quire.llm.tables import release, remove, settle, text_key

K, PERCENT, SMALL, SKETCH, PIECE = 4, 85, 3, 1024, 1 << 20
#: Parts that the shingles of the candidates are counted in, one after the other, so that the disk holds one of them.
TURNS = 2
_SALT = np.uint64(0xA0761D6478BD642F)


def budget(a, b, percent: int = PERCENT):
    return (100 - percent) * (a + b) // (100 + percent)


class Bands:
    """Size bands: band k holds the sizes first[k] .. first[k + 1] - 1; a set of size n links with sizes up to n * 100 / percent."""

    def __init__(self, percent: int = PERCENT, largest: int = 1 << 40):
        self.percent = percent
        first = [1]
        while first[-1] <= largest:
            first.append(first[-1] * 100 // percent + 1)
        self.first = np.array([*first, first[-1] * 100 // percent + 1], np.int64)
        errors = budget(self.first[1:] - 1, self.first[1:] - 1, percent)
        # one-deletion segments have a share of 2; others need H + 1 and spare ones, as some are empty
        self.small = errors <= SMALL
        self.segments = np.where(self.small, errors // 2 + 1, errors + 1 + np.ceil(0.08 * (errors + 1)).astype(np.int64) + 2)
        self.silent = errors == 0  # sets that link are equal


BANDS = Bands()


def shingles(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text, sorted, and n + 1 offsets."""
    buf, off = utf8(texts)
    buf = lower_ascii(buf)
    w = words(buf, off)
    h = w.hashes(buf)
    grams = window_hashes(h, k)
    sets = []
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        sets.append(np.unique(grams[a : b - k + 1]) if b - a >= k else window_hashes(h[a:b], b - a) if b > a else grams[:0])
    first = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=first[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def signatures(flat: np.ndarray, first: np.ndarray, bands: Bands = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """(document, signature) rows of the sets."""
    n = np.diff(first)
    band = np.searchsorted(bands.first, n, side="right") - 1
    docs, sigs = [], []
    value = mix(flat + _SALT)
    for up in (0, 1):
        scheme = np.maximum(band + up, 0)
        top = np.minimum(bands.first[scheme + 1] - 1, n * 100 // bands.percent)
        use = (n > 0) & ~bands.silent[scheme]
        if up:
            use &= n * 100 // bands.percent >= bands.first[scheme]
        m = np.where(use, bands.segments[scheme], 0)
        base = np.zeros(len(n) + 1, np.int64)
        np.cumsum(m, out=base[1:])
        if not base[-1]:
            continue
        owner = np.repeat(np.arange(len(n)), m)
        place = np.arange(base[-1]) - base[owner]
        name = mix((scheme[owner].astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) + _SALT)
        doc = np.repeat(np.arange(len(n)), n)
        mine = use[doc]
        doc, v, f = doc[mine], value[mine], flat[mine]
        # the segment of a shingle: a hash of it and the scheme, scaled to the number of segments
        which = base[doc] + ((mix(f ^ mix(scheme[doc].astype(np.uint64) + np.uint64(1))) >> np.uint64(32)) * m[doc].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        content = np.zeros(base[-1], np.uint64)
        np.add.at(content, which, v)
        filled = np.bincount(which, minlength=base[-1]) > 0
        need = budget(n, top, bands.percent) + 1
        enough = np.bincount(owner[filled], minlength=len(n)) >= need
        small = bands.small[scheme]
        keep = filled | small[owner] | ~enough[owner]
        docs.append(owner[keep])
        sigs.append(mix(content + name)[keep])
        less = small[doc]
        docs.append(doc[less])
        sigs.append(mix(content[which[less]] - v[less] + name[which[less]]))
    if not docs:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(docs), np.concatenate(sigs)


def sketches(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SKETCH parity bits of each set as 64-bit words."""
    n = len(first) - 1
    bit = (mix(flat ^ _SALT) >> np.uint64(32)) % np.uint64(SKETCH)
    at = np.repeat(np.arange(n) * SKETCH, np.diff(first)) + bit.astype(np.int64)
    odd = (np.bincount(at, minlength=n * SKETCH) & 1).astype(np.uint8).reshape(n, SKETCH)
    return np.packbits(odd, axis=1).view(np.int64)


def exact_shingles(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """As ``shingles``, but by numbers that are equal only for equal words; they hold within one call.

    Numbers of 2^j words come from sorting pairs of numbers of half as many; k words are two such runs that overlap.
    """
    buf, off = utf8(texts)
    buf = lower_ascii(buf)
    w = words(buf, off)
    own = w.codes(buf)[0].astype(np.uint64)

    def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique((a << np.uint64(32)) | b, return_inverse=True)[1].astype(np.uint64)

    size = 1
    while size < k and len(own):
        step = min(size, k - size)
        own = paired(own[:-step], own[step:]) if len(own) > step else own[:0]
        size += step
    sets = [np.unique(own[a : b - k + 1]) if b - a >= k else own[:0] for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)]
    first = np.zeros(len(sets) + 1, np.int64)
    np.cumsum([len(x) for x in sets], out=first[1:])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), first


def _sets(batches: Iterator[pa.RecordBatch], k: int, bands: Bands, twins: list[int]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, k1, k2, text) to (doc_id, k1, k2, n, node, second, sketch, signatures); a node's sketch and signatures stand once
    in a task. ``twins``: hashes that different sets share."""
    done: set = set()
    for part in chunks(batches, "text", PIECE // 2):
        flat, first = shingles(part.column(3), k)
        n = np.diff(first)
        node = mix(sums(mix(flat), first) + n.astype(np.uint64))
        second = mix(sums(mix(flat ^ _SALT), first) + n.astype(np.uint64))
        if twins:
            node = np.where(np.isin(node.view(np.int64), twins), mix(node ^ mix(second)), node)
        node, second = node.view(np.int64), second.view(np.int64)
        docs, sigs = signatures(flat, first, bands)
        fresh = np.zeros(len(n), bool)
        for d, x in enumerate(node.tolist()):
            if n[d] and x not in done:
                done.add(x)
                fresh[d] = True
        keep = fresh[docs]
        docs, sigs = docs[keep], sigs[keep]
        order = np.argsort(docs, kind="stable")
        off = np.zeros(len(n) + 1, np.int64)
        np.cumsum(np.bincount(docs, minlength=len(n)), out=off[1:])
        lists = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(sigs[order].view(np.int64)))
        each = SKETCH // 64
        odd = sketches(flat, first)[off[1:] > off[:-1]]
        odd = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(off[1:] > off[:-1])]).astype(np.int32) * np.int32(each)), pa.array(odd.ravel()))
        yield pa.record_batch([*part.columns[:3], pa.array(n), pa.array(node), pa.array(second), odd, lists], ["doc_id", "k1", "k2", "n", "node", "second", "odd", "sigs"])


def _all_sets(keyed: DataFrame, k: int, bands: Bands) -> DataFrame:
    """The settled sets, no two of which share a node's hash.

    Of N different sets some N^2 / 2^65 pairs share one by chance: below one for 5 billion, and some hundred for 60 billion.
    """
    kind = keyed.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, k1 bigint, k2 bigint, n bigint, node bigint, second bigint, odd array<bigint>, sigs array<bigint>"
    twins: list[int] = []
    while True:
        known = list(twins)
        sets = settle(keyed.mapInArrow(lambda batches, known=known: _sets(batches, k, bands, known), schema))
        shared = sets.where("n > 0").groupBy("node").agg(F.min("second").alias("x"), F.max("second").alias("y")).where("x < y")
        more = [r.node for r in shared.select("node").collect()]
        if not more:
            return sets
        remove(keyed.sparkSession, sets)
        twins += more


def _rows(batches: Iterator[pa.RecordBatch], k: int, turn: int) -> Iterator[pa.RecordBatch]:
    """(node, text) to (shingle, node), of the shingles whose turn it is."""
    for part in chunks(batches, "text", PIECE // 2):
        flat, first = shingles(part.column(1), k)
        node = np.repeat(part.column(0).to_numpy(), np.diff(first))
        own = flat % np.uint64(TURNS) == turn
        yield pa.record_batch([pa.array(flat[own].view(np.int64)), pa.array(node[own])], ["shingle", "node"])


def _compare(batches: Iterator[pa.RecordBatch], k: int, percent: int) -> Iterator[pa.RecordBatch]:
    """(a, b, text_a, text_b) to the pairs (a, b) that link. Texts of fewer than k words link with equal ones alone, which are one node."""
    for part in chunks(batches, "text_a", PIECE // 2):
        for one in chunks([part], "text_b", PIECE // 2):
            # the same text often stands in many rows, one after the other
            coded = pa.chunked_array([one.column(2), one.column(3)]).combine_chunks().dictionary_encode()
            flat, off = exact_shingles(coded.dictionary, k)
            at = coded.indices.to_numpy()
            keep = []
            for i, j in zip(at[: one.num_rows].tolist(), at[one.num_rows :].tolist(), strict=True):
                x, y = flat[off[i] : off[i + 1]], flat[off[j] : off[j + 1]]
                both = np.concatenate([x, y])
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(common > 0 and 100 * common >= percent * (len(both) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.record_batch([one.column(0).filter(mask), one.column(1).filter(mask)], ["a", "b"])


def _verify(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    left = pairs.hint("merge").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a")
    both = left.hint("merge").join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(lambda batches: _compare(batches, k, percent), "a bigint, b bigint")


def join(documents: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of ``documents`` (doc_id, text): k-word shingles, a Jaccard similarity of ``percent`` / 100."""
    bands = Bands(percent)
    spark = documents.sparkSession
    keyed = documents.select("doc_id", *text_key(), F.coalesce("text", F.lit("")).alias("text"))
    sets = _all_sets(keyed, k, bands)
    docs = settle(sets.select("doc_id", "k1", "k2", "n", "node"))

    # buckets with two nodes or more
    rows = sets.select("node", F.explode("sigs").alias("sig"))
    bucket = Window.partitionBy("sig")
    rows = rows.withColumn("low", F.min("node").over(bucket)).withColumn("high", F.max("node").over(bucket)).where("low < high")
    met = settle(rows.select("sig", "node"))
    odd = sets.where(F.size("odd") > 0).select("node", "odd").join(met.select("node").distinct(), "node").dropDuplicates(["node"])
    odd = settle(odd)
    remove(spark, sets)
    release(spark)
    nodes = met.select("node").distinct()
    found = docs.where("n > 0").groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"), F.max("n").alias("n"))
    found = found.join(nodes, "node").select("node", "n", "k.k1", "k.k2")
    # sides that grow with the corpus are never broadcast (hint merge), so plans are the same at every size
    texts = keyed.select("k1", "k2", "text").join(found.select("node", "k1", "k2").hint("merge"), ["k1", "k2"]).dropDuplicates(["node"]).select("node", "text")
    texts = settle(texts)
    release(spark)

    # u: the shingles of a node that no other candidate has
    parts = []
    for turn in range(TURNS):
        held = texts.mapInArrow(lambda batches, turn=turn: _rows(batches, k, turn), "shingle bigint, node bigint").groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("other"))
        parts.append(settle(held.where("node = other").groupBy("node").agg(F.count("*").alias("u"))))
        release(spark)
    alone = reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("u").alias("u"))
    sized = found.select("node", "n").join(alone, "node", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    # the largest partner: (100 + percent) (n - u) >= percent (n + m)
    sized = sized.select("node", "n", F.floor(((100 + percent) * (F.col("n") - F.col("u")) - percent * F.col("n")) / percent).alias("most")).where(100 * F.col("most") >= percent * F.col("n"))
    sized = settle(sized)
    met2 = met.join(sized, "node").withColumn("size", F.count("*").over(bucket)).where("size > 1")
    met2 = settle(met2)
    remove(spark, met, sized, *parts)
    release(spark)

    # the most central member of each bucket; each node meets the most central of those
    weight = met2.groupBy("node").agg(F.sum("size").alias("weight"))
    weighed = settle(met2.join(weight, "node").select("sig", "node", "n", "most", "weight"))
    heads = weighed.groupBy("sig").agg(F.max(F.struct("weight", "node", "n", "most")).alias("h"))
    star = weighed.join(heads, "sig").where("node <> h.node and n <= h.most and h.n <= most")
    star = star.groupBy("node").agg(F.max("h").alias("h")).select(F.col("node").alias("a"), F.col("h.node").alias("b"))
    edges = settle(_verify(star, texts, k, percent))
    remove(spark, met2)
    release(spark)

    labels = components(edges)
    named = settle(weighed.join(labels, "node", "left").select("sig", "node", "n", "most", F.coalesce("label", "node").alias("label")))
    mixed = named.groupBy("sig").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x < y").select("sig")
    known = settle(named.join(mixed.hint("merge"), "sig").join(odd.hint("merge"), "node"))
    remove(spark, weighed, named, odd)
    release(spark)
    counts = known.groupBy("sig", "label").agg(F.count("*").alias("c")).groupBy("sig").agg(F.max(F.struct("c", "label"))["label"].alias("main"))
    minor = known.join(counts, "sig").select("sig", "main", F.col("node").alias("a"), F.col("n").alias("na"), F.col("most").alias("ma"), F.col("label").alias("la"), F.col("odd").alias("oa")).where("la <> main")
    other = known.select("sig", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("most").alias("mb"), F.col("label").alias("lb"), F.col("odd").alias("ob"))
    differ = sum((F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(1, SKETCH // 64)), F.bit_count(F.col("oa")[0].bitwiseXOR(F.col("ob")[0])))
    # of two rows outside the main label one order is enough
    near = F.expr("la <> lb and na <= mb and nb <= ma and (lb = main or a < b)") & ((100 + percent) * differ <= (100 - percent) * (F.col("na") + F.col("nb")))
    rest = minor.join(other, "sig").where(near).select("a", "b").distinct()
    more = settle(_verify(rest, texts, k, percent))
    labels = components(edges.unionByName(more))
    remove(spark, known, texts, edges, more)
    release(spark)

    out = docs.join(labels, "node", "left").select("doc_id", "n", F.coalesce("label", "node").alias("label"))
    some = out.where("n > 0")
    least = some.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = some.join(least, "label").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(out.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
