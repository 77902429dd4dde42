"""The Jaccard join against a brute-force version."""

import random
import re

from quire.llm import ngramjoin


def brute(rows):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        return {tuple(words[i : i + 4]) for i in range(len(words) - 3)} or ({tuple(words)} if words else set())

    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and sets[j] and 100 * common >= 85 * (len(x) + len(sets[j]) - common):
                parent[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=str)


def corpus(seed, groups=60):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["été", "Ä"]
    rows = [(None, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "a b c d"), (6, "a b c d")]
    passage = [rng.choice(vocabulary) for _ in range(60)]
    doc = 10
    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([5, 8, 12, 20, 30, 60, 150, 400]))]
        if g % 3 == 0:
            base[2:2] = passage
        for _ in range(rng.choice([1, 2, 3, 12])):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
                k = rng.randrange(len(own))
                match rng.randrange(3):
                    case 0:
                        own[k] = rng.choice(vocabulary)
                    case 1:
                        own.insert(k, rng.choice(vocabulary))
                    case _:
                        own[k : k + 1] = own[k : k + 1] if len(own) < 3 else []
            rows.append((doc, rng.choice([" ", "\n"]).join(own)))
            doc += 1
    rng.shuffle(rows)
    return rows


def test_components_match_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        got = ngramjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3))
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert ngramjoin.join(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []


def test_every_linked_pair_shares_a_signature():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in [5, 6, 7, 9, 13, 20, 24, 25, 40, 80, 200, 1000]:
        for _ in range(30):
            a = rng.integers(0, 1 << 62, n, dtype=np.int64).astype(np.uint64)
            gone = int(rng.integers(0, max(1, int(0.15 * n)) + 1))
            b = a[gone:]
            most = 100 * len(b) // 85 - n  # other shingles that the link allows
            if most < 0:
                continue
            more = int(rng.integers(0, most + 1))
            b = np.concatenate([b, rng.integers(0, 1 << 62, more, dtype=np.int64).astype(np.uint64)])
            docs, sigs = ngramjoin.signatures(np.concatenate([a, b]), np.array([0, n, n + len(b)]))
            same = set(sigs[docs == 0].tolist()) & set(sigs[docs == 1].tolist())
            assert same or set(a.tolist()) == set(b.tolist())


def test_other_shingles_and_similarity_match_brute_force(spark):
    rows = corpus(3)
    for k, percent in ((5, 80), (3, 60)):
        got = ngramjoin.join(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3), k=k, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == brute_of(rows, k, percent)


def brute_of(rows, k, percent):
    """As ``brute``, for shingles of k words and a similarity of ``percent`` / 100."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) for _, t in rows]
    sets = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()) for w in words]
    group = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if x and sets[j] and 100 * common >= percent * (len(x) + len(sets[j]) - common) and group[i] != group[j]:
                group = [group[j] if g == group[i] else g for g in group]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [d for (d, _), g in zip(rows, group, strict=True) if g == group[i] and d is not None]
        out.append((doc, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc))
    return sorted(out, key=str)


def test_shared_hashes_are_remade_and_shingles_compared_by_words():
    import pyarrow as pa

    batch = pa.record_batch([pa.array([1, 2, 3]), pa.array([0, 0, 0]), pa.array([1, 2, 1]), pa.array(["a b c d e", "a b c d f", "a b c d e"])], ["doc_id", "k1", "k2", "text"])
    run = lambda twins: next(ngramjoin._sets(iter([batch]), 4, ngramjoin.BANDS, twins)).to_pydict()
    plain = run([])
    assert plain["node"][0] == plain["node"][2] != plain["node"][1]
    again = run([plain["node"][0]])
    assert again["node"][0] == again["node"][2] != plain["node"][0] and again["node"][1] == plain["node"][1] and again["second"] == plain["second"]
    texts = pa.array(["A b c d e f g", "x a b c d e", "a b", None, "", "a B", "a  b c d\ne f g"])
    for k in (1, 2, 3, 4, 5, 7):
        flat, off = ngramjoin.exact_shingles(texts, k)
        sets = [set(flat[a:b].tolist()) for a, b in zip(off[:-1], off[1:], strict=True)]
        words = [(t or "").lower().split() for t in texts.to_pylist()]
        want = [{tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in words]
        assert [[len(x & y) for y in sets] for x in sets] == [[len(x & y) for y in want] for x in want]


def test_long_texts_other_columns_and_repeated_rows(spark):
    rng = random.Random(9)
    words = [f"v{rng.randrange(5000)}" for _ in range(30_000)]
    rows = [(1, " ".join(words), "x", 1), (2, " ".join([*words[:15_000], "other", *words[15_001:]]), "y", 2), (3, " ".join(words[:15_000]), "z", 3), (3, " ".join(words[:15_000]), "z", 3)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, node string, component_id int")
    assert sorted((r.doc_id, r.component_id) for r in ngramjoin.join(table).collect()) == [(1, 1), (2, 1), (3, 3), (3, 3)]
