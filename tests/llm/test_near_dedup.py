"""Near duplicates against brute force, and components against union-find."""

import itertools
import random
import re

import pytest

from crawlscore.llm import near_dedup as nd
from crawlscore.llm.components import components

SCHEMA = "doc_id bigint, text string, node int, kept string, band string"


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[k:k + width]) for k in range(len(words) - width + 1)}


def brute(rows, width=5, percent=80):
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [(i, shingles(t, width)) for i, t in rows]
    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and (i == j or 100 * len(a & b) >= percent * len(a | b)):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets}


def corpus(seed):
    """Base texts, copies with more and more changed words, and a passage that many texts share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))
    passage = [word() for _ in range(40)]
    texts = ["", None, " ", "One", "one", "one two", "ONE two", "é É", "é é"]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(30, 120))]
        for _ in range(rng.randint(1, 12)):
            copy = base[:]
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
        texts.append(" ".join(base[:20] + passage + base[20:]))
    texts.append(" ".join(word() for _ in range(30_000)))
    texts += rng.sample(texts, 10)
    rng.shuffle(texts)
    return list(enumerate(texts, 100))


@pytest.mark.parametrize("seed, width", [(1, 5), (2, 4)])
def test_components_equal_brute_force(spark, seed, width):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1, "k", "b") for i, t in rows], SCHEMA).repartition(5)
    got = {(r.key, r.n_shingles, r.component_id) for r in nd.linked(docs, width=width).collect()}
    assert got == brute(rows, width)


def test_hot_group_with_chains(spark):
    """Texts that differ more and more along a chain are one component; a far relative is not."""
    words = [f"w{k}" for k in range(200)]
    rows = []
    for i in range(60):
        rows.append((i, " ".join([f"x{k}" if k < i else w for k, w in enumerate(words)])))
    rows += [(1000 + i, " ".join(words[:150] + [f"y{i}_{k}" for k in range(50)])) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {(r.key, r.n_shingles, r.component_id) for r in nd.linked(docs).collect()} == brute(rows)


def test_deduplicated_keeps_one_of_each_group(spark):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 1, "k", "b") for i, t in rows] + [(rows[0][0], rows[0][1], 1, "k", "b")] * 3
                                 + [(None, "one two three", 1, "k", "b")] * 2, SCHEMA)
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(None) == 2
    assert sorted(i for i in ids if i is not None) == sorted({c for _, _, c in brute(rows)})
    assert nd.deduplicated(docs.limit(0)).count() == 0


def test_of_rows_with_one_id_the_same_one_stays(spark):
    rows = [(7, f"text {k} of an id that {k} rows share") for k in range(20)] + [(7, None), (8, "another text of another id")]
    found = set()
    for k in (1, 5):
        docs = spark.createDataFrame(rows[k:] + rows[:k], "doc_id bigint, text string").repartition(k)
        found.add(tuple(sorted((r.doc_id, r.text or "") for r in nd.deduplicated(docs).collect())))
    assert len(found) == 1 and [i for i, _ in found.pop()] == [7, 8]


def test_empty_and_very_long_texts(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert nd.linked(empty).columns == ["key", "n_shingles", "component_id", "kept"] and nd.linked(empty).count() == 0
    long = " ".join(f"w{k}" for k in range(300_000))
    rows = [(4, long), (2, long + " end"), (3, "z" * 2_000_000), (1, None), (5, "")]
    got = {r.key: (r.n_shingles, r.component_id, r.kept) for r in
           nd.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {4: (299_996, 2, False), 2: (299_997, 2, True), 3: (1, 3, True), 1: (0, 1, True), 5: (0, 5, True)}


def test_rows_with_one_id_are_one_document(spark):
    texts = ["alpha beta gamma delta epsilon zeta", "eta theta iota kappa lambda mu"]
    rows = [(7, texts[0]), (7, texts[1]), (9, texts[0]), (3, texts[1])]
    got = {r.component_id for r in nd.linked(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == {3}


def test_sketch_estimates_similarity():
    import numpy as np

    rng = np.random.default_rng(0)
    for share in (0.8, 0.9, 0.3):
        both = rng.integers(0, 2**63, int(1000 * share), dtype=np.uint64)
        rest = rng.integers(0, 2**63, 1000 - len(both), dtype=np.uint64)
        a, b = np.concatenate((both, rest[::2])), np.concatenate((both, rest[1::2]))
        sketches = nd.odd_sketches(nd.signatures([a, b])).view(np.uint64)
        bits = sum(int(x).bit_count() for x in sketches[0] ^ sketches[1])
        assert (bits <= nd.SKETCH_LIMIT) == (share >= 0.8)


def test_contraction_equals_union_find(spark):
    rng = random.Random(5)
    pairs = [(i, i + 1) for i in range(300, 420)] + [(0, k) for k in range(1, 80)]
    pairs += [(rng.randrange(500, 900), rng.randrange(500, 900)) for _ in range(250)] + [(5, 5), (1, 0)]
    rng.shuffle(pairs)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {(r.node, r.label) for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {(x, find(x)) for x in parent}
