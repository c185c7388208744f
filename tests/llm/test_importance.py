"""Importance resampling against plain Python, checksums against zlib."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from crawlscore.llm import crc, importance as im

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[j:j + n]) for n in (1, 2, 3) for j in range(len(w) - n + 1)]
    return len(w), [zlib.crc32(g.encode()) % 10_000 for g in grams]


def brute(docs, target, percent, least):
    own = [(key, *features(text)) for key, text in docs]
    s, t = Counter(b for _, _, f in own for b in f), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in range(10_000)}
    rows = []
    for key, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((key, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    taken = len(able) * percent // 100
    rank = {}
    for k, r in enumerate(able[:taken], 1):
        rank.setdefault(r, []).append(k)
    return sorted(((*r, rank[r].pop(0) if rank.get(r) else None) for r in rows), key=repr)


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéÜß7") for _ in range(rng.randint(1, 9))) for _ in range(60)] + ["x" * 300, "ñ" * 70]
    texts = [rng.choice([" ", "; ", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 40))) for _ in range(n)]
    docs = [(k, t) for k, t in enumerate(texts)]
    docs += [(9001, None), (9002, ""), (9003, " .,"), (9004, docs[0][1]), (9004, docs[0][1]), (None, docs[1][1]), (None, docs[1][1])]
    docs.append((9005, " ".join(rng.choices(vocabulary, k=20_000))))
    return docs, [" ".join(rng.choices(vocabulary[:20], k=30)) for _ in range(9)] + [None, ""]


def ranked(spark, docs, target, percent=5, least=20):
    own = spark.createDataFrame([(d, t, 1, 2) for d, t in docs], "doc_id bigint, text string, score int, key int")
    rows = im.drawn(im.scored(own, spark.createDataFrame([(x,) for x in target], "text string")), percent, least)
    assert rows.select("row.*").columns == own.columns
    return sorted(((r.row.doc_id, r.n_words, r.n_features, r.weight, r.score, r["rank"]) for r in rows.collect()), key=repr)


@pytest.mark.parametrize("seed, percent, least", [(1, 5, 20), (2, 60, 0), (3, 100, 10)])
def test_ranks_equal_plain_python(spark, seed, percent, least):
    docs, target = corpus(seed)
    assert ranked(spark, docs, target, percent, least) == brute(docs, target, percent, least)


def test_ties_are_cut_by_id_and_place(spark):
    docs = [(7, "same words here")] * 50 + [(None, "same words here")] * 3
    got = ranked(spark, docs, [], 50, 0)
    assert got == brute(docs, [], 50, 0) and sum(r[5] is not None for r in got) == 26


def test_empty_tables(spark):
    assert ranked(spark, [], ["a b"]) == []
    assert ranked(spark, [(1, None)], []) == [(1, 0, 0, 0, brute([(1, None)], [], 5, 20)[0][4], None)]
    own = spark.createDataFrame([(1, "a " * 30), (2, "b")], "doc_id bigint, text string")
    kept = im.resampled(own, spark.createDataFrame([("a a",)], "text string"), percent=100)
    assert kept.columns == own.columns and [r.doc_id for r in kept.collect()] == [1]


@pytest.mark.parametrize("seed", range(3))
def test_joined_checksums(seed):
    rng = random.Random(seed)
    pairs = [(rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 5, 63, 64, 65, 128, 1000, 70_000]))) for _ in range(60)]
    got = crc.joined(*(np.array([zlib.crc32(p[k]) for p in pairs], np.uint32) for k in (0, 1)), np.array([len(b) for _, b in pairs]))
    assert got.tolist() == [zlib.crc32(a + b) for a, b in pairs]
