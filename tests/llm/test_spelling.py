"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter

import pytest

from crawlscore.llm import spelling as sp

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(docs, slip, least):
    counts = Counter()
    for key, text in docs:
        for run in RUN.findall(text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % slip == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += 1
    return counts


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute(counts, times):
    by_word = {w: [v for v in counts if near(w, v)] for w in counts}
    form = {}
    for w, close in by_word.items():
        best = min(close, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= times * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w] or "", root(w), counts[w], len(by_word[w]), counts[form[w]] if form[w] else 0) for w in counts)


def rows(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, r.form_n or 0) for r in df.collect())


def vocabulary(seed, letters, n, longest=9):
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, longest))) for _ in range(n)]
    out = Counter({w: rng.choice([2, 5, 30, 400, 9000]) for w in base})
    for w in base:
        for _ in range(3):
            k, c = rng.randrange(len(w)), rng.choice(letters)
            out[rng.choice([w[:k] + w[k + 1:], w[:k] + c + w[k:], w[:k] + c + w[k + 1:]])] += rng.randint(1, 40)
    return out


@pytest.mark.parametrize("seed, letters, cell, leaf", [
    (1, "abcéÿ", 50_000, 3), (2, "ab", 20, 1), (3, "entràæ÷×", 10, 0), (4, "aeinortslud", 50_000, 0)])
def test_variants_equal_plain_python(spark, monkeypatch, seed, letters, cell, leaf):
    monkeypatch.setattr(sp, "CELL_WORDS", cell)
    monkeypatch.setattr(sp, "CHUNK_ROWS", 100)
    monkeypatch.setattr(sp, "LEAF", leaf)
    counts = vocabulary(seed, letters, 90)
    if seed == 2:
        counts += Counter({"a" * 300 + "b" + "a" * 20: 3, "a" * 321: 40, "a" * 320: 500})
    df = sp.variants(spark.createDataFrame(list(counts.items()), "word string, n bigint"), times=3)
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows(df) == brute(counts, 3)


def test_counts_equal_plain_python(spark, monkeypatch):
    monkeypatch.setattr(sp, "COUNTED", 50)
    rng = random.Random(5)
    words = ["".join(rng.choice("aBcdÉé÷") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    docs = [(k, rng.choice([" ", "-", "中"]).join(rng.choices(words, k=60))) for k in range(60)]
    docs += [(70, None), (71, ""), (72, "1 2 -"), (None, "Éclairages éclairages"), (73, docs[0][1]), (73, docs[0][1]), (74, "Ĳabcdefgĳ" * 3000)]
    own = spark.createDataFrame([(d, t, "w", 1) for d, t in docs], "doc_id bigint, text string, word string, n int")
    got = {r.word: r.n for r in sp.word_counts(own, slip=3, least_letters=3, least_count=2).collect()}
    assert got == {w: n for w, n in counted(docs, 3, 3).items() if n >= 2}


def test_empty_null_and_repeated_words(spark):
    own = spark.createDataFrame([], "doc_id bigint, text string")
    assert sp.variants(sp.word_counts(own)).collect() == []
    df = spark.createDataFrame([("absolute", 50), (None, 4), ("absolut", 2), ("absolut", 1)], "word string, n bigint")
    assert rows(sp.variants(df)) == [("absolut", "absolute", "absolute", 3, 1, 50), ("absolute", "", "absolute", 50, 1, 0)]
    with pytest.raises(Exception, match="runs of A-Z"):
        sp.variants(spark.createDataFrame([("two words", 2)], "word string, n bigint")).collect()
