"""Benchmark windows in documents against brute force."""

import random
import re

import pytest

from crawlscore.llm import decontamination as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window):
    out = []
    for doc_id, text in docs:
        own, hit, found = words(text), set(), set()
        for item, item_text in items:
            w = words(item_text)
            n = min(len(w), window)
            for j in range(len(w) - n + 1 if w else 0):
                for k in range(len(own) - n + 1):
                    if own[k:k + n] == w[j:j + n]:
                        hit |= set(range(k, k + n))
                        if item is not None:
                            found.add(str(item))
        out.append((doc_id, len(own), len(hit), tuple(sorted(found))))
    return sorted(out, key=repr)


def sample(seed):
    rng = random.Random(seed)
    some = lambda n: [rng.choice("a b cd éé Über 7 longerword0123456789x longerword0123456788x".split()) for _ in range(n)]
    items = [(k, " ".join(some(rng.choice([1, 3, 4, 5, 6, 9])))) for k in range(8, 14)]
    items += [(20, None), (21, ""), (22, "., !"), (23, "cd cd"), (23, "7, 7; 7 7 7"), (None, "b b cd cd"), (24, items[0][1].upper())]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(some(rng.randint(0, 60)))) for k in range(40)]
    docs += [(100, None), (101, ""), (102, "-- \x7f"), (103, "Ａ" * 50), (104, docs[0][1]), (104, docs[0][1]), (None, docs[1][1])]
    docs.append((105, " ".join(some(3000))))
    return docs, items


def result(spark, docs, items, window):
    own = spark.createDataFrame([(d, t, "x", "y") for d, t in docs], "doc_id bigint, text string, items string, `row` string")
    found = dc.searched(own, spark.createDataFrame(items, "item_id bigint, text string"), window=window)
    assert found.select("row.*").columns == own.columns
    return found


@pytest.mark.parametrize("seed, window, chunk", [(1, 4, 1 << 20), (2, 5, 40), (3, 2, 1 << 20)])
def test_hits_equal_brute_force(spark, monkeypatch, seed, window, chunk):
    monkeypatch.setattr(dc, "CHUNK_BYTES", chunk)
    docs, items = sample(seed)
    found = result(spark, docs, items, window)
    rows = [(r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in found.collect()]
    assert sorted(rows, key=repr) == brute(docs, items, window)
    assert all(sum(s.after - s.first for s in r.spans) == r.n_hit for r in found.collect())


def test_texts_in_segments(spark, monkeypatch):
    monkeypatch.setattr(dc, "SEGMENT", 3)
    docs, items = sample(4)
    rows = [(r.row.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in result(spark, docs, items, 3).collect()]
    assert sorted(rows, key=repr) == brute(docs, items, 3)


def test_empty_tables_and_survivors(spark):
    docs, items = [(1, "one two three"), (2, "four")], [(7, "Two, three")]
    assert {r.n_hit for r in result(spark, docs, [], 10).collect()} == {0}
    assert result(spark, [], items, 10).collect() == []
    own = spark.createDataFrame(docs, "doc_id bigint, text string")
    kept = dc.decontaminated(own, spark.createDataFrame(items, "item_id bigint, text string"))
    assert kept.columns == own.columns and [tuple(r) for r in kept.collect()] == [(2, "four")]
