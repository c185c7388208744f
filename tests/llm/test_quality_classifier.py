"""The quality classifier against plain Python: ratios, bins, rates, pseudo counts, posteriors and decisions."""

import math
import os
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from crawlscore.llm import quality_classifier as qc
from crawlscore.llm import queries
from crawlscore.llm.quality_rules import STOP_WORDS

DATA = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"
DOCS = "doc_id bigint, text string, source string, lang string"


def bins(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    n, chars = max(len(words), 1), sum(map(len, words))

    def count(characters):
        return sum(c in characters for c in text)

    ratios = {
        "symbols_per_word": count("#*$%&|<>") / n,
        "marks_per_word": count("!") / n,
        "capitals_per_char": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / max(chars, 1),
        "duplicate_line_share": (len(lines) - len(set(lines))) / max(len(lines), 1),
        "mean_word_chars": chars / n,
        "stop_word_share": sum(w in STOP_WORDS for w in words) / n,
        "distinct_word_share": len(set(words)) / n,
        "same_word_again_share": sum(a == b for a, b in zip(words, words[1:])) / n,
        "words": len(words),
    }
    return [sum(ratios[name] >= edge for edge in edges) for name, edges in qc.EDGES.items()]


def half_up(x):
    return math.floor(x + 0.5)


def logistic(x):
    return 1 / (1 + math.exp(-x))


def pseudo_count(groups):
    """`groups` holds (n, s in millionths, parent's rate)."""
    total, good = sum(n for n, _, _ in groups), sum(s for _, s, _ in groups) / 1e6
    mean = min(max(good / total, 1e-6), 1 - 1e-6)
    chance = mean * (1 - mean)
    spread = sum(n * (s / 1e6 / n - to) ** 2 for n, s, to in groups)
    between = (spread - (len(groups) - 1) * chance) / max(total - sum(n * n for n, _, _ in groups) / total, 1.0)
    return round(min(max(chance / between - 1 if between > 0 else 1e6, 1.0), 1e6), 3)


def brute(rows, weights, prior):
    """(doc_id, evidence, host_rate, path_rate, posterior) of each row."""
    evidence = [sum(table[b] for table, b in zip(weights, bins(text))) for _, text, _, _ in rows]
    alone = [half_up(logistic(e + math.log(prior / (1 - prior))) * 1e6) for e in evidence]
    paths, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for (_, _, host, path), s in zip(rows, alone):
        for group in (paths[host, path], hosts[host]):
            group[0] += 1
            group[1] += s
    world = sum(alone) / 1e6 / len(rows)
    strength = pseudo_count([(n, s, world) for n, s in hosts.values()])
    host_rate = {h: (s / 1e6 + strength * world) / (n + strength) for h, (n, s) in hosts.items()}
    below = pseudo_count([(n, s, host_rate[h]) for (h, _), (n, s) in paths.items()])
    out = []
    for (doc, _, host, path), e, s in zip(rows, evidence, alone):
        n, total = paths[host, path]
        rate = ((total - s) / 1e6 + below * host_rate[host]) / (n - 1 + below)
        rate = min(max(rate, 1e-6), 1 - 1e-6)
        out.append((doc, e, host_rate[host], rate, logistic(e + math.log(rate / (1 - rate)))))
    return out


def fitted(spark, rows, labels):
    """Weights and prior; the weights are where the penalised likelihood has no slope."""
    features = spark.createDataFrame([(i, bins(t)) for i, t, _, _ in rows], "key bigint, bins array<int>")
    table = spark.createDataFrame(labels, "doc_id bigint, quality int")
    found = qc.fit(features, table, "doc_id", "quality")
    means = defaultdict(list)
    for i, y in labels:
        if i is not None and y is not None:
            means[i].append(y)
    known = [(i, b, sum(means[i]) / len(means[i])) for i, b in ((i, bins(t)) for i, t, _, _ in rows) if i in means]
    prior = (sum(half_up(y * 1e6) for _, _, y in known) / 1e6 + 1) / (len(known) + 2)
    assert found.good == pytest.approx(prior, abs=1e-9)
    slope = [qc.PENALTY * np.array(w) for w in found.ratios]
    for _, b, y in {(i, tuple(b), y) for i, b, y in known}:
        p = logistic(sum(w[k] for w, k in zip(found.ratios, b)) + math.log(prior / (1 - prior)))
        for own, k in zip(slope, b):
            own[k] += p - y
    assert max(np.abs(own).max() for own in slope) < 1e-3
    return found.ratios, found.good


def compared(got, want):
    def key(row):
        return row[0] is not None, row[0] or 0, [round(x, 3) for x in row[1:]]

    got = sorted(((r.doc_id, r.evidence, r.host_rate, r.path_rate, r.posterior, r.kept) for r in got), key=lambda r: key(r[:5]))
    want = sorted(want, key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        assert g[0] == w[0] and g[1:5] == pytest.approx(w[1:], abs=3e-6), (g, w)
        if abs(w[4] - qc.THRESHOLD) > 1e-5:
            assert g[5] == (w[4] >= qc.THRESHOLD)


def test_small_corpus_equals_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "One\n\nOne\n", "the of and to a", "!!! $$$ ***", "é Ä 漢字\x0bx\x0cy\rz", "same same same same"]
    rows = [(900 + k, text, "h1", "p1") for k, text in enumerate(texts)]
    for i in range(260):
        bad = rng.random() < (0.8 if i % 5 == 0 else 0.2)
        words = [rng.choice(["BUY!!!", "$$$", "win", "win", "###x"] if bad else ["the", "river", "of", "North", "slowly", "ran"])
                 for _ in range(rng.randint(1, 80))]
        rows.append((i, rng.choice([" ", "\n"]).join(words), None if i % 5 == 0 else f"h{i % 5}", rng.choice([None, "p1", "p2"])))
    rows += [rows[20]] * 3 + [(None, "no id here", "h2", "p1"), (999, "alone", "seldom", "p9")]
    labels = [(i, int("$" not in (t or "") and "!" not in (t or ""))) for i, t, _, _ in rows[:150]]
    labels += [(3, 0), (3, 1), (4, None), (None, 1), (10**6, 1)]
    docs = spark.createDataFrame(rows, DOCS)
    weights, prior = fitted(spark, rows, labels)
    got = qc.judged(docs, spark.createDataFrame(labels, "doc_id bigint, quality int")).selectExpr("row.doc_id", "* EXCEPT (row)")
    compared(got.collect(), brute(rows, weights, prior))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_query_equals_brute_force(spark):
    def rows_of(name, *columns):
        table = pq.read_table(f"{DATA}/{name}.parquet")
        return list(zip(*[table[c].to_pylist() for c in columns]))

    rows = rows_of("documents", "doc_id", "text", "source", "lang")
    weights, prior = fitted(spark, rows, rows_of("labels", "doc_id", "quality"))
    compared(queries.QUERIES["op6_quality_classifier"](spark, DATA).collect(), brute(rows, weights, prior))
