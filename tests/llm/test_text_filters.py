"""Quality rules, quality classifier and URL filters on small literal tables."""

import re

import pytest
from pyspark.sql import functions as F

from crawlscore.llm import quality_classifier as qc
from crawlscore.llm import quality_rules as qr
from crawlscore.llm import url_filters as uf

DOCS = "doc_id bigint, text string, n_words int, quality string, `row` string"
CLEAN = "the quick fox of the north ran to a river and " * 4 + " ".join(f"word{i} of tale{i}" for i in range(40))


def rows_of(texts):
    return [(i, t, -1, "q", "r") for i, t in enumerate(texts)]


def counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    again = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(again))


TEXTS = [None, "", " \t\n", "a", "a b", "a b c", "a b c a b c", "x x x x", "a b a b a", "p\n\np\n \np", "#* $|a <b>",
         "é ß\x0b漢\x0c字\rend", CLEAN, "*** " * 300, "same line here\n" * 200, "w" * 100_000, "long text " * 20_000]


def test_counts_and_base_rules(spark):
    got = {r.row.doc_id: r.quality for r in qr.judged(spark.createDataFrame(rows_of(TEXTS), DOCS)).collect()}
    for i, text in enumerate(TEXTS):
        q = got[i]
        if len(text or "") < 10_000:
            assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == counts(text), text
        assert q.base_failed == (q.n_words < 50 or 100 * q.n_repeat_words > 50 * q.n_words)
        assert not (q.base_failed and q.kept)
    assert got[TEXTS.index(CLEAN)].kept
    assert got[16].n_repeat_words == got[16].n_words == 40_000


def test_rules_keep_columns_and_repeated_rows(spark):
    docs = spark.createDataFrame(rows_of(TEXTS) + rows_of([CLEAN]) * 2, DOCS)
    kept = qr.keep_good(docs)
    assert kept.columns == docs.columns
    assert [r.text for r in kept.collect()] == [CLEAN] * 3
    assert qr.keep_good(docs.limit(0)).count() == 0


def test_rules_plan_is_native(spark):
    plan = qr.judged(spark.createDataFrame(rows_of([CLEAN]), DOCS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


SITES = "doc_id bigint, text string, source string, lang string, evidence int, kept string"


def corpus(spark, n=240):
    """Two hosts of mostly good and mostly bad documents."""
    rows, labels = [], []
    for i in range(n):
        bad = i % 4 == 0 if i % 2 else i % 8 != 0
        text = " ".join(f"w{i}x{k}%%%" for k in range(30)) if bad else f"{CLEAN} tail{i}"
        rows.append((i, text, "h1" if i % 2 else "h0", f"p{i % 3}", 0, ""))
        labels.append((i, 0 if bad else 1))
    return spark.createDataFrame(rows, SITES), spark.createDataFrame(labels, "doc_id bigint, quality int")


def test_classifier_on_held_out_documents(spark):
    docs, labels = corpus(spark)
    train = labels.where("doc_id % 3 <> 0")
    got = {r.row.doc_id: r for r in qc.judged(docs, train).collect()}
    held = [(r.quality, got[r.doc_id].kept) for r in labels.where("doc_id % 3 = 0").collect()]
    assert sum(bool(q) == k for q, k in held) >= 0.98 * len(held)
    assert min(r.host_rate for r in got.values()) < max(r.host_rate for r in got.values())


def test_sparse_sites_shrink_towards_their_parent(spark):
    docs, labels = corpus(spark)
    lone = spark.createDataFrame([(1000, CLEAN, "seldom", "p", 0, "")], SITES)
    got = {r.row.doc_id: r for r in qc.judged(docs.unionByName(lone), labels).collect()}
    rates = {got[i].host_rate for i in (0, 1)}
    assert min(rates) < got[1000].host_rate < max(rates)


def test_classifier_edge_cases(spark):
    docs, labels = corpus(spark)
    odd = spark.createDataFrame([(2000, None, None, None, 1, "x"), (None, "", "h0", None, 1, "x"), (2001, "z" * 300_000, "h1", "p1", 1, "x")] * 2, SITES)
    both = docs.unionByName(odd)
    mixed = labels.unionByName(spark.createDataFrame([(1, None), (None, 1), (2, 0), (2, 1)], "doc_id bigint, quality int"))
    assert qc.judged(both, mixed).count() == both.count()
    assert qc.keep_good(both, mixed).columns == docs.columns
    assert qc.judged(docs.limit(0), labels).count() == 0
    nothing = qc.judged(docs, labels.limit(0)).agg(F.bool_and("kept"), F.max("evidence")).head()
    assert nothing[0] and nothing[1] == 0
    assert sorted(map(str, qc.judged(both, mixed).collect())) == sorted(map(str, qc.judged(both, mixed).collect()))


URLS = {
    "http://a.NET/x": ("a.net", "/x", "net/", "block"),
    "https://Www.Example.net/en/9?q=/de/": ("www.example.net", "/en/9", "example.net/en/", "allow"),
    "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
    "http://example.com/de/x#y": ("example.com", "/de/x", "example.com/de/", "block"),
    "http://badexample.com/de/x": ("badexample.com", "/de/x", None, "allow"),
    "http://q.org/fr/": ("q.org", "/fr/", "org/fr/", "allow"),
    "http://q.org/fr": ("q.org", "/fr", None, "allow"),
    "http://net": ("net", "", None, "allow"),
    "no scheme.net/": ("", "", None, "allow"),
    "x://a.net/y://b": ("a.net", "/y://b", "net/", "block"),
    "http://u:p@a.net:80/": ("u:p@a.net:80", "/", None, "allow"),
    "http:///en/": ("", "/en/", None, "allow"),
    "http://a.net?x": ("a.net", "", None, "allow"),
    "http://x.net/" + "a/" * 5_000: ("x.net", "/" + "a/" * 5_000, "net/", "block"),
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
}


def test_urls(spark):
    pages = spark.createDataFrame([(i, u, "h", "r", "v") for i, u in enumerate(list(URLS) * 2)],
                                  "page_id bigint, url string, host string, rule string, verdict string")
    found = uf.judged(pages, uf.rule_table(spark))
    got = found.collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == URLS[r.row.url], r.row.url
    assert uf.judged(pages.limit(0), uf.rule_table(spark)).count() == 0
    nobody = uf.judged(pages, uf.rule_table(spark).limit(0), otherwise="block").select("verdict").distinct().collect()
    assert [r.verdict for r in nobody] == ["block"]
    assert "Python" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("rule, fits", [("a/b/", True), ("a/b/c", True), ("a/", True), ("a/b", True), ("a", True), ("a/b/cd", False), ("a/c", False)])
def test_whole_paths_and_folders(spark, rule, fits):
    rules = spark.createDataFrame([(rule[:1], rule[1:], "block"), (rule[:1], rule[1:], "allow")], "host string, path string, verdict string")
    page = spark.createDataFrame([("http://a/b/c",)], "url string")
    found = uf.judged(page, rules, otherwise="none").head()
    assert (found.rule, found.verdict) == ((rule, "allow") if fits else (None, "none"))
