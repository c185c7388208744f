"""Facts of pages: every one of them is in the query's rows, each read from its own place."""

import json
from types import SimpleNamespace

import duckdb
import pytest
from pyspark.sql import functions as F

from crawlscore.sources import pages as pg
from crawlscore.suite import ORACLES, QUERIES, structured

HTML = {
    1: '<title>Bread and more – Mill &amp; Sons</title><h2>Home</h2>',
    2: '<title>x</title><meta property="og:title" content="Rye | The MILL &amp; SONS shop"><meta property="og:image" content="../p.png">'
       '<meta property="article:published_time" content="2024-01-02"><meta property="article:modified_time" content="2024-02-03">'
       '<meta name="author" content=" Ann "><meta property="product:price:amount" content="9"><meta property="product:price:currency" content="EUR">'
       '<time datetime="1999-09-09">then</time><h2>Fresh?</h2><p>Daily.</p><h3>Late?</h3><p>No.</p>',
    3: '<title>Oat - Mill</title><meta property="og:description" content="Oats."><meta property="article:published_time" content=" ">'
       '<time>soon</time><p><time datetime="2023-05-06T07:08">May</time> <time datetime="2024-01-01">later</time></p>',
    4: '<title>Plain</title><time>soon</time>',
}


@pytest.fixture(scope="module")
def facts(spark):
    pages = spark.createDataFrame(
        [("mill.test", (depth := int(k > 1), 1, k), f"https://mill.test/{'a/b/' * depth}{k if depth else ''}", html) for k, html in HTML.items()],
        "audit_id string, page_key struct<depth:bigint,length:bigint,id:bigint>, url string, text string",
    ).withColumns({"final_url": F.col("url"), "status_code": F.lit(200), "headers": F.create_map(F.lit("content-type"), F.lit("text/html"))})
    rows = structured.page_facts(SimpleNamespace(docs=pg.page_docs(pages))).collect()
    assert len(rows) == len(HTML)
    return {r.page_id: r.asDict() for r in rows}


def test_titles_lose_the_name_of_the_site(facts):
    assert {r["site_name"] for r in facts.values()} == {"Mill & Sons"}
    assert {k: r["title"] for k, r in facts.items()} == {1: "Bread and more", 2: "Rye", 3: "Oat - Mill", 4: "Plain"}


def test_all_facts_of_a_page(facts):
    row = facts[2]
    pairs = json.loads(row.pop("question_pairs"))
    assert pairs == [{"question": "Fresh?", "answer": "Daily."}, {"question": "Late?", "answer": "No."}]
    assert row == {
        "page_id": 2, "url": "https://mill.test/a/b/2", "kind": "product", "status": "missing", "site_name": "Mill & Sons", "title": "Rye",
        "description": "", "image": "https://mill.test/a/p.png", "published": "2024-01-02", "modified": "2024-02-03", "author": "Ann",
        "price": "9", "currency": "EUR", "questions": 2}


def test_publication_date_of_the_first_dated_time(facts):
    assert {k: r["published"] for k, r in facts.items()} == {1: "", 2: "2024-01-02", 3: "2023-05-06T07:08", 4: ""}
    assert facts[3]["description"] == "Oats." and facts[4]["question_pairs"] == "[]"


def test_statement_on_dated_and_signed_pages(spark, tmp_path):
    titles = ["Home | Mill", "Rye | The mill", "Oat – Mill", "Bun — MILL", "Pie - Mill - Mill", "Tart · Mill", "Mill", "Jam | Other", "Ham &amp; eggs | Mill"]
    extra = ['<time datetime="2020-01-02">x</time>', '<meta property="article:published_time" content="2021-01-02"><time datetime="1999-01-02">x</time>',
             '<meta name="author" content="Ann"><meta property="article:modified_time" content="2022-01-02">', ""]
    rows = [(n * len(titles) + k, f"https://mill{n % 20}.test/{'a/' * min(k, 2)}{n}-{k}.html",
             f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body>{extra[(n + k) % 4]}<footer></footer></body></html>')
            for n in range(60) for k, title in enumerate(titles)]
    folder = str(tmp_path)
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"{folder}/pages.parquet")
    got = QUERIES["F9"](spark, folder)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet/*.parquet'")
    names = sorted(got.columns)
    found = sorted(repr([r[c] for c in names]) for r in got.collect())
    cursor = duck.execute(ORACLES["F9"])
    have = [d[0] for d in cursor.description]
    assert found == sorted(repr([r[have.index(c)] for c in names]) for r in cursor.fetchall())
    assert len({r.published for r in got.collect()}) == 3 and {"Rye", "Oat", "Bun", "Tart", "Pie - Mill"} <= {r.title for r in got.collect()}
