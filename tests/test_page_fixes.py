"""Blocks by page and fixes by site, on literal pages."""

import pytest
from pyspark.sql import functions as F

from crawlscore.plans import audit, evidence
from crawlscore.plans import page_fixes as pf
from crawlscore.sources import html
from crawlscore.sources import pages as pg

SCHEMA = ("audit_id string, page_key struct<depth:int,length:int,id:bigint>, url string, final_url string, status_code int, "
          "headers map<string,string>, text string")


def page(number, head, body, title="A title"):
    url = f"https://a.test/{number or ''}"
    text = f"<!doctype html><html lang='en'><head><title>{title}</title>{head}</head><body>{body}</body></html>"
    return ("a", (0, number, number), url, url, 200, {"content-type": "text/html"}, text)


@pytest.fixture(scope="module")
def inputs(spark):
    full = ("<meta charset='utf-8'><meta name='viewport' content='x'><meta name='description' content='d'><link rel='canonical' href='https://a.test/1'>"
            "<meta property='og:title' content='t'><meta property='og:description' content='d'><meta property='og:image' content='https://a.test/i.png'>"
            "<meta name='twitter:card' content='summary'>")
    rows = [
        page(0, "<meta charset='utf-8'>", "<h1>Bread</h1><p>Call +44 (020) 7946 0018</p><img src='/img/IMG_0042.jpg' alt='photo'><img src='/ok.png' alt='A mill'>", "Bread | Mill &amp; Sons"),
        page(1, full, "<h1>Bread</h1><h3></h3>"),
        page(2, "<meta property='og:type' content='article'>", "<h2>First</h2><h1>Own</h1>"),
        page(3, full, "<h1>Fine</h1><h2>Too</h2>"),
    ]
    security = spark.createDataFrame([("a", "a.test", False)], "audit_id string, domain string, security_txt boolean").withColumns(
        {"spf": F.lit("v=spf1 -all"), "dmarc": F.lit("p=reject")})
    return audit.AuditInputs(docs=pg.page_docs(spark.createDataFrame(rows, SCHEMA)), security_facts=security, as_of="2031-05-01 00:00:00")


def found(inputs, *checks):
    return inputs.docs.sparkSession.createDataFrame(
        [("a", c, "x", "warn") for c in checks], "audit_id string, check_id string, code string, severity string")


def fixes(inputs, check):
    rows = pf.page_fixes(inputs, found(inputs, check), [check]).collect()
    return {r.page_key.id: (r.problems, r.block) for r in rows}


def test_outlines(inputs):
    got = fixes(inputs, "seo.heading_structure")
    assert got[0][0] == ["repeated"] and got[0][1] == "H1  Bread   <-- also the H1 of another page"
    assert got[1][0] == ["empty", "repeated", "notes"]
    assert got[1][1] == "H1  Bread   <-- also the H1 of another page\n    H3  (no text)   <-- empty, skips H2"
    assert got[2] == (["late"], "  H2  First\nH1  Own   <-- should come first")
    assert 3 not in got


def test_preview_tags(inputs):
    got = fixes(inputs, "seo.social_tags")
    assert sorted(got) == [0, 2]
    assert got[0][0] == ["og:title", "og:description", "og:image", "twitter:card"]
    assert '<meta property="og:site_name" content="Mill &amp; Sons">' in got[0][1] and '"og:type" content="website"' in got[0][1]
    assert '"og:type" content="article"' in got[2][1]


def test_heads(inputs):
    got = fixes(inputs, "seo.meta_tags")
    assert sorted(got) == [0, 2]
    assert got[0][0] == ["description", "viewport", "canonical"]
    assert '<link rel="canonical" href="https://a.test/">' in got[0][1] and "<title>Bread | Mill &amp; Sons</title>" in got[0][1]


def test_pictures(inputs):
    got = fixes(inputs, "seo.image_seo")
    assert sorted(got) == [0]
    assert got[0][0] == ['alt text "photo" says nothing', "file name tells nothing"]
    assert got[0][1] == '/img/IMG_0042.jpg\n    alt: "photo"\n    mend: alt text "photo" says nothing; file name tells nothing'


def test_only_reported_sites_and_the_first_few(inputs):
    rows = pf.page_fixes(inputs, found(inputs, "seo.heading_structure"))
    assert {r.check_id for r in rows.collect()} == {"seo.heading_structure"}
    assert [r.page_key.id for r in pf.first_fixes(rows, 2).orderBy("fix_ord").collect()] == [0, 1]
    assert pf.page_fixes(inputs, found(inputs, "seo.title")).count() == 0
    with pytest.raises(ValueError):
        pf.page_fixes(inputs, found(inputs, "seo.title"), ["seo.title"])


def test_fixes_of_the_site(inputs):
    checks = ["seo.click_to_call", "best_practices.security_txt", "best_practices.social_proof"]
    rows = evidence.snippets(found(inputs, *checks), inputs).collect()
    code = {r.check_id: r.code for r in rows}
    assert code["seo.click_to_call"].startswith('<a href="tel:+44') and code["seo.click_to_call"].endswith("</a>")
    assert code["best_practices.security_txt"] == "Contact: mailto:security@a.test\nExpires: 2032-12-31T23:59:59Z"
    assert "REPLACE: what the customer said" in code["best_practices.social_proof"]


def test_answers_after_many_siblings():
    text = "<body>" + "".join(f"<h2>Question {i}?</h2><p>Answer {i}.</p>" for i in range(20_000)) + "</body>"
    asked = [e for e in html.parse_html(text)["elements"] if e["question"]]
    assert len(asked) == 20_000 and asked[-1]["answer"] == "Answer 19999."
