"""The document extraction and the checks on two hand-written sites."""

import json

import pytest
from pyspark.sql import functions as F

from crawlscore.plans import audit
from crawlscore.plans.catalog import catalogue
from crawlscore.sources import pages as pg
from crawlscore.sources.html import parse_html

HEALTHY = """<!doctype html><html lang="en"><head><meta charset="utf-8">
<title>Country Bread and Cakes | Mill Bakery</title>
<meta name="viewport" content="width=device-width, initial-scale=1">
<meta name="description" content="Fresh country bread and cakes, baked every morning in the old mill by the river.">
<link rel="canonical" href="https://mill.test/"><meta name="referrer" content="strict-origin">
<meta property="og:title" content="Mill Bakery"><meta property="og:description" content="Bread">
<meta property="og:image" content="https://mill.test/p.jpg"><meta name="twitter:card" content="summary">
<script src="/jquery-3.7.1.min.js" defer></script>
<script type="application/ld+json">{"@graph":[{"@type":"Bakery","name":"Mill","address":"x","url":"u",
"telephone":"1","openingHoursSpecification":"x","image":"i"},{"@type":"WebSite","name":"Mill","url":"u"}]}</script>
</head><body><header><nav><a href="/about">About</a><a href="tel:+15550100200">Call</a></nav></header>
<main><h1>Bread from the mill</h1><h2>How long does it keep?</h2><p>Three days.</p>
<h2>Do you deliver?</h2><p>Yes, by bike.</p><img src="/oven.jpg" alt="The oven" width="3" height="3">
<form><label for="m">Mail</label><input id="m" type="email"></form>
<a href="https://facebook.com/mill" aria-label="Facebook"></a><a href="/privacy">Privacy</a></main>
<footer>&copy; 2026</footer></body></html>"""

NEGLECTED = """<html><head><meta name="robots" content="noindex"><link rel="stylesheet" href="http://x.test/a.css">
<script src="/jquery-1.12.4.min.js"></script><script src="/lodash-4.17.4.js"></script>
<script type="application/ld+json">{"@type": "Store",}</script></head><body>
<h1>One</h1><h1>Two</h1><h4>Jump</h4><img src="http://x.test/IMG_1.jpg"><a href="/x"><svg></svg></a>
<form><input type="text" placeholder="Name"><button></button></form></body></html>"""


@pytest.fixture(scope="module")
def results(spark):
    rows = [
        ("mill", (0, 1, 1), "https://mill.test/", HEALTHY),
        ("old", (0, 1, 2), "https://old.test/", NEGLECTED),
    ]
    pages = spark.createDataFrame(
        rows, "audit_id string, page_key struct<depth:bigint,length:bigint,id:bigint>, url string, text string")
    headers = F.create_map(F.lit("content-type"), F.lit("text/html; charset=utf-8"))
    pages = pages.withColumns({"final_url": F.col("url"), "status_code": F.lit(200), "headers": headers})
    table = audit.check_results(audit.AuditInputs(docs=pg.page_docs(pages), as_of="2026-06-01 00:00:00"))
    return {(r.audit_id, r.check_id): r for r in table.collect()}


def test_every_check_has_a_result(results):
    assert len(catalogue()) == 69
    assert len(results) == 2 * 69
    for row in results.values():
        assert row.status in ("ran", "skipped")
        assert (row.score is not None) == (row.status == "ran")
        assert row.score is None or 0 <= row.score <= 1
        for finding in row.findings:
            assert finding.severity in ("pass", "info", "warn", "fail") and finding.message


def test_missing_data_is_skipped_not_failed(results):
    for check in ("seo.broken_links", "performance.mobile_speed", "best_practices.tap_targets"):
        assert results["old", check].status == "skipped"
        assert results["old", check].note != "Not applicable to this website."
    assert results["mill", "seo.duplicate_titles"].note == "Not applicable to this website."


HEALTHY_PASSES = [
    "seo.title", "seo.meta_description", "seo.single_h1", "seo.canonical", "seo.indexable",
    "seo.social_tags", "seo.contact_details", "seo.click_to_call", "seo.heading_structure",
    "seo.image_seo", "seo.meta_tags", "best_practices.https", "best_practices.mixed_content",
    "best_practices.outdated_libraries", "best_practices.doctype", "best_practices.viewport",
    "best_practices.privacy_policy", "best_practices.referrer_policy", "accessibility.image_alt",
    "accessibility.html_lang", "accessibility.heading_order", "accessibility.form_labels",
    "accessibility.accessible_names", "performance.image_dimensions", "agentic.structured_data",
    "agentic.landmarks", "agentic.named_controls", "agentic.answer_ready",
    "agentic.business_identity", "agentic.up_to_date",
]


@pytest.mark.parametrize("check", HEALTHY_PASSES)
def test_healthy_page_passes(results, check):
    row = results["mill", check]
    assert row.status == "ran" and [f.severity for f in row.findings] == ["pass"], row


NEGLECTED_FINDS = {
    "seo.title": "fail", "seo.meta_description": "warn", "seo.single_h1": "warn",
    "seo.canonical": "warn", "seo.indexable": "fail", "seo.page_schema": "fail",
    "seo.contact_details": "warn", "seo.image_seo": "warn", "best_practices.mixed_content": "fail",
    "best_practices.outdated_libraries": "fail", "best_practices.doctype": "warn",
    "best_practices.viewport": "fail", "best_practices.privacy_policy": "warn",
    "accessibility.image_alt": "fail", "accessibility.html_lang": "fail",
    "accessibility.heading_order": "warn", "accessibility.form_labels": "fail",
    "accessibility.accessible_names": "warn", "performance.image_dimensions": "warn",
    "performance.render_blocking": "warn", "agentic.structured_data": "warn",
    "agentic.landmarks": "warn", "agentic.named_controls": "warn",
}


@pytest.mark.parametrize("check, severity", NEGLECTED_FINDS.items())
def test_neglected_page_is_found_out(results, check, severity):
    assert results["old", check].findings[0].severity == severity


def test_tree_repairs():
    doc = parse_html("<title>A &amp; B</title><p>x<p>y<ul><li>a<li><img src=1></ul>"
                     "<label>Name <input name=q></label><script>var t = '<a href=/no>';</script>")
    tags = [e["tag"] for e in doc["elements"]]
    assert tags.count("a") == 0 and tags.count("title") == 1
    by_tag = {e["tag"]: e for e in doc["elements"]}
    assert by_tag["title"]["text"] == "A & B" and by_tag["title"]["in_head"]
    assert by_tag["input"]["in_label"]
    assert by_tag["img"]["path"] == "body > ul > li:nth-of-type(2) > img"
    assert "var t" not in doc["visible_text"]


def test_deep_nesting_does_not_break():
    doc = parse_html("<div>" * 3000 + "<summary>Why?</summary><p>" + "<b>" * 3000 + "So.")
    [asked] = [e for e in doc["elements"] if e["question"]]
    assert asked["answer"] == "So."


def test_suggestion_is_complete_json(spark):
    from crawlscore.operators import structured as sd

    html = ('<title>Rye | Mill</title><script type="application/ld+json">{"@context":"https://schema.org",'
            '"@type":"Bakery","name":"Own name","address":""}</script>')
    pages = spark.createDataFrame(
        [("m", (0, 1, 1), "https://mill.test/", html)],
        "audit_id string, page_key struct<depth:bigint,length:bigint,id:bigint>, url string, text string"
    ).withColumns({"final_url": F.col("url"), "status_code": F.lit(200),
                   "headers": F.create_map(F.lit("content-type"), F.lit("text/html"))})
    docs = pg.page_docs(pages)
    row = sd.suggestions(docs).collect()[0]
    body = json.loads(row.block.split("\n")[1])
    own, site = body["@graph"]
    assert row.status == "missing" and row.kind == "home"
    assert own["@type"] == "Bakery" and own["name"] == "Own name"
    assert own["address"]["addressLocality"].startswith("REPLACE")
    assert "@context" not in own
    assert site["@type"] == "WebSite" and site["name"] == "Mill"
