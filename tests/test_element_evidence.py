"""Elements on findings, on literal pages."""

import pytest
from pyspark.sql import functions as F

from crawlscore.operators import scoring
from crawlscore.plans import audit
from crawlscore.plans import element_evidence as ee
from crawlscore.sources import pages as pg
from crawlscore.sources import sinks

SCHEMA = ("audit_id string, page_key struct<depth:int,length:int,id:bigint>, url string, final_url string, status_code int, "
          "headers map<string,string>, text string")


def page(audit_id, number, body):
    url = f"https://{audit_id}.test/{number or ''}"
    html = f"<!doctype html><html><head><title>A title</title></head><body>{body}</body></html>"
    return (audit_id, (0, number, number), url, url, 200, {"content-type": "text/html"}, html)


@pytest.fixture(scope="module")
def inputs(spark):
    rows = [
        page("a", 0, "<h1>Bread</h1><h3>Rye</h3><h1>Oven</h1><img src='/raw.png'>"),
        page("a", 1, "<h2>First</h2><h1>BREAD</h1><h1></h1><img src='http://a.test/x.gif'><img alt='' src='data:x'>"
                     "<a href='/gone#top'>Old <b>offer</b></a><a href='/gone'>again</a>"),
        page("a", 2, "<h1>Other</h1><a href='/gone'>later</a><form><input name='q'><input type='submit'></form><a href='/i'></a>"),
        page("b", 0, "<h1>Fine</h1><img src='/a/y.png' alt='A mill at work' width='1' height='1'>"),
    ]
    rendered = [page("a", 0, "<h1>Bread</h1><h3>Rye</h3><p id='x1'><img></p>")]
    probe = spark.createDataFrame([("a",), ("b",)], "audit_id string")
    status = spark.createDataFrame([("a", "internal", "https://a.test/gone", 404), ("a", "internal", "https://a.test/never-linked", 404),
                                    ("a", "external", "https://a.test/gone", 403)], "audit_id string, kind string, url string, status_code int")
    docs = pg.page_docs(spark.createDataFrame(rows, SCHEMA))
    seen = pg.page_docs(spark.createDataFrame(rendered, SCHEMA))
    return audit.AuditInputs(docs=docs, render_docs=seen, site_probe=probe, url_status=status)


def found(inputs, *codes):
    """Findings without running the checks: these (check, code) on both sites."""
    rows = [(a, check, code, "warn", 1, 1) for a in "ab" for check, code in codes]
    return inputs.docs.sparkSession.createDataFrame(
        rows, "audit_id string, check_id string, code string, severity string, check_ord int, finding_ord int")


def labels(inputs, check, code):
    rows = ee.finding_elements(inputs, found(inputs, (check, code)), [check]).orderBy("audit_id", "lead", "page_key", "place").collect()
    return [(r.page_key.id, r.shot.label) for r in rows if r.audit_id == "a"], [r for r in rows if r.audit_id == "b"]


def test_headings(inputs):
    several, none = labels(inputs, "seo.single_h1", "several")
    # the homepage was sent with two main headings; the browser's page shows the one that is left
    assert several == [(0, '<h1> "Bread"'), (1, '<h1> "BREAD"'), (1, "<h1>")] and not none
    skipped, none = labels(inputs, "accessibility.heading_order", "skipped")
    assert skipped == [(0, '<h3> "Rye"')] and not none
    serious, none = labels(inputs, "seo.heading_structure", "serious")
    assert serious == [(0, '<h1> "Bread"'), (1, '<h1> "BREAD"'), (1, "<h1>")] and not none


def test_pictures(inputs):
    assert labels(inputs, "accessibility.image_alt", "missing") == ([(0, "<img>"), (1, '<img src="x.gif">')], [])
    assert labels(inputs, "performance.image_dimensions", "unsized") == ([(0, "<img>"), (1, '<img src="x.gif">')], [])
    assert labels(inputs, "best_practices.mixed_content", "passive") == ([(1, '<img src="x.gif">')], [])
    assert labels(inputs, "seo.image_seo", "bad_alt") == ([(1, '<img src="x.gif">')], [])


def test_controls(inputs):
    assert labels(inputs, "accessibility.form_labels", "unlabelled") == ([(2, '<input name="q">')], [])
    assert labels(inputs, "accessibility.accessible_names", "nameless") == ([(2, '<a href="/i">'), (2, "<input>")], [])


def test_the_first_element_that_points_at_a_broken_address(inputs):
    rows = ee.finding_elements(inputs, found(inputs, ("seo.broken_links", "broken")), list(ee.POINTING)).collect()
    (row,) = rows
    assert (row.lead, row.page_key.id, row.place, row.shot.label) == ("https://a.test/gone", 1, 0, '<a> "Oldoffer"')
    assert (row.shot.match_tag, row.shot.match_attr, row.shot.match_value, row.shot.match_text) == ("a", "href", "/gone#top", "Oldoffer")  # words of an element have its tags' spaces stripped


def test_only_reported_findings_and_the_first_few(inputs):
    findings = found(inputs, ("seo.single_h1", "several"), ("seo.single_h1", "none"))
    rows = ee.finding_elements(inputs, findings, ["seo.single_h1"])
    got = {(r.audit_id, r.code): [s.label for s in r.shots] for r in ee.with_shots(findings, rows, 2).collect()}
    assert got == {("a", "several"): ['<h1> "Bread"', '<h1> "BREAD"'], ("a", "none"): [], ("b", "several"): [], ("b", "none"): []}
    passed = findings.withColumn("severity", F.lit("pass"))
    assert ee.finding_elements(inputs, passed, ["seo.single_h1"]).count() == 0


def test_checks_without_elements_are_refused(inputs):
    with pytest.raises(ValueError):
        ee.finding_elements(inputs, found(inputs, ("seo.title", "none")), ["seo.title"])


def test_real_checks_agree_on_sites_and_pages(inputs):
    checks = ["seo.single_h1", "accessibility.image_alt", "accessibility.form_labels"]
    findings = audit.findings(audit.check_results(inputs, checks))
    rows = ee.finding_elements(inputs, findings, checks).groupBy("audit_id", "check_id", "code").agg(
        F.countDistinct("page_key").alias("pages"))
    affected = {(r.audit_id, r.check_id, r.code): r.affected for r in findings.where("severity <> 'pass'").collect()}
    pages = {(r.audit_id, r.check_id, r.code): r.pages for r in rows.collect()}
    assert pages == {k: n for k, n in affected.items()}


def test_reports_hold_the_first_elements(spark, inputs, tmp_path):
    checks = ["seo.single_h1", "accessibility.image_alt"]
    results = audit.check_results(inputs, checks)
    findings = audit.findings(results)
    shown = ee.with_shots(findings, ee.finding_elements(inputs, findings, checks), 1)
    categories = scoring.category_scores(results)
    path = str(tmp_path / "reports")
    sinks.write_reports(sinks.reports(results, categories, scoring.health_scores(categories), shown=shown), path, "2026-01-01")
    got = {r.audit_id: [(e.check_id, e.code, e.page, e.label) for e in r.elements or []] for r in sinks.read_reports(spark, path).collect()}
    assert got == {"a": [("accessibility.image_alt", "missing", "https://a.test/", "<img>"),
                         ("seo.single_h1", "several", "https://a.test/", '<h1> "Bread"')], "b": []}
