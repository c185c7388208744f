"""No default caps, any depth, one row per site: cases that need more rows than the given tables have."""

import json

import pytest
from pyspark.sql import functions as F

from crawlscore import session
from crawlscore.functions import jsonld, robots
from crawlscore.operators import linkgraph as lg
from crawlscore.operators import treatment as tr
from crawlscore.plans import audit
from crawlscore.sources import pages as pg
from crawlscore.sources import payloads as pl

LINKS = 5_000


@pytest.fixture(scope="module")
def large_site(spark):
    anchors = "".join(f'<a href="/p{i}">x</a>' for i in range(LINKS))
    html = f"<!doctype html><html><head><title>t</title></head><body>{anchors}</body></html>"
    pages = spark.createDataFrame(
        [("s", (0, 0, 0), "https://s.test/", "https://s.test/", 200, {"content-type": "text/html"}, html)],
        "audit_id string, page_key struct<depth:int,length:int,id:bigint>, url string, final_url string, status_code int, "
        "headers map<string,string>, text string")
    return session.materialise(pg.page_docs(pages), "large-site")


def test_every_link_of_a_large_site_is_found_and_judged(spark, large_site):
    homes = spark.createDataFrame([("s", "https://s.test/", "")], "audit_id string, home_url string, text string").selectExpr(
        "audit_id", "home_url", f"CASE WHEN text <> '' THEN {robots.groups_sql('text')} END AS robots_groups")
    edges = lg.internal_edges(large_site, homes)
    todo = lg.links_to_verify(edges, large_site)
    assert todo.count() == LINKS
    assert lg.links_to_verify(edges, large_site, limit=50).count() == 50
    status = todo.selectExpr("audit_id", "link AS url", "IF(link LIKE '%9', 404, 200) AS status_code")
    assert lg.broken_breakdown(status, edges, "status_code = 404").count() == LINKS // 10
    url_status = status.withColumn("kind", F.lit("internal"))
    able = spark.createDataFrame([("s", "probes", True, None)], "audit_id string, capability string, available boolean, reason string")
    found = audit.check_results(
        audit.AuditInputs(docs=large_site, url_status=url_status, capabilities=able), ["seo.broken_links"])
    row = found.selectExpr("status", "explode(findings) AS f").selectExpr("status", "f.affected").head()
    assert (row.status, row.affected) == ("ran", LINKS // 10)


@pytest.mark.parametrize("levels", [0, 1, 6, 12])
def test_graphs_are_followed_to_any_depth(spark, levels):
    block = {"@type": "Deep"}
    for i in range(levels):
        block = {"@type": f"L{i}", "@graph": [block]}
    rows = spark.createDataFrame([([json.dumps(block), "{broken"],)], "b array<string>")
    got = rows.selectExpr(f"transform({jsonld.json_items('b')}, i -> i.types[0]) AS t").head().t
    assert got == [f"L{i}" for i in reversed(range(levels))] + ["Deep"]


def test_sitemap_indexes_are_followed_to_the_end(spark):
    """A chain of ten indexes that also list the first one again."""
    def index(*urls):
        return "<sitemapindex>" + "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls) + "</sitemapindex>"

    files = [("s", f"u{i}", True, index(f"u{i + 1}", "u0")) for i in range(10)]
    files.append(("s", "u10", True, "<urlset><url><loc>a</loc></url><url><loc>b</loc></url></urlset>"))
    starts = spark.createDataFrame([("s", 0, "u0"), ("t", 0, "none")], "audit_id string, start_ord int, url string")
    got = pl.sitemap_info(starts, spark.createDataFrame(files, "audit_id string, url string, ok boolean, text string"))
    rows = {r.audit_id: r for r in got.collect()}
    assert rows["s"].sitemap_checked == [f"u{i}" for i in range(11)]
    assert rows["s"].sitemap_urls == 2 and rows["s"].sitemap_found
    assert not rows["t"].sitemap_found


def test_notes_are_ordered_by_columns(spark):
    rows = [("a", "seo.x", "c", "info", "seo", "m", "low", "low", 1, i) for i in range(1200)]
    rows += [("a", "seo.y", "c", "info", "seo", "m", "low", "low", 2, i) for i in range(3)]
    found = spark.createDataFrame(rows, "audit_id string, check_id string, code string, severity string, category string, "
                                        "message string, impact string, effort string, check_ord int, finding_ord int")
    got = [r.check_id for r in tr.issue_rows(found).orderBy("issue_ord").collect()]
    assert got == ["seo.x"] * 1200 + ["seo.y"] * 3


def test_repeated_side_rows_give_one_result(spark, large_site):
    robots = spark.createDataFrame(
        [("s", "https://s.test/robots.txt", code, "text/plain", "User-agent: *\nDisallow: /x") for code in (404, 200, 200)],
        "audit_id string, url string, status_code int, content_type string, text string")
    for rows in (robots, robots.orderBy(F.col("status_code").desc())):
        got = audit.check_results(audit.AuditInputs(docs=large_site, robots_files=rows), ["seo.robots_txt"]).collect()
        assert len(got) == 1 and got[0].score == 1.0


def test_release_removes_written_tables(spark):
    kept = dict(session._written)
    session._written.clear()
    try:
        table = session.materialise(spark.range(3), "short-lived")
        assert table.count() == 3
        assert session.release(spark) == 1
        with pytest.raises(Exception):
            spark.read.parquet(table.inputFiles()[0]).count()
    finally:
        session._written.update(kept)
