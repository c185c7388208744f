"""Streams with timers and held rows, over batches with late rows and after restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crawlscore.plans import audit
from crawlscore.sources import pages as pg
from crawlscore.streaming import keyed
from crawlscore.streaming.sites import SiteStream

START = dt.datetime(2024, 1, 1)


def at(hours):
    return START + dt.timedelta(hours=hours)


def replay(spark, folder, schema, batches, build):
    """Rows emitted after each batch; every batch is a restart from the checkpoint."""
    source, out = str(folder / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        got = []
        build(spark.readStream.schema(schema).parquet(source)).writeStream.foreachBatch(
            lambda batch, number: got.extend(tuple(r) for r in batch.collect())).option(
            "checkpointLocation", str(folder / "at")).trigger(availableNow=True).start().awaitTermination()
        out.append(sorted(got))
    return out


def test_stuck_audits_alert_once_and_late_ends_count(spark, tmp_path):
    batches = [
        [(1, "running", at(0)), (2, "running", at(0)), (3, "done", at(1.1)), (4, "running", at(1)), (0, "done", at(2))],
        [(2, "failed", at(0.5)), (3, "running", at(1)), (0, "done", at(2.5))],  # an end and a start behind the newest row
        [(0, "done", at(20))],
        [(1, "done", at(19.9)), (5, "running", at(19)), (2, "running", at(0)), (0, "done", at(21))],  # too late, and behind the mark
        [(0, "done", at(60))],
    ]
    got = replay(spark, tmp_path, "id bigint, status string, at timestamp", batches,
                 lambda e: keyed.stuck_audits(e, seconds=3600, late="3 hours"))
    assert [[r[0] for r in rows] for rows in got] == [[], [], [1, 4], [], [5]]
    assert dict(r for rows in got for r in rows) == {1: at(0), 4: at(1), 5: at(19)}


def test_score_drops_in_order_of_time(spark, tmp_path):
    batches = [
        [(1, "a", 90, at(0)), (3, "a", 70, at(5)), (4, "b", 50, at(1)), (9, "b", 45, at(1)), (90, "", None, at(6))],
        [(2, "a", 60, at(2)), (5, "b", None, at(2)), (6, "b", 10, at(3)), (91, "", None, at(30))],  # 2 comes late, between 1 and 3
        [(7, "a", 64, at(29)), (8, "a", 1, at(1)), (92, "", None, at(90))],  # 8 is behind the watermark
        [(10, "b", 4, at(95)), (93, "", None, at(200))],
        [(94, "", None, at(24 * 30))],
        [(11, "a", 1, at(24 * 30 + 1)), (95, "", None, at(24 * 40))],  # the scores before are forgotten
    ]
    got = replay(spark, tmp_path, "id bigint, url string, health_score int, created_at timestamp", batches,
                 lambda a: keyed.score_drops(a, late="10 hours", forget_days=10))
    assert got == [[], [(2, "a", -30), (9, "b", -5)], [(7, "a", -6)], [(10, "b", -6)], [], []]


def page(audit_id, number, hours, title):
    html = f"<!doctype html><html><head><title>{title}</title></head><body><h1>x</h1></body></html>"
    url = f"https://{audit_id}.test/{number or ''}"
    return (audit_id, (0, number, number), url, url, 200, {"content-type": "text/html"}, html, at(hours))


PAGES = ("audit_id string, page_key struct<depth:int,length:int,id:bigint>, url string, final_url string, status_code int, "
         "headers map<string,string>, text string, crawled_at timestamp")


@pytest.fixture(scope="module")
def site_stream(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sites")
    only = ["seo.title", "seo.duplicate_titles", "best_practices.https"]
    sites, counts = SiteStream(spark, str(folder / "out"), only=only), []
    batches = [
        [page("a", 0, 0, "A fine long title"), page("a", 1, 0.05, ""), page("b", 0, 0, "")],
        [page("a", 2, 0.1, "A fine long title"), page("b", 1, 5, "Second visit of b")],  # closes a and b's first session
        [page("a", 3, 0.1, ""), page("", 0, 50, "t")],  # a page of a closed session is dropped
    ]
    for rows in batches:
        spark.createDataFrame(rows, PAGES).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        sites.run(spark.readStream.schema(PAGES).parquet(str(folder / "in")))
        counts.append(sites.results().select("session").distinct().count())
    kept = [batches[0][0], batches[0][1], batches[1][0]]
    return sites, counts, kept, batches


def outcome(rows):
    return sorted((r.check_id, r.status, r.score, [(f.code, f.affected) for f in r.findings]) for r in rows.collect())


def test_sites_are_judged_when_their_pages_stop(spark, site_stream):
    sites, counts, kept, batches = site_stream
    assert counts == [0, 2, 3]
    for audit_id, begins, pages in (("a", 0, kept), ("b", 0, [batches[0][2]]), ("b", 5, [batches[1][1]])):
        docs = pg.page_docs(spark.createDataFrame(pages, PAGES))
        want = outcome(audit.check_results(audit.AuditInputs(docs=docs), sites.only))
        assert outcome(sites.results().where((F.col("audit_id") == audit_id) & (F.col("begins") == F.lit(at(begins))))) == want
    scores = {(r.audit_id, r.begins): r.score for r in sites.category_scores().where("category = 'best_practices'").collect()}
    assert scores == {("a", at(0)): 100, ("b", at(0)): 100, ("b", at(5)): 100}


def test_a_repeated_batch_replaces_its_results(spark, site_stream):
    sites = site_stream[0]
    before = outcome(sites.results())
    numbers = [r.batch for r in sites.results().select("batch").distinct().collect()]
    for number in numbers:
        path = f"{sites.folder}/closed/batch={number}"
        again = spark.read.parquet(path).collect()
        schema = spark.read.parquet(path).schema
        sites._judge(spark.createDataFrame(again, schema), number)
    assert outcome(sites.results()) == before
