"""Evidence rows, fixes, robots rules at scale and page logic in SQL, on literal pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crawlscore.functions import robots
from crawlscore.operators import ranking, robots_access
from crawlscore.plans import audit, evidence, registry, side_tables
from crawlscore.sources import pages as pg

SCHEMA = ("audit_id string, page_key struct<depth:int,length:int,id:bigint>, url string, final_url string, status_code int, "
          "headers map<string,string>, text string")


def page(audit_id, number, head="", body=""):
    html = f"<!doctype html><html><head><title>A title of length</title>{head}</head><body>{body}</body></html>"
    url = f"https://{audit_id}.test/{number or ''}"
    return (audit_id, (0, number, number), url, url, 200, {"content-type": "text/html"}, html)


@pytest.fixture(scope="module")
def inputs(spark):
    lodash, old = '<script src="/lodash/4.17.2/lodash.js"></script>', '<script src="/jquery-3.4.1.js"></script>'
    faq = "<h2>When?</h2><p>Now.</p><h2>Where?</h2><p>Here.</p>"
    rows = [
        page("a", 0, old + '<meta name="description" content="short">', "<p>Call (020) 7946 0018 today</p>"),
        page("a", 1, old + lodash + f'<meta name="description" content="{"x" * 163}">', faq),
        page("a", 2, f'<meta name="description" content="{"y" * 160}">', faq),
        page("b", 0, "", '<a href="https://wa.me/1">chat</a><h2>Why?</h2><p>So.</p>'),
        page("c", 0),
    ]
    docs = pg.page_docs(spark.createDataFrame(rows, SCHEMA))
    renders = spark.createDataFrame([("b", {"jQuery": "1.9.0", "Own": "0.1"}), ("c", {"jQuery": "3.10.1"})], "audit_id string, libraries map<string,string>")
    renders = renders.withColumns({"text_length": F.lit(5), "console_errors": F.array().cast("array<string>")})
    security = spark.createDataFrame(
        [("a", "a.test", None, True, "", "v=DMARC1; p = None", True), ("b", "b.test", None, True, "v=spf1 -all", "v=DMARC1; p=reject", False),
         ("c", "c.test", None, True, None, None, None)],
        "audit_id string, domain string, cert_error string, dns_checked boolean, spf string, dmarc string, has_mx boolean").withColumns(
        {"cert_expires": F.lit(None).cast("timestamp"), "domain_expires": F.lit(None).cast("timestamp")})
    return audit.AuditInputs(docs=docs, renders=renders, security_facts=security)


def test_libraries_by_name_version_and_pages(inputs):
    got = {(r.audit_id, r.library, r.version, r.safe_version): r.pages for r in evidence.library_list(inputs).collect()}
    assert got == {("a", "jQuery", "3.4.1", "3.5.0"): 2, ("a", "Lodash", "4.17.2", "4.17.21"): 1, ("b", "jQuery", "1.9.0", "3.5.0"): 1}


def test_lengths_and_best_pages(inputs):
    lengths = sorted((r.audit_id, r.page_key.id, r.length, r.off_by) for r in evidence.description_lengths(inputs).collect())
    assert lengths == [("a", 0, 5, -45), ("a", 1, 163, 3)]
    best = {r.audit_id: (r.final_url, r.answers, r.enough) for r in evidence.best_answer_pages(inputs).collect()}
    assert best == {"a": ("https://a.test/1", 2, True), "b": ("https://b.test/", 1, False)}


def test_fixes_stand_on_their_findings(inputs):
    checks = ["seo.whatsapp_chat", "best_practices.email_spoofing", "agentic.answer_ready", "seo.title"]
    found = evidence.with_snippets(audit.findings(audit.check_results(inputs, checks)), inputs).collect()
    fixes = {(r.audit_id, r.check_id): [s.code for s in r.snippets] for r in found if r.snippets}
    assert "wa.me/02079460018?" in fixes.pop(("a", "seo.whatsapp_chat"))[0]
    assert "wa.me/8801XXXXXXXXX?" in fixes.pop(("c", "seo.whatsapp_chat"))[0]
    mail = "best_practices.email_spoofing"
    assert fixes.pop(("a", mail)) == ["v=spf1 include:_spf.google.com ~all", "v=DMARC1; p=quarantine; rua=mailto:dmarc@a.test"]
    assert fixes.pop(("c", mail)) == ["v=spf1 -all", "v=DMARC1; p=quarantine; rua=mailto:dmarc@c.test"]
    assert sorted(fixes) == [("b", "agentic.answer_ready"), ("c", "agentic.answer_ready")]


@pytest.mark.parametrize("text, days", [
    ("2024-02-08 00:00:00+00:00", 7), ("2024-02-07 23:59:59+00:00", 6), ("2024-02-08 05:00:00+05:00", 7),
    ("2024-01-31 23:59:59+00:00", -1), ("2024-02-01 00:00:00+00:00", 0), (None, None)])
def test_days_left_are_whole_days(spark, text, days):
    when = F.lit(text).cast("timestamp")
    facts = spark.range(1).select(when.alias("cert_expires"), when.alias("domain_expires"))
    row = side_tables.security_table(facts, "2024-02-01 00:00:00").head()
    assert (row.cert_days, row.domain_days) == (days, days)


def test_robots_of_a_site_with_many_rules(spark):
    """Ten thousand rules and a million links: the first fitting rule decides, as on one address at a time."""
    lines = ["User-agent: *"]
    for k in range(5_000):
        lines += [f"Allow: /p{k}/open", f"Disallow: /p{k}/"]
    text = "\n".join(lines) + "\n"
    files = spark.createDataFrame([("s", text), ("free", "")], "audit_id string, text string").selectExpr(
        "audit_id", f"CASE WHEN text <> '' THEN {robots.groups_sql('text')} END AS robots_groups")
    links = spark.range(1_000_000).selectExpr(
        "if(id % 10 = 9, 'free', 's') AS audit_id",
        "concat('https://s.test/p', id % 7000, if(id % 3 = 0, '/open', '/shut'), '?q=', id) AS link")
    got = robots_access.judged(links, "link", files, "AnyBot")
    bad = "audit_id = 's' AND NOT link LIKE '%/open?%' AND CAST(regexp_extract(link, '/p([0-9]+)/', 1) AS INT) < 5000"
    counts = got.selectExpr("count(*) AS n", f"count_if(allowed = ({bad})) AS wrong").head()
    assert (counts.n, counts.wrong) == (1_000_000, 0)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "robots_groups" not in plan.split("Exchange")[0]


def test_robots_order_stars_and_agents(spark):
    text = "\n".join(["User-agent: Named", "Disallow: /a", "", "User-agent: *", "Allow: /x/y", "Disallow: /x", "Disallow: /x/y/z", "Allow: *", ""])
    files = spark.createDataFrame([("s", text)], "audit_id string, text string").selectExpr("audit_id", f"{robots.groups_sql('text')} AS robots_groups")
    links = ["https://s/x", "https://s/x/y/z", "https://s/x/yy", "https://s/a", "https://s", None, "https://s/X"]
    rows = spark.createDataFrame([("s", u) for u in links] + [("t", "https://s/x")], "audit_id string, link string")
    for agent in ("Named/2", "other"):
        want = rows.join(files, "audit_id", "left").selectExpr(
            "audit_id", "link", f"coalesce(CASE WHEN link IS NULL THEN true ELSE {robots.allows('robots_groups', agent, 'link')} END, true) AS allowed")
        got = robots_access.judged(rows, "link", files, agent)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_page_logic_in_sql(spark):
    registry.register_page_logic(spark, "own_outline", registry.outline, "string")
    rows = spark.createDataFrame([("p", "<main><nav></nav></main><footer>"), ("q", None), ("r", ""), (None, "<nav>")], "page string, text string")
    got = spark.sql("SELECT page, part FROM own_outline(TABLE(SELECT page, text FROM {rows}))", rows=rows).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [("p", "main"), ("p", "main > nav"), ("p", "footer"), (None, "nav")]))


def test_ranks_of_a_hot_key(spark):
    df = spark.range(3_000).selectExpr("if(id < 2500, 'hot', concat('k', id % 7)) AS k", "(id * 7919) % 3000 AS v")
    df = df.unionByName(spark.createDataFrame([(None, 5), (None, None), (None, 3)], "k string, v bigint"))
    for falling in (False, True):
        rows = ranking.ranked(df, ["k"], ["v"], "n", falling).collect()
        by_key = {}
        for r in rows:
            by_key.setdefault(r.k, []).append((r.n, r.v))
        for found in by_key.values():
            found.sort()
            values = [v for _, v in found if v is not None]
            assert [n for n, _ in found] == list(range(1, len(found) + 1)) and values == sorted(values, reverse=falling)
        assert sum(map(len, by_key.values())) == 3_003


def test_late_dates_are_judged_by_the_audit_day(spark, inputs):
    soon = dt.datetime(2026, 1, 5)
    facts = inputs.security_facts.withColumn("domain_expires", F.lit(soon).cast("timestamp"))
    rows = audit.findings(audit.check_results(
        audit.AuditInputs(docs=inputs.docs, security_facts=facts, as_of="2026-01-01 00:00:00"), ["best_practices.domain_expiry"])).collect()
    assert {r.code for r in rows} == {"ends_now"}
