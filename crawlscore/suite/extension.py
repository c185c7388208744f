"""The extension surface as queries: own checks, own page logic, own collectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscore.operators.checks.spec import Check, Rule, share
from crawlscore.plans import audit as au
from crawlscore.plans import catalog, registry
from crawlscore.suite.corpus import query
from crawlscore.suite.oracle_pages import page_cte

LONG_PAGES = Check(
    "seo.own_many_links", 2, "Few links", why="Long link lists tire readers.",
    fix="Cut the list of links.",
    features={"link_count": "size(filter(elements, e -> e.tag = 'a'))"},
    facts={"crowded": "count_if(link_count > 7)"}, partial=share("pages", "crowded"),
    rules=(Rule("crowded", "warn", "crowded > 0", "low", affected="crowded", pages="link_count > 7"),),
)
BROKEN = Check(
    "seo.own_broken", 2, "Broken rule", why="It shows isolation.", fix="Mend the rule.",
    rules=(Rule("never", "fail", "no_such_column > 0"),),
)


def _with(check: Check, c, extra=None):
    catalog.register(check)
    try:
        inputs = c.inputs if extra is None else registry.with_collector(c.inputs, *extra)
        return au.check_results(inputs, [check.check_id, "seo.title"])
    finally:
        catalog.unregister(check.check_id)


@query("L1", page_cte() + """ SELECT audit_id, round(1 - count(*) FILTER (WHERE len(regexp_extract_all(html, '<a[ >]')) > 7) / count(*)::DOUBLE, 6) AS score, count(*) FILTER (WHERE len(regexp_extract_all(html, '<a[ >]')) > 7) AS crowded FROM op GROUP BY 1""")
def own_check(c):
    rows = _with(LONG_PAGES, c).where("check_id = 'seo.own_many_links'")
    return rows.selectExpr(
        "audit_id", "round(score, 6) AS score", "findings[0].affected AS crowded")


@query("L2", page_cte() + """ SELECT page_id, substr(x.p, 2) AS part
  FROM op, LATERAL (SELECT unnest(regexp_extract_all(html, '<(?:nav|footer|article|main|aside)')) AS p) AS x""")
def own_page_logic(c):
    """Python logic called from SQL on batches of pages: the innermost name of each large part."""
    registry.register_page_logic(c.spark, "page_outline", registry.outline)
    pages = c.pages.where("headers['content-type'] NOT LIKE '%pdf%'").select(F.col("page_key.id").alias("page_id"), "text")
    return c.spark.sql("SELECT page AS page_id, part FROM page_outline(TABLE(SELECT page_id, text FROM {pages}))", pages=pages).select(
        "page_id", F.element_at(F.split("part", " > "), -1).alias("part"))


@query("L3", page_cte() + " SELECT audit_id, CASE WHEN length(audit_id) > 20 THEN 'warn' ELSE 'pass' END AS severity FROM op GROUP BY 1")
def own_collector(c):
    collected = c.derived("sites").selectExpr("audit_id", "length(audit_id) AS name_length")
    check = Check(
        "seo.own_short_name", 1, "Short name", why="Short names are remembered.",
        fix="Pick a shorter name.", tables=("names",), requires=("names",),
        rules=(Rule("long", "warn", "names.name_length > 20"),))
    rows = _with(check, c, ("names", collected)).where("check_id = 'seo.own_short_name'")
    return rows.selectExpr("audit_id", "findings[0].severity AS severity")


@query("L4", page_cte() + " SELECT audit_id, 'error' AS own_status, 'ran' AS other_status FROM sites")
def isolation(c):
    rows = _with(BROKEN, c)
    return rows.groupBy("audit_id").agg(
        F.max(F.when(F.col("check_id") == "seo.own_broken", F.col("status"))).alias("own_status"),
        F.max(F.when(F.col("check_id") == "seo.title", F.col("status"))).alias("other_status"))


@query("L5", "SELECT o_custkey, round(sum(o_totalprice * o_orderkey) / sum(o_orderkey)::DOUBLE, 2) AS weighted FROM orders GROUP BY o_custkey HAVING sum(o_orderkey) > 0")
def weighted_mean(c):
    sums = c.table("orders").groupBy("o_custkey").agg(
        F.sum(F.col("o_totalprice") * F.col("o_orderkey")).alias("a"),
        F.sum("o_orderkey").alias("b"))
    return sums.where("b > 0").select("o_custkey", F.round(F.col("a") / F.col("b"), 2).alias("weighted"))
