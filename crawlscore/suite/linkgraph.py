"""Crawl selection and link-graph operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.operators import linkgraph as lg
from crawlscore.plans import audit as au
from crawlscore.plans.catalog import catalogue
from crawlscore.plans.side_tables import INTERNAL_BROKEN
from crawlscore.sources import payloads as pl
from crawlscore.suite.checks import LINK_OK, URL_STATUS
from crawlscore.suite.corpus import query
from crawlscore.suite.oracle_pages import origin, page_cte

# every link of every page stands as a candidate, in page order
CANDIDATES = f"""
cand AS (SELECT l.audit_id, l.pos * 100000 + l.ord AS place, regexp_replace(l.link, '#.*$', '') AS page, r.home_url, r.s6, r.s7, r.s8,
    regexp_extract(regexp_replace(l.link, '#.*$', ''), '^https?://[^/?#]+(.*)$', 1) AS lp FROM link_rows l JOIN sites r USING (audit_id)),
own AS (SELECT audit_id, page, min(place) AS place, bool_and({LINK_OK}) AS allowed, any_value(home_url) AS home_url FROM cand r
  WHERE {origin('page')} = {origin('home_url')} AND NOT regexp_matches(lower(page), '[.]pdf$') GROUP BY audit_id, page)"""


def _candidates(c):
    links = lg.page_links(c.docs).select(
        "audit_id",
        F.struct("page_key", "link_ord").alias("place"), F.col("link").alias("raw"))
    return links.select("audit_id", F.lit(1).alias("source"), F.col("place").alias("ord"), "raw")


@query("D1", page_cte("sitemap_files", hrefs=True) + """ SELECT audit_id, source, count(*) AS n, min(raw) AS lowest FROM (
  SELECT audit_id, 0 AS source, trim(u) AS raw FROM (SELECT audit_id, unnest(regexp_extract_all(text, '<loc>([^<]*)</loc>', 1)) AS u FROM sitemap_files WHERE ok AND regexp_matches(text, '</urlset>$') AND NOT contains(text, 'DOCTYPE')) AS s
  UNION ALL SELECT audit_id, 1, regexp_replace(link, '#.*$', '') FROM link_rows WHERE pos = 1) AS x GROUP BY 1, 2""")
def candidates(c):
    listed = pl.sitemap_urls(c.derived("sitemap_files")).where("NOT is_index AND loc IS NOT NULL")
    homes = c.docs.groupBy("audit_id").agg(
        F.min_by(F.struct("final_url", "elements"), "page_key").alias("h"),
        F.min("page_key").alias("page_key")).select("audit_id", "page_key", "h.*")
    found = lg.candidates(listed, lg.page_links(homes))
    return found.groupBy("audit_id", "source").agg(
        F.count("*").alias("n"), F.min("raw").alias("lowest"))


_CHOSEN = page_cte("robots_files", hrefs=True) + "," + CANDIDATES + f""",
other AS (SELECT * FROM own WHERE page <> home_url),
ok AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY place) AS rn FROM other WHERE allowed)"""


def _chosen(c):
    return lg.choose_pages(_candidates(c), c.homes)


@query("D2", _CHOSEN + f""" SELECT audit_id, page, 'wanted' AS verdict FROM ok 
  UNION ALL SELECT audit_id, page, 'skipped' FROM other WHERE NOT allowed""")
def chosen(c):
    wanted, skipped = _chosen(c)
    return wanted.select("audit_id", "page", F.lit("wanted").alias("verdict")).unionByName(
        skipped.select("audit_id", "page", F.lit("skipped").alias("verdict")))


@query("D3", page_cte(hrefs=True) + "," + CANDIDATES + " SELECT audit_id, page FROM own")
def discovered(c):
    return lg.discover(_candidates(c), c.homes).select("audit_id", "page")


_EDGES = page_cte("robots_files", hrefs=True) + "," + URL_STATUS


@query("D4", _EDGES + f" SELECT audit_id, page_id, count(DISTINCT link) AS links FROM cut_links r WHERE {origin('link')} = {origin('home_url')} AND {LINK_OK} GROUP BY 1, 2")
def internal(c):
    return lg.internal_edges(c.docs, c.homes).groupBy(
        "audit_id", F.col("page_key.id").alias("page_id")).agg(F.count("*").alias("links"))


@query("D5", _EDGES + " SELECT audit_id, link FROM todo")
def to_verify(c):
    return lg.links_to_verify(lg.internal_edges(c.docs, c.homes), c.docs).select("audit_id", "link")


@query("D6", _EDGES + f""" SELECT audit_id, url, CASE WHEN e.code IS NULL THEN u.status_code ELSE e.code END AS status_code FROM (SELECT * FROM url_status WHERE kind = 'internal') u
  LEFT JOIN (SELECT audit_id, link, CASE WHEN substr(md5(link), 2, 1) < '4' THEN 410 WHEN substr(md5(link), 2, 1) < '8' THEN 0 END AS code FROM todo) e ON e.audit_id = u.audit_id AND e.link = u.url""".replace("SELECT audit_id, url, CASE", "SELECT u.audit_id, u.url, CASE"))
def statuses(c):
    from crawlscore.suite.corpus import with_status

    probed = with_status(lg.links_to_verify(lg.internal_edges(c.docs, c.homes), c.docs))
    errors = probed.selectExpr(
        "audit_id", "url", "CASE WHEN substr(md5(url), 2, 1) < '4' THEN 'HTTP 410' WHEN "
        "substr(md5(url), 2, 1) < '8' THEN 'timed out' END AS error").where("error IS NOT NULL")
    return lg.link_statuses(c.docs, probed, errors)


@query("D7", _EDGES + """, ext AS (SELECT audit_id, link, min(pos * 100000 + ord) AS place, site = 'facebook.com' AS walled FROM reg WHERE site <> own_site GROUP BY 1, 2, 4)
  SELECT audit_id, link, walled, NOT walled AS checked FROM ext""")
def external(c):
    found = lg.external_links(c.docs, c.homes)
    chosen = lg.external_to_check(found).select("audit_id", "link", F.lit(True).alias("checked"))
    return found.select("audit_id", "link", "walled").join(
        chosen, ["audit_id", "link"], "left").withColumn("checked", F.coalesce("checked", F.lit(False)))


@query("D8", _EDGES + " SELECT audit_id, link FROM img_links")
def images(c):
    return lg.images_to_check(lg.image_edges(c.docs)).select("audit_id", "link")


@query("D9", _EDGES + f""", bad AS (SELECT audit_id, url, status_code FROM url_status WHERE kind = 'internal' AND {INTERNAL_BROKEN}),
spots AS (SELECT DISTINCT l.audit_id, c.link, l.final_url, l.pos FROM cut_links c JOIN op l USING (audit_id, pos))
SELECT b.audit_id, b.url AS link, CASE WHEN status_code = 0 THEN 'can''t be reached' ELSE concat('error ', status_code) END AS answer, s.final_url
  FROM bad b LEFT JOIN spots s ON s.audit_id = b.audit_id AND s.link = b.url""")
def breakdown(c):
    own = c.url_status.where("kind = 'internal'").drop("kind")
    return lg.broken_breakdown(own, lg.internal_edges(c.docs, c.homes), INTERNAL_BROKEN).drop("page_key")


@query("D9_pages", _EDGES + f""" SELECT audit_id, link, final_url FROM (SELECT DISTINCT l.audit_id, c.link, l.final_url, l.pos FROM cut_links c JOIN op l USING (audit_id, pos)) AS d
  WHERE (audit_id, link) IN (SELECT (audit_id, url) FROM url_status WHERE kind = 'internal' AND {INTERNAL_BROKEN})""")
def broken_pages(c):
    own = c.url_status.where("kind = 'internal'").drop("kind")
    return lg.broken_pages(own, lg.internal_edges(c.docs, c.homes), INTERNAL_BROKEN).drop("page_key")


_BLOCKED = "(s.s6 >= 3 AND s.s7 >= 1 AND s.s8 NOT IN (8, 9))"
_PATH = "regexp_extract(s.home_url, '^https?://[^/?#]+(.*)$', 1)"


@query("D10", page_cte("robots_files") + f""" SELECT s.audit_id, a.agent, a.kind FROM sites s, (VALUES ('OAI-SearchBot', 'search'), ('PerplexityBot', 'search'), ('GPTBot', 'training'), ('ClaudeBot', 'training')) AS a(agent, kind)
  WHERE {_BLOCKED} AND CASE WHEN s.s8 < 4 THEN true WHEN s.s8 < 8 THEN a.agent IN ('PerplexityBot', 'GPTBot') OR starts_with({_PATH}, '/The') ELSE starts_with({_PATH}, '/de') OR starts_with({_PATH}, '/fr') END""")
def blocked(c):
    return lg.blocked_agents(c.derived("robots_files"), c.homes, fv.AI_CRAWLERS)


@query("D11", page_cte(hrefs=True) + "," + CANDIDATES + f""", seen AS (SELECT audit_id, page FROM own UNION SELECT audit_id, final_url FROM op)
  SELECT audit_id, page, EXISTS (SELECT 1 FROM op p WHERE p.audit_id = s.audit_id AND p.final_url = s.page) AS checked FROM seen s""")
def listing(c):
    found = lg.discover(_candidates(c), c.homes).select("audit_id", "page").union(
        c.docs.select("audit_id", "final_url")).distinct()
    return lg.page_listing(found, c.docs)


_GATED = {i: sorted(k.requires)[0] for i, k in catalogue().items() if k.requires}


@query("D12", page_cte("site_probe", "security_facts", "psi_raw") + """ SELECT s.audit_id, c.check_id, c.missing FROM sites s, (VALUES """ + ", ".join(f"('{i}', '{m}')" for i, m in _GATED.items())
       + """) AS c(check_id, missing) WHERE CASE c.missing WHEN 'probes' THEN s.s8 >= 14 WHEN 'render' THEN s.s4 >= 13 WHEN 'security' THEN s.s28 >= 15 WHEN 'pagespeed' THEN s.s2 >= 14 END""")
def gate(c):
    caps = c.derived("sites").select("audit_id").join(
        au.capabilities(c.inputs), "audit_id", "left").withColumns({
            "caps": F.coalesce("caps", F.array().cast("array<string>")),
            "reasons": F.coalesce("reasons", F.create_map().cast("map<string,string>"))})
    checks = [(i, sorted(k.requires)) for i, k in catalogue().items()]
    return lg.capability_gate(caps, checks).select("audit_id", "check_id", "missing")


@query("C7", _EDGES + f""", bad AS (SELECT audit_id, url, row_number() OVER (PARTITION BY audit_id ORDER BY url) AS rn FROM url_status u WHERE kind = 'internal' AND {INTERNAL_BROKEN} AND EXISTS (SELECT 1 FROM cut_links c WHERE c.audit_id = u.audit_id AND c.link = u.url))
  SELECT b.audit_id, b.url AS link, arg_min(p.final_url, c.pos) AS page FROM bad b JOIN cut_links c ON c.audit_id = b.audit_id AND c.link = b.url JOIN op p ON p.audit_id = c.audit_id AND p.pos = c.pos GROUP BY 1, 2""")
def culprits(c):
    own = c.url_status.where("kind = 'internal'").drop("kind")
    return lg.first_culprits(own, c.docs, INTERNAL_BROKEN).selectExpr(
        "audit_id", "link", "final_url AS page")
