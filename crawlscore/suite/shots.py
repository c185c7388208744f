"""Elements that findings are about, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscore.operators import treatment as tr
from crawlscore.plans import audit as au
from crawlscore.plans import element_evidence as ee
from crawlscore.plans.side_tables import INTERNAL_BROKEN
from crawlscore.suite.checks import (
    BAD_ALT, BROKEN, DOM_IMGS, MIXED_ACTIVE, NAMELESS, NOTED, PUSH, SECURE, UNLABELLED, URL_STATUS,
)
from crawlscore.suite.corpus import query
from crawlscore.suite.oracle_pages import count, decoded, page_cte

_HEADING = "regexp_extract_all(dom, '(?s)<h[1-6][^>]*>.*?</h[1-6]>')"
_PLAIN = decoded("trim(regexp_replace(regexp_replace(h, '\\s*<[^>]*>\\s*', '', 'g'), '\\s+', ' ', 'g'))")
_WITH_ALT = decoded("trim(regexp_replace(regexp_replace(h, '<img[^>]* ?alt=\"([^\"]*)\"[^>]*>', '\\1', 'g'), '<[^>]*>', '', 'g'))")
HEAD_ROWS = f"""
heads AS (SELECT audit_id, page_id, h, i AS place, CAST(substr(h, 3, 1) AS INT) AS level, {_PLAIN} AS plain, {_WITH_ALT} AS text, several FROM (
  SELECT audit_id, page_id, {count('html', '<h1>')} > 1 AS several, unnest({_HEADING}) AS h, unnest(range(len({_HEADING}))) AS i FROM op) AS x),
head_rows AS (SELECT *, lag(level) OVER w AS before, first_value(level) OVER w AS first_level, concat('<h', level, '>',
    CASE WHEN plain <> '' THEN concat(' "', substr(plain, 1, 50), '"') ELSE '' END) AS label FROM heads WINDOW w AS (PARTITION BY page_id ORDER BY place)),
shared AS (SELECT audit_id, lower(text) AS t FROM head_rows WHERE level = 1 AND text <> '' GROUP BY 1, 2 HAVING count(*) > 1)"""


def _elements(c, *checks: str):
    found = au.findings(au.check_results(c.inputs, list(checks)))
    return ee.finding_elements(c.inputs, found, list(checks)), found


_OF_PAGE = ["audit_id", "check_id", "code", "page_key.id AS page_id"]


@query("C6_headings", page_cte() + "," + HEAD_ROWS + """
SELECT audit_id, 'seo.single_h1' AS check_id, 'several' AS code, page_id, label FROM head_rows WHERE several AND level = 1
UNION ALL SELECT audit_id, 'accessibility.heading_order', 'skipped', page_id, label FROM head_rows WHERE level > before + 1
UNION ALL SELECT audit_id, 'seo.heading_structure', 'serious', page_id, label FROM head_rows r WHERE text = '' OR (level = 1 AND place > 0 AND first_level <> 1)
  OR (level = 1 AND EXISTS (SELECT 1 FROM shared s WHERE s.audit_id = r.audit_id AND s.t = lower(r.text)))""")
def headings(c):
    """Main headings of pages with several, headings after a skipped level, and those that are empty, late or repeated."""
    rows, _ = _elements(c, "seo.single_h1", "accessibility.heading_order", "seo.heading_structure")
    return rows.selectExpr(*_OF_PAGE, "shot.label")


IMG_ROWS = f"""
img_tags AS (SELECT audit_id, page_id, pos, final_url, unnest({DOM_IMGS}) AS t, unnest(range(len({DOM_IMGS}))) AS place FROM op),
img_facts AS (SELECT *, coalesce(regexp_extract(t, ' src="([^"]*)"', 1), '') AS value, {{'src': coalesce(nullif(regexp_extract(t, ' src="([^"]*)"', 1), ''),
    regexp_extract(t, 'data-src="([^"]*)"', 1)), 'has': contains(t, 'alt='), 'alt': trim(regexp_extract(t, 'alt="([^"]*)"', 1))}} AS x FROM img_tags),
judged AS (SELECT *, {BAD_ALT} AS bad, {NOTED} AS noted FROM img_facts WHERE x.src <> '' AND NOT starts_with(x.src, 'data:')),
bad_sites AS (SELECT DISTINCT audit_id FROM judged WHERE bad),
active AS (SELECT DISTINCT audit_id FROM op WHERE {SECURE} AND {MIXED_ACTIVE}),
img_found AS (
  SELECT audit_id, 'seo.image_seo' AS check_id, 'bad_alt' AS code, page_id, pos, place, value FROM judged WHERE bad
  UNION ALL SELECT audit_id, 'seo.image_seo', 'notes', page_id, pos, place, value FROM judged WHERE noted AND NOT bad AND audit_id NOT IN (SELECT audit_id FROM bad_sites)
  UNION ALL SELECT audit_id, 'accessibility.image_alt', 'missing', page_id, pos, place, value FROM img_facts WHERE NOT x.has
  UNION ALL SELECT audit_id, 'performance.image_dimensions', 'unsized', page_id, pos, place, value FROM img_facts
    WHERE NOT starts_with(value, 'data:') AND NOT (contains(t, 'width=') AND contains(t, 'height='))
  UNION ALL SELECT audit_id, 'best_practices.mixed_content', CASE WHEN audit_id IN (SELECT audit_id FROM active) THEN 'active' ELSE 'passive' END, page_id, pos, place, value
    FROM img_facts WHERE {SECURE} AND starts_with(value, 'http://'))"""
#: In the report's order of categories.
IMAGE_CHECKS = ("performance.image_dimensions", "accessibility.image_alt", "best_practices.mixed_content", "seo.image_seo")


@query("C6_images", page_cte() + "," + IMG_ROWS + """ SELECT audit_id, check_id, code, page_id, CASE WHEN value = '' THEN '' ELSE 'src' END AS match_attr, value AS match_value,
  CASE WHEN value = '' THEN '<img>' ELSE concat('<img src="', coalesce(nullif(substr(regexp_extract(value, '([^/]*)$', 1), 1, 50), ''), substr(value, 1, 50)), '">') END AS label FROM img_found""")
def images(c):
    """Pictures without a useful description, without a size, or loaded over http."""
    rows, _ = _elements(c, *IMAGE_CHECKS)
    return rows.selectExpr(*_OF_PAGE, "shot.match_attr", "shot.match_value", "shot.label")


_TAG = "regexp_extract(t, '^<([a-z]+)', 1)"
_KEY = f"CASE {_TAG} WHEN 'a' THEN 'href' WHEN 'button' THEN '' ELSE 'name' END"
_VALUE = f"CASE {_TAG} WHEN 'a' THEN regexp_extract(t, 'href=\"([^\"]*)\"', 1) WHEN 'button' THEN '' ELSE regexp_extract(t, ' name=\"([^\"]*)\"', 1) END"


@query("C6_controls", page_cte() + f""", flagged AS (
  SELECT audit_id, 'accessibility.form_labels' AS check_id, 'unlabelled' AS code, page_id, unnest({UNLABELLED}) AS t FROM op
  UNION ALL SELECT audit_id, 'accessibility.accessible_names', 'nameless', page_id, unnest({NAMELESS}) FROM op
  UNION ALL SELECT audit_id, 'accessibility.accessible_names', 'nameless', page_id, unnest(list_filter({PUSH}, b -> NOT contains(b, 'value='))) FROM op)
SELECT audit_id, check_id, code, page_id, {_VALUE} AS match_value,
  concat('<', {_TAG}, CASE WHEN {_VALUE} = '' THEN '' ELSE concat(' ', {_KEY}, '="', substr({_VALUE}, 1, 50), '"') END, '>') AS label FROM flagged""")
def controls(c):
    """Form fields without a label; links and buttons without a name."""
    rows, _ = _elements(c, "accessibility.form_labels", "accessibility.accessible_names")
    return rows.selectExpr(*_OF_PAGE, "shot.match_value", "shot.label")


@query("C7_findings", page_cte("site_probe", hrefs=True) + "," + URL_STATUS + f""",
aimed AS (SELECT l.audit_id, l.page_id, l.pos, l.ord, l.link, replace(h.h, '&amp;', '&') AS value, 'a' AS tag FROM cut_links l JOIN href_rows h USING (audit_id, page_id, ord)
  UNION ALL SELECT i.audit_id, p.page_id, i.pos, i.ord, CASE WHEN starts_with(src, 'http') THEN src ELSE concat(regexp_extract(p.final_url, '^(https?://[^/?#]+)', 1), src) END, src, 'img'
    FROM imgs i JOIN op p USING (audit_id, pos) WHERE src <> '' AND NOT starts_with(src, 'data:')),
bad AS (SELECT DISTINCT audit_id, kind, url FROM url_status JOIN sites USING (audit_id) WHERE s8 < 14 AND CASE kind WHEN 'internal' THEN {INTERNAL_BROKEN} ELSE {BROKEN} END)
SELECT b.audit_id, CASE b.kind WHEN 'internal' THEN 'seo.broken_links' WHEN 'external' THEN 'seo.broken_external_links' ELSE 'seo.broken_images' END AS check_id,
  'broken' AS code, b.url AS lead, arg_min(a.page_id, (a.pos, a.ord)) AS page_id, arg_min(a.value, (a.pos, a.ord)) AS match_value
FROM bad b JOIN aimed a ON a.audit_id = b.audit_id AND a.link = b.url AND a.tag = CASE b.kind WHEN 'image' THEN 'img' ELSE 'a' END GROUP BY b.audit_id, b.kind, b.url""")
def pointing(c):
    """The first link or picture that points at each broken address, for the sites with that finding."""
    rows, _ = _elements(c, *ee.POINTING)
    return rows.selectExpr(*_OF_PAGE, "lead", "shot.match_value")


_ORDER = " ".join(f"WHEN '{check}' THEN {i}" for i, check in enumerate(IMAGE_CHECKS))


@query("H11_elements", page_cte() + "," + IMG_ROWS + f""" SELECT audit_id, check_id, page_id, match_value, pick FROM (
  SELECT *, value AS match_value, row_number() OVER (PARTITION BY audit_id ORDER BY CASE code WHEN 'missing' THEN 0 WHEN 'active' THEN 0 WHEN 'notes' THEN 2 ELSE 1 END,
    CASE check_id {_ORDER} END, pos, place) AS pick FROM img_found) AS x WHERE pick <= 24""")
def chosen(c):
    """The 24 elements of each site that are worth a picture first (the report's number)."""
    rows, found = _elements(c, *IMAGE_CHECKS)
    picked = tr.evidence(ee.ranked_for_evidence(rows, found), 24)
    return picked.select("audit_id", "check_id", F.col("page_key.id").alias("page_id"), "shot.match_value", F.col("pick").cast("bigint").alias("pick"))
