"""Ready-made fixes on findings, as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscore.plans import audit as au
from crawlscore.plans import evidence
from crawlscore.plans import page_fixes as pf
from crawlscore.suite.checks import PREVIEW_MISSING, written_phone
from crawlscore.suite.corpus import query
from crawlscore.suite.oracle_pages import decoded, first, page_cte
from crawlscore.suite.shots import HEAD_ROWS, IMG_ROWS
from crawlscore.suite.structured import NAME


def _findings(c, *checks: str):
    return au.findings(au.check_results(c.inputs, list(checks)))


def _fixes(c, check: str):
    return pf.page_fixes(c.inputs, _findings(c, check), [check]).withColumn("page_id", F.col("page_key.id"))


_ESCAPED = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"


@query("E8_blocks", page_cte() + f""", names AS (SELECT audit_id, {NAME} AS name FROM op WHERE pos = 1)
SELECT audit_id, page_id, array_to_string(list_filter([CASE WHEN NOT contains(html, '"og:title"') THEN 'og:title' END, CASE WHEN NOT contains(html, '"og:description"') THEN 'og:description' END,
    CASE WHEN NOT contains(html, '"og:image"') THEN 'og:image' END, CASE WHEN NOT contains(html, 'twitter:card') THEN 'twitter:card' END,
    CASE WHEN regexp_matches(html, '"og:image" content="(/|img)') THEN 'og:image is not a full address' END], x -> x IS NOT NULL), ', ') AS problems,
  CASE WHEN contains(html, '"og:type"') THEN 'article' ELSE 'website' END AS og_type, {_ESCAPED.format("CASE WHEN contains(html, 'og:site_name') THEN 'Corner Shop' ELSE name END")} AS site_name
FROM op JOIN names USING (audit_id) WHERE {PREVIEW_MISSING} > 0""")
def preview_blocks(c):
    return _fixes(c, "seo.social_tags").selectExpr(
        "audit_id", "page_id", "array_join(problems, ', ') AS problems", "regexp_extract(block, 'og:type\" content=\"([a-z]+)', 1) AS og_type",
        "regexp_extract(block, 'og:site_name\" content=\"([^\"]*)', 1) AS site_name")


@query("E19_blocks", page_cte() + f""" SELECT * FROM (SELECT audit_id, page_id, array_to_string(list_filter([CASE WHEN {first('html', '<title>([^<]*)</title>')} = '' THEN 'title' END,
    CASE WHEN {first('html', '<meta name="description" content="([^"]*)"')} = '' THEN 'description' END, CASE WHEN NOT contains(lower(html), 'name="viewport"') THEN 'viewport' END,
    CASE WHEN NOT contains(html, '<meta charset') THEN 'charset' END, CASE WHEN NOT contains(html, 'rel="canonical"') THEN 'canonical' END,
    CASE WHEN NOT contains(html, '<html lang') THEN 'lang' END], x -> x IS NOT NULL), ',') AS problems, CASE WHEN contains(html, 'content="NOINDEX') THEN 9 ELSE 8 END::BIGINT AS lines,
  replace(CASE WHEN regexp_matches(html, 'rel="canonical" href="http') THEN regexp_extract(html, 'rel="canonical" href="([^"]*)"', 1) ELSE final_url END, '&', '&amp;') AS canonical FROM op) AS x WHERE problems <> ''""")
def head_blocks(c):
    return _fixes(c, "seo.meta_tags").selectExpr(
        "audit_id", "page_id", "array_join(problems, ',') AS problems", "CAST(size(split(block, '\\n')) AS BIGINT) AS lines",
        "regexp_extract(block, 'canonical\" href=\"([^\"]*)', 1) AS canonical")


_SHOWN = decoded("trim(regexp_replace(regexp_replace(h, '<img[^>]* ?alt=\"([^\"]*)\"[^>]*>', '\\1', 'g'), ' ?<[^>]*>', '', 'g'))")


@query("E16_outlines", page_cte() + "," + HEAD_ROWS + f""",
marked AS (SELECT r.audit_id, page_id, place, level, {_SHOWN} AS shown, text, first_level, count(*) FILTER (WHERE level = 1) OVER (PARTITION BY page_id) AS n, before,
    level = 1 AND EXISTS (SELECT 1 FROM shared s WHERE s.audit_id = r.audit_id AND s.t = lower(r.text)) AS again FROM head_rows r),
said AS (SELECT *, array_to_string(list_filter([CASE WHEN text = '' THEN 'empty' END, CASE WHEN level = 1 AND n > 1 THEN concat('one of ', n, ' H1s') END,
    CASE WHEN again THEN 'also the H1 of another page' END, CASE WHEN level = 1 AND place > 0 AND first_level <> 1 AND n = 1 THEN 'should come first' END,
    CASE WHEN level > before + 1 THEN concat('skips H', before + 1) END], x -> x IS NOT NULL), ', ') AS marks FROM marked)
SELECT * FROM (SELECT audit_id, page_id, array_to_string(list_filter([CASE WHEN bool_or(text = '') THEN 'empty' END, CASE WHEN bool_or(level = 1) AND min(first_level) <> 1 THEN 'late' END,
    CASE WHEN bool_or(again) THEN 'repeated' END], x -> x IS NOT NULL), ',') AS problems,
  string_agg(concat(repeat('  ', level - 1), 'H', level, '  ', CASE WHEN shown = '' THEN '(no text)' WHEN length(shown) <= 80 THEN shown ELSE concat(left(shown, 77), '...') END,
    CASE WHEN marks <> '' THEN concat('   <-- ', marks) ELSE '' END), chr(10) ORDER BY place) AS block FROM said GROUP BY 1, 2) AS x WHERE problems <> ''""")
def outline_blocks(c):
    """Pages with serious problems; those with notes alone are left to C13's statement."""
    rows = _fixes(c, "seo.heading_structure").withColumn("problems", F.expr("array_join(array_remove(problems, 'notes'), ',')"))
    return rows.where("problems <> ''").select("audit_id", "page_id", "problems", "block")


@query("E17_blocks", page_cte() + "," + IMG_ROWS + """ SELECT audit_id, page_id, count(*) AS pictures, arg_min(x.src, place) AS first_src, bool_or(NOT x.has) AS without_alt
  FROM judged WHERE bad OR noted GROUP BY audit_id, page_id""")
def picture_blocks(c):
    return _fixes(c, "seo.image_seo").selectExpr(
        "audit_id", "page_id", "CAST(size(split(block, '\\n\\n')) AS BIGINT) AS pictures", "substring_index(block, '\\n', 1) AS first_src",
        "array_contains(problems, 'no alt text') AS without_alt")


_PHONE = "regexp_extract(dom, '(01717863320 or|[+]1 [(][0-9]{3}[)] [0-9]{3}-[0-9]{4})', 1)"


@query("E13_link", page_cte() + f""" SELECT audit_id, concat('<a href="tel:', CASE WHEN starts_with(p, '+') THEN '+' ELSE '' END, regexp_replace(p, '[^0-9]', '', 'g'), '">', p, '</a>') AS code
  FROM (SELECT audit_id, replace({_PHONE}, ' or', '') AS p FROM op WHERE pos = 1 AND {written_phone('dom')}) AS x""")
def dial_links(c):
    rows = evidence.with_snippets(_findings(c, "seo.click_to_call"), c.inputs)
    return rows.select("audit_id", F.explode("snippets").alias("s")).select("audit_id", "s.code")


@query("E40_file", page_cte("security_facts") + """ SELECT audit_id, concat('Contact: mailto:security@', domain, chr(10), 'Expires: 2025-12-31T23:59:59Z') AS code
  FROM security_facts JOIN sites USING (audit_id) WHERE s32 BETWEEN 5 AND 12 AND s28 < 15""")
def security_files(c):
    rows = evidence.with_snippets(_findings(c, "best_practices.security_txt"), c.inputs)
    return rows.select("audit_id", F.explode("snippets").alias("s")).select("audit_id", "s.code")
