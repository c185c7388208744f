"""The 69 checks as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.plans import audit as au
from crawlscore.plans import evidence
from crawlscore.plans.audit import check_results
from crawlscore.plans.side_tables import script_errors
from crawlscore.sources import derived as dv
from crawlscore.suite.corpus import STATUS_OF, query
from crawlscore.suite.oracle_pages import (
    check_sql, count, decoded, first, origin, page_cte, share,
)

CHECK_IDS = [
    "seo.title", "seo.meta_description", "seo.single_h1", "seo.canonical", "seo.robots_txt",
    "seo.sitemap", "seo.indexable", "seo.social_tags", "seo.page_schema", "seo.broken_links",
    "seo.duplicate_titles", "seo.contact_details", "seo.click_to_call", "seo.whatsapp_chat",
    "seo.directions", "seo.heading_structure", "seo.image_seo", "seo.url_structure",
    "seo.meta_tags", "seo.broken_external_links", "seo.broken_images",
    "best_practices.https", "best_practices.http_redirect", "best_practices.mixed_content",
    "best_practices.hsts", "best_practices.csp", "best_practices.nosniff",
    "best_practices.frame_protection", "best_practices.referrer_policy",
    "best_practices.outdated_libraries", "best_practices.doctype", "best_practices.charset",
    "best_practices.viewport", "best_practices.console_errors",
    "best_practices.third_party_cookies", "best_practices.certificate_expiry",
    "best_practices.domain_expiry", "best_practices.email_spoofing",
    "best_practices.exposed_files", "best_practices.security_txt",
    "best_practices.mobile_layout", "best_practices.tap_targets",
    "best_practices.mobile_text_size", "best_practices.call_to_action",
    "best_practices.privacy_policy", "best_practices.social_proof",
    "accessibility.image_alt", "accessibility.html_lang", "accessibility.heading_order",
    "accessibility.form_labels", "accessibility.accessible_names", "accessibility.axe_scan",
    "performance.mobile_speed", "performance.desktop_speed", "performance.core_web_vitals",
    "performance.page_weight", "performance.image_dimensions", "performance.lazy_images",
    "performance.render_blocking", "agentic.llms_txt", "agentic.ai_crawlers",
    "agentic.bot_blocking", "agentic.structured_data", "agentic.landmarks",
    "agentic.named_controls", "agentic.content_without_js", "agentic.answer_ready",
    "agentic.business_identity", "agentic.up_to_date",
]

# --- how the statements read a page ---------------------------------------------------------------
TITLE = first("html", "<title>([^<]*)</title>")
DESC = first("html", "<meta name=\"description\" content=\"([^\"]*)\"")
HAS = "contains({h}, '{t}')"


def has(text: str, html: str = "html") -> str:
    return f"contains({html}, '{text}')"


def agg(columns: str, where: str = "true", ctes: str = "op") -> str:
    return f"SELECT audit_id, {columns} FROM {ctes} WHERE {where} GROUP BY audit_id"


def n(test: str) -> str:
    return f"count(*) FILTER (WHERE {test})"


def home(expr: str) -> str:
    return f"max(CASE WHEN pos = 1 THEN {expr} END)"


def sites(columns: str, joins: str = "") -> str:
    return f"SELECT s.audit_id, {columns} FROM sites s {joins}"


def with_tables(*names: str) -> str:
    return page_cte(*names)


PREVIEW_MISSING = (
    "(CASE WHEN contains(html, '\"og:title\"') THEN 0 ELSE 1 END + "
    "CASE WHEN contains(html, '\"og:description\"') THEN 0 ELSE 1 END + "
    "CASE WHEN contains(html, '\"og:image\"') THEN 0 ELSE 1 END + "
    "CASE WHEN contains(html, '\"twitter:card\"') THEN 0 ELSE 1 END + "
    "CASE WHEN regexp_matches(html, '\"og:image\" content=\"(/|img)') THEN 1 ELSE 0 END)"
)
HEAD_OF = "regexp_extract({h}, '^(?s)(.*)</head>', 1)"
CORE_MISSING = (
    f"({TITLE} = '' OR {DESC} = '' OR NOT contains(lower(html), '<meta name=\"viewport\"') OR "
    "NOT contains(html, '<meta charset') OR NOT contains(html, 'rel=\"canonical\"'))"
)
ROBOTS_OK = "s.s6 >= 3 AND s.s7 >= 1 AND s.s8 NOT IN (8, 9)"
HOME_PATH = "regexp_extract(s.home_url, '^https?://[^/?#]+([^#]*)', 1)"
GOOGLE_OK = (
    f"CASE WHEN s.s8 < 4 THEN false WHEN s.s8 < 8 THEN NOT starts_with({HOME_PATH}, '/The') "
    f"ELSE NOT (starts_with({HOME_PATH}, '/de') OR starts_with({HOME_PATH}, '/fr')) END"
)
SITEMAP_FILE = (
    "CASE WHEN s.s11 >= 14 OR s.s9 >= 14 OR s.s10 < 6 THEN NULL WHEN s.s10 < 7 THEN 0 "
    "WHEN s.s10 < 10 THEN CASE WHEN s.s12 < 12 THEN 1 ELSE 0 END ELSE 2 END"
)
# sites whose robots.txt names other files, or whose homepage is http, never reach the file
READS_SITEMAP = (
    f"CASE WHEN ({ROBOTS_OK}) AND s.s8 >= 10 THEN false WHEN ({ROBOTS_OK}) AND s.s8 >= 4 THEN true "
    "ELSE starts_with(s.home_url, 'https://') END"
)
LINK_OK = (
    "CASE WHEN NOT (r.s6 >= 3 AND r.s7 >= 1 AND r.s8 NOT IN (8, 9)) THEN true WHEN r.s8 < 4 THEN false "
    "WHEN r.s8 < 8 THEN NOT starts_with(lp, '/The') ELSE NOT (starts_with(lp, '/de') OR "
    "starts_with(lp, '/fr')) END"
)
BROKEN = "(status_code IN (0, 404, 410) OR status_code BETWEEN 500 AND 599)"
URL_STATUS = f"""
cut_links AS (SELECT l.audit_id, l.page_id, l.pos, l.ord, regexp_replace(link, '#.*$', '') AS link,
    regexp_extract(regexp_replace(link, '#.*$', ''), '^https?://[^/?#]+(.*)$', 1) AS lp, r.home_url, r.s6, r.s7, r.s8
  FROM link_rows l JOIN sites r ON r.audit_id = l.audit_id),
own_links AS (SELECT audit_id, link, min(pos * 100000 + ord) AS spot FROM cut_links r
  WHERE {origin('link')} = {origin('home_url')} AND {LINK_OK} GROUP BY audit_id, link),
todo AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY spot) AS rn FROM own_links o
  WHERE NOT EXISTS (SELECT 1 FROM op p WHERE p.audit_id = o.audit_id AND (p.final_url = o.link OR p.url = o.link))),
reg AS (SELECT *, regexp_extract(regexp_extract(link, '^https?://([^/?#:]+)', 1), '([^.]+[.][^.]+)$', 1) AS site,
    regexp_extract(audit_id, '([^.]+[.][^.]+)$', 1) AS own_site FROM cut_links),
away AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY spot) AS rn FROM (
  SELECT audit_id, link, min(pos * 100000 + ord) AS spot FROM reg
  WHERE site <> own_site AND site NOT IN ('facebook.com') GROUP BY audit_id, link) AS x),
imgs AS (SELECT audit_id, pos, i.src, i.ord FROM op, LATERAL (SELECT
    unnest(regexp_extract_all(html, '<img[^>]* src="([^"]*)"', 1)) AS src,
    unnest(range(len(regexp_extract_all(html, '<img[^>]* src="([^"]*)"', 1)))) AS ord) AS i),
img_links AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY spot) AS rn FROM (
  SELECT audit_id, CASE WHEN starts_with(src, 'http') THEN src ELSE
    concat({origin('final_url')}, src) END AS link, min(pos * 100000 + ord) AS spot
  FROM (SELECT imgs.*, op.final_url FROM imgs JOIN op USING (audit_id, pos)) AS j
  WHERE src <> '' AND NOT starts_with(src, 'data:') GROUP BY 1, 2) AS y),
url_status AS (
  SELECT DISTINCT audit_id, 'internal' AS kind, final_url AS url, 200 AS status_code FROM op
  UNION ALL SELECT audit_id, 'internal', link, {STATUS_OF.format(u='link')} FROM todo
  UNION ALL SELECT audit_id, 'external', link, {STATUS_OF.format(u='link')} FROM away
  UNION ALL SELECT audit_id, 'image', link, {STATUS_OF.format(u='link')} FROM img_links
)"""


def status_sql(kind: str, rules: list[tuple], na: str, score: str, broken: str, kept: str = "true") -> str:
    facts = sites(
        f"count(u.url) FILTER (WHERE kind = '{kind}' AND {kept}) AS total, count(u.url) FILTER "
        f"(WHERE kind = '{kind}' AND {broken}) AS broken, any_value(s.s8) AS s8",
        "LEFT JOIN url_status u ON u.audit_id = s.audit_id GROUP BY s.audit_id")
    return check_sql(facts, rules, na=na, score=score, gate="s8 < 14",
                     ctes=page_cte("site_probe", hrefs=True) + "," + URL_STATUS)


def contact(html: str) -> str:
    return (f"(contains({html}, 'href=\"tel:') OR contains({html}, 'href=\"mailto:') OR "
            f"{written_phone(html)} OR contains({html}, '+880 1717-863320'))")


def written_phone(html: str) -> str:
    """Numbers in running text: the derived ones and those of the given pages."""
    return (f"(contains({html}, '01717863320 or') OR "
            f"regexp_matches({html}, '[+]1 [(][0-9]{{3}}[)] [0-9]{{3}}-[0-9]{{4}}'))")


DOM_IMGS = "regexp_extract_all(dom, '<img[^>]*>')"
JUDGED = (
    "list_filter(list_transform(" + DOM_IMGS + ", i -> {'src': coalesce(nullif(regexp_extract(i, "
    "' src=\"([^\"]*)\"', 1), ''), regexp_extract(i, 'data-src=\"([^\"]*)\"', 1)), 'has': "
    "contains(i, 'alt='), 'alt': trim(regexp_extract(i, 'alt=\"([^\"]*)\"', 1))}), x -> x.src <> '' "
    "AND NOT starts_with(x.src, 'data:'))"
)
BAD_ALT = ("(NOT x.has OR (x.alt <> '' AND (regexp_matches(lower(x.alt), '^[ .]*(image|photo|banner)"
           "[ .]*$') OR regexp_matches(x.alt, '^DSC [0-9]'))))")
NOTED = "(length(x.alt) > 125 OR regexp_matches(x.src, '(IMG|DSC)_[0-9]+[.]jpg$'))"
OUTLINE = (
    "list_transform(regexp_extract_all(dom, '(?s)<h[1-6][^>]*>.*?</h[1-6]>'), h -> {'level': "
    "CAST(substr(h, 3, 1) AS INT), 'text': trim(regexp_replace(regexp_replace(h, '<img[^>]* ?alt=\"([^\"]*)\"[^>]*>', "
    "'\\1', 'g'), '<[^>]*>', '', 'g'))})"
)
SKIPPED = (
    "len(list_filter(range(1, len({o})), i -> {o}[i + 1].level > {o}[i].level + 1)) > 0"
)
FIELDS = (
    "list_filter(regexp_extract_all(dom, '<(?:input|select|textarea)[^>]*>'), "
    "f -> NOT regexp_matches(f, 'type=\"(hidden|submit|button|image|reset)\"'))"
)
UNLABELLED = (
    f"list_filter({FIELDS}, f -> NOT contains(f, 'id=\"e\"') AND NOT contains(f, 'name=\"n\"') AND NOT "
    "contains(f, 'aria-label='))"
)
ANCHORS = "regexp_extract_all(dom, '(?s)<a href=[^>]*>.*?</a>|<button[^>]*>.*?</button>')"
NAMELESS = (
    f"list_filter({ANCHORS}, a -> trim(regexp_replace(a, '<[^>]*>', '', 'g')) = '' AND NOT "
    "contains(a, 'aria-label='))"
)
PUSH = "regexp_extract_all(dom, '<input[^>]*type=\"submit\"[^>]*>')"
QUESTIONS = (
    "(CASE WHEN contains({h}, '<h2>Prices?</h2>') THEN 2 WHEN contains({h}, '<summary>How much?') THEN 3 "
    "ELSE 0 END)"
)
FAQ = "contains({h}, '\"FAQPage\"')"
KIND = (
    "CASE WHEN pos = 1 THEN 'home' WHEN contains(html, 'content=\"article\"') THEN 'article' "
    "WHEN contains(html, 'product:price:amount') THEN 'product' "
    f"WHEN {QUESTIONS.format(h='html')} >= 3 THEN 'faq' ELSE 'page' END"
)
SCHEMA = (
    "CASE WHEN contains(html, '\"Shop\",}') THEN 'broken' "
    "WHEN kind = 'home' THEN CASE WHEN contains(html, '\"Bakery\"') THEN 'could be richer' WHEN "
    "contains(html, '\"no type\"') THEN 'good' ELSE 'missing' END "
    "WHEN kind = 'page' AND contains(html, '\"WebPage\"') THEN 'good' "
    "WHEN kind = 'faq' AND contains(html, '\"FAQPage\"') THEN 'incomplete' ELSE 'missing' END"
)
OUTDATED = ("(contains(html, 'jquery-3.4.1') OR contains(html, 'bootstrap@4.1.0') OR "
            "contains(html, '/lodash/4.17.20/'))")
VISIBLE = (
    "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({h}, "
    "'(?s)^.*?<body>', ''), '(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->', '', 'g'), "
    "'<[^>]*>', chr(0), 'g'), '(?s)</html>.*$', ''))"
)
MIXED_ACTIVE = ("(contains(html, 'src=\"http://cdn.example.net/bootstrap') OR "
                "contains(html, 'href=\"http://static.example.net'))")
MIXED_PASSIVE = "contains(html, '<img src=\"http://')"
SECURE = "starts_with(final_url, 'https://')"
SPEED = {  # values of the derived speed tests by trait of the strategy
    "score": "CASE WHEN {t} < 5 THEN 0.31 WHEN {t} < 10 THEN 0.72 ELSE 0.96 END",
    "lcp": "CASE WHEN {t} < 6 THEN 5200.5 WHEN {t} < 9 THEN 2900 ELSE 1800 END",
    "cls": "CASE WHEN {t} < 4 THEN 0.31 WHEN {t} < 7 THEN 0.2 ELSE 0.04 END",
    "tbt": "CASE WHEN {t} < 8 THEN 820 ELSE 120 END",
    "fcp": "CASE WHEN {t} < 5 THEN 2400 ELSE 900 END",
    "size": "CASE WHEN {t} < 6 THEN 5452595 WHEN {t} < 11 THEN 3000000 ELSE 900000 END",
}


def speed_facts() -> str:
    """One row per site; `t` picks the phone test if there is one, else the computer test."""
    inner = sites("s.s1, s.s2, s.s3, CASE WHEN s.s2 < 12 THEN s.s1 WHEN s.s2 < 14 THEN s.s3 END AS t")
    values = ", ".join(f"{v.format(t='t')} AS {k}" for k, v in SPEED.items())
    return f"SELECT *, {values} FROM ({inner}) AS x"


def rating(value: str, good: float, poor: float) -> str:
    return f"CASE WHEN {value} <= {good} THEN 1.0 WHEN {value} <= {poor} THEN 0.5 WHEN {value} IS NOT NULL THEN 0.0 END"


def vitals_facts() -> str:
    seen = f"SELECT *, t < 4 AS seen FROM ({speed_facts()}) AS y WHERE true"
    picked = f"""SELECT *, CASE WHEN t < 2 THEN 3100 WHEN t < 4 THEN 2000 ELSE lcp END AS v_lcp,
      CASE WHEN t < 2 THEN 0.05 WHEN t < 4 THEN NULL ELSE cls END AS v_cls,
      CASE WHEN t < 2 THEN 650 END AS v_inp, CASE WHEN t < 4 THEN NULL ELSE tbt END AS v_tbt,
      CASE WHEN t < 2 THEN NULL WHEN t < 4 THEN 1500 ELSE fcp END AS v_fcp FROM ({seen}) AS z"""
    return f"""SELECT *, {rating('v_lcp', 2500, 4000)} AS r_lcp, {rating('v_cls', .1, .25)} AS r_cls,
      {rating('v_inp', 200, 500)} AS r_inp, {rating('v_tbt', 200, 600)} AS r_tbt,
      {rating('v_fcp', 1800, 3000)} AS r_fcp FROM (SELECT audit_id, s1, s2, CASE WHEN t IS NOT NULL THEN v_lcp END AS v_lcp,
      CASE WHEN t IS NOT NULL THEN v_cls END AS v_cls, v_inp, CASE WHEN t IS NOT NULL THEN v_tbt END AS v_tbt,
      CASE WHEN t IS NOT NULL THEN v_fcp END AS v_fcp FROM ({picked}) AS q) AS w"""


def speed_check(strategy: str, trait: str, limit: int) -> str:
    value = SPEED["score"].format(t=trait)
    return check_sql(
        sites(f"s.s2, {value} AS sc"),
        [("slow", "sc < 0.5", "fail", "high", "medium", "1"),
         ("middling", "sc >= 0.5 AND sc < 0.9", "warn", "medium", "medium", "1")],
        gate="s2 < 14", na=f"s2 >= {limit}", score="sc")


RENDERED = "s4 < 13"
HOME_ROW = "SELECT op.*, s.* EXCLUDE (audit_id) FROM op JOIN sites s USING (audit_id) WHERE pos = 1"


def home_check(rules: list[tuple], na: str = "false", score: str = "NULL", gate: str = "true",
               columns: str = "", ctes: str | None = None) -> str:
    facts = f"SELECT *{', ' + columns if columns else ''} FROM ({HOME_ROW}) AS h"
    return check_sql(facts, rules, na=na, score=score, gate=gate, ctes=ctes)


SMALL_SHARE = "(CASE WHEN s17 < 6 THEN 100 WHEN s17 < 10 THEN 400 ELSE 1600 END / 4000.0)"
SMALL_TAPS = "(CASE WHEN s16 < 5 THEN 0 WHEN s16 < 8 THEN 2 ELSE 9 END)"
AXE = [("color-contrast", "s20 < 6", 8, "fail", 1, 0.7), ("region", "s21 < 6", 3, "warn", 2, 0.3),
       ("meta-viewport", "s22 < 3", 1, "fail", 0, 1.0), ("duplicate-id", "s23 < 5", 6, "info", 3, 0.1),
       ("odd-rule", "s25 < 3", 1, "info", 9, 0.3)]

O: dict[str, str | None] = {}
O["seo.title"] = check_sql(
    agg(f"count(*) AS total, {n(TITLE + chr(32) + '= ' + chr(39) * 2)} AS a, {n(f'length({TITLE}) > 60')} AS b, "
        f"{n(f'length({TITLE}) BETWEEN 1 AND 9')} AS c"),
    [("missing", "a > 0", "fail", "high", "low", "a"), ("long", "b > 0", "warn", "low", "low", "b"),
     ("short", "c > 0", "warn", "medium", "low", "c")], score=share("total", "a", "b + c"))
O["seo.meta_description"] = check_sql(
    agg(f"count(*) AS total, {n(DESC + ' = ' + chr(39) * 2)} AS a, "
        f"{n(f'length({DESC}) BETWEEN 1 AND 49 OR length({DESC}) > 160')} AS b"),
    [("missing", "a > 0", "warn", "medium", "low", "a"), ("length", "b > 0", "warn", "low", "low", "b")],
    score=share("total", "0", "2 * a + b"))
O["seo.single_h1"] = check_sql(
    agg(f"count(*) AS total, {n(count('html', '<h1>') + ' = 0')} AS a, {n(count('html', '<h1>') + ' > 1')} AS b"),
    [("none", "a > 0", "warn", "medium", "low", "a"), ("several", "b > 0", "warn", "low", "low", "b")],
    score=share("total", "0", "a + b"))
O["seo.canonical"] = home_check(
    [("none", "k = 0", "warn", "low", "low", "1"), ("several", "k > 1", "warn", "medium", "low", "1"),
     ("relative", "k = 1 AND NOT starts_with(c, 'http')", "warn", "low", "low", "1"),
     ("elsewhere", "k = 1 AND c = 'https://other.example.org/'", "fail", "high", "low", "1")],
    columns="len(list_distinct(regexp_extract_all(html, 'rel=\"canonical\" href=\"([^\"]*)\"', 1))) AS k, "
            "regexp_extract(html, 'rel=\"canonical\" href=\"([^\"]*)\"', 1) AS c")
O["seo.robots_txt"] = check_sql(
    sites(f"({ROBOTS_OK}) AS ok, {GOOGLE_OK} AS g"),
    [("missing", "NOT ok", "warn", "low", "low", "1"),
     ("blocks_google", "ok AND NOT g", "fail", "high", "low", "1")], ctes=page_cte("robots_files"))
O["seo.sitemap"] = check_sql(
    sites(f"({ROBOTS_OK}) AS ok, CASE WHEN {READS_SITEMAP} THEN {SITEMAP_FILE} END AS k, s.s8"),
    [("missing", "k IS NULL", "warn", "medium", "low", "1"), ("empty", "k = 0", "warn", "medium", "low", "1"),
     ("unannounced", "k > 0 AND ok AND s8 < 4", "info", "low", "low", "1")],
    also_pass="k > 0", ctes=page_cte("sitemap_files"))
NOINDEX = "(contains(html, 'content=\"NOINDEX') OR x_robots <> '')"
O["seo.indexable"] = check_sql(
    agg(f"{n(NOINDEX)} AS a, bool_or(pos = 1 AND {NOINDEX}) AS h"),
    [("home", "h", "fail", "high", "low", "a"), ("pages", "NOT h AND a > 0", "info", "low", "low", "a")])
O["seo.social_tags"] = check_sql(
    f"SELECT f.*, p.og_image_url AS u, p.og_image_status AS st, p.og_image_type AS ty, p.og_image_too_big AS big FROM ("
    + agg(f"count(*) AS total, {n(PREVIEW_MISSING + ' > 0')} AS a, bool_or(pos = 1 AND {PREVIEW_MISSING} > 0) AS h")
    + ") f LEFT JOIN site_probe p USING (audit_id)",
    [("incomplete", "a > 0", "warn", "CASE WHEN h THEN 'medium' ELSE 'low' END", "low", "a"),
     ("broken_image", "coalesce(u, '') <> '' AND (st = 0 OR st >= 400 OR ty = '' OR big)", "warn", "medium", "low", "1")],
    score=share("total", "0", "a"), ctes=page_cte("site_probe"))
O["seo.page_schema"] = check_sql(
    f"SELECT audit_id, {n('st = ' + chr(39) + 'broken' + chr(39))} AS a, {n('st IN (' + chr(39) + 'missing' + chr(39) + ', ' + chr(39) + 'incomplete' + chr(39) + ')')} AS b, "
    f"{n('st = ' + chr(39) + 'could be richer' + chr(39))} AS c, bool_or(pos = 1 AND st IN ('missing', 'incomplete')) AS h FROM "
    f"(SELECT *, {SCHEMA} AS st FROM (SELECT *, {KIND} AS kind FROM op) AS k) AS s GROUP BY audit_id",
    [("broken", "a > 0", "fail", "medium", "low", "a"),
     ("lacking", "b > 0", "warn", "CASE WHEN h THEN 'medium' ELSE 'low' END", "low", "b"),
     ("richer", "c > 0", "info", "low", "low", "c")])
O["seo.broken_links"] = status_sql(
    "internal", [("broken", "broken > 0", "fail", "medium", "CASE WHEN broken > 5 THEN 'medium' ELSE 'low' END", "broken")],
    "total <= 1", share("total", "broken"), "(status_code = 0 OR status_code >= 400)")
O["seo.duplicate_titles"] = check_sql(
    f"SELECT audit_id, sum(k) AS total, coalesce(sum(CASE WHEN k > 1 AND t <> '' THEN k END), 0) AS a FROM (SELECT audit_id, "
    f"lower({TITLE}) AS t, count(*) AS k FROM op GROUP BY 1, 2) AS g GROUP BY audit_id",
    [("shared", "a > 0", "warn", "medium", "low", "a")], na="total < 2")
O["seo.contact_details"] = check_sql(
    agg(f"bool_or(pos = 1 AND ({contact('dom')} OR contains(dom, 'hello@shop.example'))) AS h, "
        f"{n('pos > 1 AND ' + contact('html'))} AS e"),
    [("elsewhere", "NOT h AND e > 0", "info", "low", "low", "e"),
     ("none", "NOT h AND e = 0", "warn", "high", "low", "1")])
O["seo.click_to_call"] = home_check(
    [("plain_text", written_phone("dom"), "warn", "medium", "low", "1")],
    na=f"NOT {written_phone('dom')} AND NOT contains(dom, 'href=\"tel:')")
O["seo.whatsapp_chat"] = home_check(
    [("none", "NOT contains(dom, '//wa.me/')", "info", "low", "low", "0")])
O["seo.directions"] = check_sql(
    agg("bool_or(contains(dom, 'google.com/maps')) AS m"), [("none", "NOT m", "info", "low", "low", "0")])
O["seo.heading_structure"] = check_sql(
    f"""SELECT audit_id, {n('len(o) > 0')} AS total, {n('bad')} AS a, {n('note')} AS b, bool_or(pos = 1 AND bad) AS h FROM (
      SELECT p.*, len(list_filter(o, x -> x.text = '')) > 0 OR (len(h1) > 0 AND o[1].level <> 1) OR EXISTS (
        SELECT 1 FROM shared s WHERE s.audit_id = p.audit_id AND list_contains(h1, s.t)) AS bad,
        len(o) > 0 AND (len(h1) <> 1 OR {SKIPPED.format(o='o')} OR len(list_filter(h1, t -> length(t) > 70)) > 0 OR
          (words >= 300 AND len(list_filter(o, x -> x.level = 2)) = 0)) AS note
      FROM outlined p) AS q GROUP BY audit_id""",
    [("serious", "a > 0", "warn", "CASE WHEN h THEN 'medium' ELSE 'low' END", "low", "a"),
     ("notes", "a = 0 AND b > 0", "info", "low", "low", "b")], na="total = 0", score=share("total", "0", "a"),
    ctes=page_cte() + f""",
outlined AS (SELECT *, list_transform(list_filter(o, x -> x.level = 1), x -> lower({decoded('x.text')})) AS h1 FROM (
  SELECT audit_id, pos, {OUTLINE} AS o, len(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(dom,
    '(?s)^.*?<body>', ''), '<!--.*?-->', '', 'g'), '</?(p|br|b|li|ul|nav|div|article|h1|h2|h3|h4|footer|img|form|input|label|a|button|body|html|iframe|details|summary|textarea|select|header|script)( [^>]*)?>', ' ', 'g'),
    '\\s+'), w -> w <> '')) AS words FROM op) AS z),
shared AS (SELECT audit_id, t FROM (SELECT audit_id, unnest(h1) AS t FROM outlined) AS u WHERE t <> '' GROUP BY 1, 2 HAVING count(*) > 1)""")
O["seo.image_seo"] = check_sql(
    f"SELECT audit_id, sum(len(j)) AS total, sum(len(list_filter(j, x -> {BAD_ALT}))) AS a, "
    f"sum(len(list_filter(j, x -> NOT {BAD_ALT} AND {NOTED}))) AS b, {n(f'len(list_filter(j, x -> {BAD_ALT})) > 0')} AS pa, "
    f"{n(f'len(list_filter(j, x -> NOT {BAD_ALT} AND {NOTED})) > 0')} AS pb FROM (SELECT audit_id, {JUDGED} AS j FROM op) AS q GROUP BY audit_id",
    [("bad_alt", "a > 0", "warn", "medium", "CASE WHEN a > 10 THEN 'medium' ELSE 'low' END", "pa"),
     ("notes", "a = 0 AND b > 0", "info", "low", "low", "pb")], na="total = 0", score=share("total", "0", "a"))
ADDRESSES = f"""
found AS (SELECT DISTINCT audit_id, final_url AS a FROM op UNION SELECT l.audit_id, l.link FROM cut l JOIN sites s USING (audit_id)
  WHERE {origin('l.link')} = {origin('s.home_url')} OR replace({origin('l.link')}, 'http://', 'https://') = {origin('s.home_url')}),
judged_urls AS (SELECT f.audit_id, a, p, regexp_matches(p, '\\p{{Lu}}') OR contains(p, '_') OR contains(p, '%20') OR contains(p, ' ') OR contains(p, '+')
    OR contains(p, '//') OR contains(a, 'PHPSESSID') OR (starts_with(s.home_url, 'https') AND starts_with(a, 'http:')) AS bad,
    length(a) > 115 OR len(list_filter(string_split(p, '/'), x -> x <> '')) > 4 OR regexp_matches(lower(p), '[.](php|html)$') AS note
  FROM (SELECT *, regexp_extract(a, '^https?://[^/?#]+([^?]*)', 1) AS p FROM found) f JOIN sites s USING (audit_id))"""
O["seo.url_structure"] = check_sql(
    f"SELECT audit_id, count(*) AS total, {n('bad')} AS a, {n('note')} AS b FROM judged_urls GROUP BY audit_id",
    [("bad", "a > 0", "warn", "low", "medium", "a"), ("notes", "a = 0 AND b > 0", "info", "low", "low", "b")],
    score=share("total", "0", "a"),
    ctes=page_cte(hrefs=True) + ", cut AS (SELECT audit_id, regexp_replace(link, '#.*$', '') AS link FROM link_rows)," + ADDRESSES)
O["seo.meta_tags"] = check_sql(
    agg(f"count(*) AS total, {n(CORE_MISSING)} AS a, {n(f'NOT {CORE_MISSING} AND NOT contains(html, {chr(39)}<html lang{chr(39)})')} AS b, "
        f"{n(has('http-equiv=' + chr(34) + 'refresh'))} AS c"),
    [("missing", "a > 0", "warn", "medium", "low", "a"), ("no_language", "a = 0 AND b > 0", "info", "low", "low", "b"),
     ("refresh", "c > 0", "warn", "low", "low", "c")], score=share("total", "0", "a + c"))
O["seo.broken_external_links"] = status_sql(
    "external", [("broken", "broken > 0", "warn", "low", "low", "broken")], "total = 0", share("total", "broken"),
    BROKEN, f"(status_code BETWEEN 200 AND 399 OR {BROKEN})")
O["seo.broken_images"] = status_sql(
    "image", [("broken", "broken > 0", "fail", "medium", "low", "broken")], "total = 0", share("total", "broken"), BROKEN)
O["best_practices.https"] = home_check([("insecure", f"NOT {SECURE}", "fail", "high", "medium", "1")])
O["best_practices.http_redirect"] = home_check(
    [("silent", "s5 >= 12", "info", "low", "low", "0"),
     ("stays", "s5 BETWEEN 9 AND 11", "warn", "medium", "low", "1")], na=f"NOT {SECURE}", gate="s8 < 14")
O["best_practices.mixed_content"] = check_sql(
    agg(f"count(*) AS total, {n(MIXED_ACTIVE)} AS a, {n(MIXED_PASSIVE)} AS b, {n(MIXED_ACTIVE + ' OR ' + MIXED_PASSIVE)} AS c",
        SECURE) + " UNION ALL SELECT audit_id, 0, 0, 0, 0 FROM op GROUP BY audit_id HAVING count(*) FILTER (WHERE " + SECURE + ") = 0",
    [("active", "a > 0", "fail", "high", "low", "c"), ("passive", "a = 0 AND b > 0", "warn", "medium", "low", "b")], na="total = 0")
O["best_practices.hsts"] = home_check(
    [("missing", "hsts = ''", "warn", "medium", "low", "1"), ("short", "hsts = 'max-age=600'", "warn", "low", "low", "1")],
    na=f"NOT {SECURE}")
CSP = "(csp <> '' OR contains(html, 'http-equiv=\"Content-Security-Policy\"'))"
O["best_practices.csp"] = home_check(
    [("test_mode", f"NOT {CSP} AND csp_report_only <> ''", "info", "low", "low", "0"),
     ("missing", f"NOT {CSP} AND csp_report_only = ''", "warn", "medium", "medium", "1")])
O["best_practices.nosniff"] = home_check([("missing", "nosniff <> 'NoSniff'", "warn", "low", "low", "1")])
O["best_practices.frame_protection"] = home_check(
    [("missing", "xfo <> 'sameorigin' AND NOT contains(csp, 'frame-ancestors')", "warn", "medium", "low", "1")])
O["best_practices.referrer_policy"] = home_check(
    [("unsafe", "CASE WHEN referrer_policy <> '' THEN referrer_policy = 'Unsafe-URL' WHEN contains(html, 'name=\"referrer\"') "
      "THEN contains(html, 'unsafe-url') ELSE true END", "warn", "low", "low", "1")])
O["best_practices.outdated_libraries"] = check_sql(
    f"SELECT f.*, r FROM (" + agg(f"{n(OUTDATED)} AS a, bool_or(pos = 1 AND {OUTDATED}) AS h") +
    ") f JOIN (SELECT audit_id, s4 < 13 AND s3 < 4 AS r FROM sites) AS x USING (audit_id)",
    [("outdated", "a > 0 OR r", "fail", "medium", "medium", "a + CASE WHEN r AND NOT h THEN 1 ELSE 0 END")])
O["best_practices.doctype"] = check_sql(
    agg(f"{n('NOT contains(html, ' + chr(39) + '<!DOCTYPE html>' + chr(39) + ')')} AS a"),
    [("missing", "a > 0", "warn", "low", "low", "a")])
O["best_practices.charset"] = check_sql(
    agg(f"{n('NOT contains(content_type, ' + chr(39) + 'charset' + chr(39) + ') AND NOT contains(html, ' + chr(39) + '<meta charset' + chr(39) + ')')} AS a"),
    [("missing", "a > 0", "warn", "low", "low", "a")])
O["best_practices.viewport"] = home_check(
    [("missing", "NOT contains(lower(html), 'name=\"viewport\"')", "fail", "high", "low", "1"),
     ("fixed", "contains(html, 'width=1024')", "warn", "medium", "low", "1")])
O["best_practices.console_errors"] = home_check([("errors", "s2 < 4", "warn", "medium", "medium", "1")], gate=RENDERED)
O["best_practices.third_party_cookies"] = home_check(
    [("cookies", "s12 < 6", "warn", "medium", "medium", "1")], gate=RENDERED)
_CERT = "CASE WHEN s26 < 5 THEN NULL WHEN s26 < 8 THEN 200 WHEN s26 < 11 THEN 12 WHEN s26 < 13 THEN 5 ELSE -3 END"
O["best_practices.certificate_expiry"] = home_check(
    [("invalid", "s26 < 2", "fail", "high", "medium", "1"), ("ends_now", f"({_CERT}) <= 7", "fail", "high", "low", "1"),
     ("ends_soon", f"({_CERT}) = 12", "warn", "high", "low", "1")],
    na=f"NOT {SECURE} OR (s26 BETWEEN 2 AND 4)", gate="s28 < 15")
O["best_practices.domain_expiry"] = home_check(
    [("unknown", "s27 < 4", "info", "low", "low", "0"), ("ends_now", "s27 >= 12", "fail", "high", "low", "1"),
     ("ends_soon", "s27 BETWEEN 8 AND 11", "warn", "high", "low", "1")], gate="s28 < 15")
O["best_practices.email_spoofing"] = home_check(
    [("missing", "s29 >= 8 OR s30 >= 10", "warn", "medium", "low", "1"),
     ("only_reports", "s29 < 8 AND s30 BETWEEN 5 AND 9", "info", "medium", "low", "1")], na="s28 >= 13", gate="s28 < 15")
O["best_practices.exposed_files"] = home_check(
    [("exposed", "s31 < 4", "fail", "high", "medium", "1")], na="s31 >= 13", gate="s28 < 15")
O["best_practices.security_txt"] = home_check(
    [("missing", "s32 BETWEEN 5 AND 12", "info", "low", "low", "0")], na="s32 >= 13", gate="s28 < 15")
O["best_practices.mobile_layout"] = home_check(
    [("phone_zoomed", "s14 < 3", "fail", "high", "medium", "1"),
     ("phone_sideways", "s14 >= 3 AND s15 < 4", "fail", "high", "medium", "1"),
     ("tablet_zoomed", "s4 < 12 AND s19 < 2", "warn", "medium", "medium", "1"),
     ("tablet_sideways", "s4 < 12 AND s19 BETWEEN 2 AND 5", "warn", "medium", "medium", "1")], gate=RENDERED)
O["best_practices.tap_targets"] = home_check(
    [("zoomed", "s14 < 3", "warn", "medium", "low", "1"),
     ("small", f"s14 >= 3 AND {SMALL_TAPS} > 0", f"CASE WHEN {SMALL_TAPS} = 9 THEN 'warn' ELSE 'info' END",
      f"CASE WHEN {SMALL_TAPS} = 9 THEN 'medium' ELSE 'low' END", "low", "1")],
    na="s16 < 1", gate=RENDERED, score=f"CASE WHEN s14 >= 3 THEN {share('40', '0', SMALL_TAPS)} END")
O["best_practices.mobile_text_size"] = home_check(
    [("zoomed", "s14 < 3", "warn", "medium", "low", "1"), ("much_small", "s14 >= 3 AND s17 >= 10", "warn", "medium", "low", "1"),
     ("some_small", "s14 >= 3 AND s17 BETWEEN 6 AND 9", "info", "low", "low", "1")],
    na="s17 < 1", gate=RENDERED, score=f"CASE WHEN s14 >= 3 THEN 1 - {SMALL_SHARE} END")
O["best_practices.call_to_action"] = home_check(
    [("none", "s18 < 4 OR s18 >= 11", "warn", "high", "low", "1")], gate=RENDERED)
FORM = "(contains({h}, 'type=\"email\"') OR contains({h}, '<textarea>'))"
O["best_practices.privacy_policy"] = check_sql(
    agg(f"bool_or(pos = 1 AND contains(lower(dom), 'privacy')) AS p, {n(FORM.format(h='dom'))} AS f"),
    [("forms", "NOT p AND f > 0", "warn", "medium", "low", "f"), ("none", "NOT p AND f = 0", "info", "low", "low", "0")])
O["best_practices.social_proof"] = home_check(
    [("none", "NOT (contains(dom, 'aggregateRating') OR contains(dom, 'What our customers say'))", "info", "medium", "low", "0")])
MISSING_ALT = f"len(list_filter({DOM_IMGS}, i -> NOT contains(i, 'alt=')))"
O["accessibility.image_alt"] = check_sql(
    agg(f"sum(len({DOM_IMGS})) AS total, sum({MISSING_ALT}) AS a, {n(MISSING_ALT + ' > 0')} AS p"),
    [("missing", "a > 0", "fail", "high", "CASE WHEN a > 10 THEN 'medium' ELSE 'low' END", "p")],
    na="total = 0", score=share("total", "a"))
O["accessibility.html_lang"] = home_check(
    [("missing", "lang = ''", "fail", "medium", "low", "1"),
     ("invalid", "lang <> '' AND NOT regexp_matches(lang, '^[a-zA-Z]{2,3}(-[a-zA-Z0-9]{2,8})*$')", "warn", "low", "low", "1")],
    columns="regexp_extract(dom, '<html lang=\"([^\"]*)\"', 1) AS lang")
O["accessibility.heading_order"] = check_sql(
    f"SELECT audit_id, {n('len(o) > 0')} AS total, {n(SKIPPED.format(o='o'))} AS a FROM (SELECT audit_id, {OUTLINE} AS o FROM op) AS q GROUP BY audit_id",
    [("skipped", "a > 0", "warn", "low", "low", "a")], na="total = 0", score=share("total", "0", "a"))
O["accessibility.form_labels"] = check_sql(
    agg(f"sum(len({FIELDS})) AS total, sum(len({UNLABELLED})) AS a, {n(f'len({UNLABELLED}) > 0')} AS p"),
    [("unlabelled", "a > 0", "fail", "high", "low", "p")], na="total = 0", score=share("total", "a"))
BAD_PUSH = f"len(list_filter({PUSH}, b -> NOT contains(b, 'value=')))"
O["accessibility.accessible_names"] = check_sql(
    agg(f"sum(len({ANCHORS}) + len({PUSH})) AS total, sum(len({NAMELESS}) + {BAD_PUSH}) AS a, {n(f'len({NAMELESS}) + {BAD_PUSH} > 0')} AS p"),
    [("nameless", "a > 0", "warn", "medium", "low", "p")], na="total = 0", score=share("total", "0", "a"))
_AXE_LIST = "list_sort(list_filter([" + ", ".join(
    f"CASE WHEN {bad} THEN {{'rank': {rank}, 'id': '{i}', 'sev': '{sev}', 'nodes': {nodes}}} END" for i, bad, nodes, sev, rank, _ in AXE) + "], x -> x IS NOT NULL))"
O["accessibility.axe_scan"] = f"""{page_cte()},
judged AS (SELECT audit_id, s4 < 13 AS ran, {_AXE_LIST} AS v, greatest(0, (5 - ({' + '.join(f'CASE WHEN {b} THEN {p} ELSE 0 END' for _, b, _, _, _, p in AXE)})) / 5) AS part FROM sites),
flat AS (SELECT audit_id, ran, part, x.w AS v, x.o AS o FROM judged, LATERAL (SELECT unnest(CASE WHEN ran AND len(v) > 0 THEN v ELSE [NULL] END) AS w,
  unnest(CASE WHEN ran AND len(v) > 0 THEN range(1, len(v) + 1) ELSE [0] END) AS o) AS x)
SELECT audit_id, CASE WHEN ran THEN 'ran' ELSE 'skipped' END AS status, round(CASE WHEN ran THEN part END, 6)::DOUBLE AS score,
  CASE WHEN ran THEN o::INT END AS finding_ord, CASE WHEN ran THEN coalesce(v.id, 'pass') END AS code, CASE WHEN ran THEN coalesce(v.sev, 'pass') END AS severity,
  CASE WHEN ran THEN CASE WHEN v.sev = 'fail' THEN 'high' ELSE 'low' END END AS impact,
  CASE WHEN ran THEN CASE WHEN v.nodes > 5 THEN 'medium' ELSE 'low' END END AS effort,
  CASE WHEN ran THEN CASE WHEN v.id IS NULL THEN 0 ELSE 1 END::BIGINT END AS affected FROM flat"""
O["performance.mobile_speed"] = speed_check("mobile", "s.s1", 12)
O["performance.desktop_speed"] = speed_check("desktop", "s.s3", 14)
_R = ["lcp", "cls", "inp", "tbt", "fcp"]
_N = {"lcp": "lcp_ms", "cls": "cls", "inp": "inp_ms", "tbt": "tbt_ms", "fcp": "fcp_ms"}
O["performance.core_web_vitals"] = check_sql(
    vitals_facts(),
    [(_N[r], f"r_{r} < 1", f"CASE WHEN r_{r} = 0 THEN 'fail' ELSE 'warn' END", f"CASE WHEN r_{r} = 0 THEN 'high' ELSE 'medium' END", "medium", "1") for r in _R],
    gate="s2 < 14", score="list_avg(list_filter([" + ", ".join(f"r_{r}::DOUBLE" for r in _R) + "], x -> x IS NOT NULL))")
O["performance.page_weight"] = check_sql(
    speed_facts(), [("heavy", "size > 4194304", "fail", "medium", "medium", "1"),
                    ("weighty", "size > 2097152 AND size <= 4194304", "warn", "medium", "medium", "1")], gate="s2 < 14")
REAL = f"list_filter({DOM_IMGS}, i -> NOT contains(i, 'src=\"data:'))"
UNSIZED = f"list_filter({REAL}, i -> NOT (contains(i, 'width=') AND contains(i, 'height=')))"
O["performance.image_dimensions"] = check_sql(
    agg(f"sum(len({REAL})) AS total, sum(len({UNSIZED})) AS a, {n(f'len({UNSIZED}) > 0')} AS p"),
    [("unsized", "a > 0", "warn", "medium", "low", "p")], na="total = 0", score=share("total", "0", "a"))
O["performance.lazy_images"] = check_sql(
    "SELECT f.*, s1, s2 FROM (" + agg(f"{n(f'len({REAL}) >= 4')} AS c, {n(f'len({REAL}) >= 4 AND NOT contains(dom, {chr(39)}loading={chr(39)})')} AS e") +
    ") f JOIN sites USING (audit_id)",
    [("offscreen", "s2 < 12 AND s1 < 9", "warn", "medium", "low", "1"), ("eager", "s2 >= 12 AND e > 0", "warn", "low", "low", "e")],
    na="s2 >= 12 AND c = 0")
O["performance.render_blocking"] = home_check(
    [("measured", "s2 < 12 AND s1 < 7", "warn", "CASE WHEN s1 < 3 THEN 'medium' ELSE 'low' END", "medium", "1"),
     ("scripts", "s2 >= 12 AND (contains(html, 'jquery-3.4.1') OR contains(html, 'bootstrap@4'))", "warn", "low", "low", "1")])
O["agentic.llms_txt"] = check_sql(
    sites("s.s6, s.s8"), [("missing", "s6 >= 7", "warn", "medium", "low", "1"), ("no_heading", "s6 BETWEEN 4 AND 6", "info", "low", "low", "0")],
    gate="s8 < 14", also_pass="s6 < 7")
_GPT_BLOCKED = f"CASE WHEN s.s8 < 8 THEN true ELSE (starts_with({HOME_PATH}, '/de') OR starts_with({HOME_PATH}, '/fr')) END"
_OAI_BLOCKED = f"NOT ({GOOGLE_OK})"
O["agentic.ai_crawlers"] = check_sql(
    sites(f"({ROBOTS_OK}) AS ok, ({_GPT_BLOCKED}) AS g, ({_OAI_BLOCKED}) AS o"),
    [("search", "ok AND (g OR o)", "fail", "high", "low", "1"), ("training", "ok AND (g OR o)", "info", "low", "low", "1")])
_AI_BLOCKED, _BR_BLOCKED = "(s9 < 4 OR s11 = 0)", "(s9 < 2)"
O["agentic.bot_blocking"] = home_check(
    [("only_assistants", f"{_AI_BLOCKED} AND NOT {_BR_BLOCKED}", "fail", "high", "low", "1"),
     ("everyone", f"{_AI_BLOCKED} AND {_BR_BLOCKED}", "warn", "medium", "low", "1"),
     ("shorter", f"NOT {_AI_BLOCKED} AND s10 < 4", "warn", "medium", "low", "1")], na="s8 >= 13", gate="s8 < 14")
O["agentic.structured_data"] = home_check(
    [("none", "NOT contains(dom, 'ld+json') OR contains(dom, '\"Shop\",}')", "warn", "medium", "medium", "1")])
_LM = ("(CASE WHEN contains(dom, 'role=\"main\"') THEN 0 ELSE 1 END + CASE WHEN contains(dom, '<nav') THEN 0 ELSE 1 END + "
       "CASE WHEN contains(dom, '<header') THEN 0 ELSE 1 END + CASE WHEN contains(dom, '<footer') THEN 0 ELSE 1 END)")
O["agentic.landmarks"] = home_check(
    [("missing", f"{_LM} > 0", "warn", "CASE WHEN contains(dom, 'role=\"main\"') THEN 'low' ELSE 'medium' END", "low", "1")],
    score=f"1 - {_LM} / 4.0")
O["agentic.named_controls"] = home_check(
    [("nameless", f"len({NAMELESS}) > 0", "warn", "medium", "low", "1")], na=f"len({ANCHORS}) = 0",
    score=f"1 - len({NAMELESS}) / len({ANCHORS})::DOUBLE")
_VIS = ("len(array_to_string(list_filter(list_transform(string_split({t}, chr(1)), x -> trim(x)), x -> x <> ''), ' '))")
_BODY = ("replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace({h}, '(?s)^.*?<body>', ''), "
         "'(?s)<script.*?</script>|<!--.*?-->', chr(1), 'g'), '</?[a-z][^>]*>', chr(1), 'g'), '&middot;', '·'), '&copy;', '©'), "
         "'&quot;', '\"'), '&amp;', '&')")
_RATIO = f"least(1, {_VIS.format(t=_BODY.format(h='html'))} / (CASE WHEN s1 < 2 THEN 100 WHEN s1 < 5 THEN 20000 WHEN s1 < 8 THEN 5000 ELSE 1500 END)::DOUBLE)"
O["agentic.content_without_js"] = home_check(
    [("partly", "q >= 0.3 AND q < 0.7", "warn", "medium", "high", "1"), ("hardly", "q < 0.3", "fail", "high", "high", "1")],
    na="s1 < 2", gate=RENDERED, score="q", columns=f"{_RATIO} AS q")
O["agentic.answer_ready"] = check_sql(
    agg(f"bool_or({QUESTIONS.format(h='dom')} >= 2 OR {FAQ.format(h='dom')}) AS a"), [("none", "NOT a", "warn", "medium", "low", "1")])
_ABOUT = "contains(dom, '>About us<')"
_SOC = "contains(dom, 'facebook.com/shop')"
O["agentic.business_identity"] = home_check(
    [("missing", f"NOT ({_ABOUT} AND {_SOC})", f"CASE WHEN NOT {_ABOUT} AND NOT {_SOC} THEN 'warn' ELSE 'info' END", "medium", "low", "1")])
O["agentic.up_to_date"] = home_check(
    [("old", "contains(dom, 'Copyright 2021')", "warn", "medium", "low", "1")],
    na="NOT contains(dom, '<p>Copyright 20')")


def _register(number: int, check_id: str) -> None:
    @query(f"E{number}", O.get(check_id))
    def run(c):
        rows = check_results(c.inputs, [check_id])
        return rows.selectExpr(
            "audit_id", "status", "round(score, 6) AS score", "explode_outer(findings) AS f"
        ).selectExpr(
            "audit_id", "status", "score", "f.finding_ord", "f.code", "f.severity", "f.impact",
            "f.effort", "f.affected")


for _number, _check_id in enumerate(CHECK_IDS, start=1):
    _register(_number, _check_id)


@query("E34_errors", dv.with_clause("renders") + """ SELECT DISTINCT audit_id, unnest(string_split(console_errors, '|')) AS error FROM renders WHERE console_errors <> ''""")
def errors(c):
    return script_errors(c.renders)


# --- evidence of findings, as rows -----------------------------------------------------------------
def _findings(c, *checks: str):
    return au.findings(check_results(c.inputs, list(checks)))


LIBRARY_ROWS = f"""
found AS (
  SELECT audit_id, 'jQuery' AS library, '3.4.1' AS version, '3.5.0' AS safe_version, final_url FROM op WHERE contains(html, 'jquery-3.4.1')
  UNION ALL SELECT audit_id, 'Bootstrap', '4.1.0', '4.3.1', final_url FROM op WHERE contains(html, 'bootstrap@4.1.0')
  UNION ALL SELECT audit_id, 'Lodash', '4.17.20', '4.17.21', final_url FROM op WHERE contains(html, '/lodash/4.17.20/')
  UNION ALL SELECT r.audit_id, 'jQuery', r.jquery_version, '3.5.0', p.final_url FROM renders r JOIN op p ON p.audit_id = r.audit_id AND p.pos = 1
    WHERE r.jquery_version IN ('3.4.0', '3.4.1'))"""


@query("E30_libraries", page_cte() + "," + LIBRARY_ROWS + " SELECT audit_id, library, version, safe_version, count(DISTINCT final_url) AS pages FROM found GROUP BY ALL")
def libraries(c):
    return evidence.library_list(c.inputs).drop("note")


@query("E30_pages", page_cte() + "," + LIBRARY_ROWS + " SELECT DISTINCT audit_id, library, version, safe_version, final_url FROM found")
def library_pages(c):
    return evidence.outdated_libraries(c.inputs)


@query("E2_lengths", page_cte() + f""" SELECT audit_id, page_id, length({DESC}) AS length, CASE WHEN length({DESC}) > 160 THEN length({DESC}) - 160 ELSE length({DESC}) - 50 END AS off_by
  FROM op WHERE length({DESC}) BETWEEN 1 AND 49 OR length({DESC}) > 160""")
def lengths(c):
    return evidence.description_lengths(c.inputs).select("audit_id", F.col("page_key.id").alias("page_id"), "length", "off_by")


@query("E67_page", page_cte() + f""", q AS (SELECT audit_id, pos, final_url, greatest({QUESTIONS.format(h='dom')}, CASE WHEN {FAQ.format(h='dom')} THEN 2 ELSE 0 END) AS k FROM op)
  SELECT audit_id, arg_min(final_url, (-k, pos)) AS final_url, max(k)::BIGINT AS answers, max(k) >= 2 AS enough FROM q WHERE k > 0 GROUP BY audit_id""")
def answer_pages(c):
    return evidence.best_answer_pages(c.inputs)


_NUMBER = ("CASE WHEN contains(dom, 'href=\"tel:') THEN regexp_replace(regexp_extract(dom, 'href=\"tel:([^\"]*)\"', 1), '[^0-9]', '', 'g') "
           "WHEN regexp_matches(dom, 'Ring 01717863320') THEN '01717863320' END")


@query("E14_link", page_cte() + f""" SELECT audit_id, concat('<a href="https://wa.me/', coalesce({_NUMBER}, '8801XXXXXXXXX'), '?text=Hi%2C%20I%20have%20a%20question">Chat on WhatsApp</a>') AS code
  FROM op WHERE pos = 1 AND NOT contains(dom, '//wa.me/')""")
def chat_links(c):
    rows = evidence.with_snippets(_findings(c, "seo.whatsapp_chat"), c.inputs)
    return rows.select("audit_id", F.explode("snippets").alias("s")).select("audit_id", "s.code")


@query("E38_records", page_cte("security_facts") + """, r AS (
  SELECT audit_id, 1 AS snippet_ord, concat('SPF: a TXT record on ', domain) AS title, CASE WHEN coalesce(has_mx, false) THEN 'v=spf1 include:_spf.google.com ~all' ELSE 'v=spf1 -all' END AS code FROM security_facts WHERE dns_checked AND spf = ''
  UNION ALL SELECT audit_id, 2, concat('DMARC: a TXT record on _dmarc.', domain), concat('v=DMARC1; p=quarantine; rua=mailto:dmarc@', domain) FROM security_facts WHERE dns_checked AND (dmarc = '' OR contains(dmarc, 'none')))
SELECT * FROM r""")
def mail_records(c):
    rows = evidence.with_snippets(_findings(c, "best_practices.email_spoofing"), c.inputs)
    return rows.select("audit_id", F.explode("snippets").alias("s")).select("audit_id", "s.snippet_ord", "s.title", "s.code")
