"""Structured-data operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscore.functions import jsonld as jl
from crawlscore.operators import structured as sd
from crawlscore.operators.checks.features import FEATURES, layered
from crawlscore.suite.checks import KIND, SCHEMA
from crawlscore.suite.corpus import query
from crawlscore.suite.oracle_pages import first, origin, page_cte

ITEMS = "unnest(CASE WHEN contains(html, '\"Bakery\"') THEN ['Bakery', 'WebSite'] WHEN contains(html, '[\"Product\"') THEN ['Product,Thing'] WHEN contains(html, 'NewsArticle') THEN ['NewsArticle'] " \
        "WHEN contains(html, '\"FAQPage\"') THEN ['FAQPage'] WHEN contains(html, '\"WebPage\"') THEN ['WebPage', 'BreadcrumbList'] WHEN contains(html, '\"LocalBusiness\"') THEN ['LocalBusiness', 'Review'] " \
        "WHEN contains(html, '\"Service\"') THEN ['Service'] WHEN contains(html, '\"no type\"') THEN ['Organization', 'WebSite'] ELSE [] END)"


def _items(c):
    return layered(c.docs, FEATURES, {"json_items", "json_broken"}).selectExpr(
        "page_key.id AS page_id", "json_items", "json_broken")


@query("F1", page_cte() + f" SELECT page_id, {KIND} AS kind FROM op")
def kinds(c):
    return sd.page_kinds(c.docs).selectExpr("page_key.id AS page_id", "kind")


@query("F2", page_cte() + f""" SELECT page_id, string_agg(t, ';' ORDER BY i) AS items, bool_or(b) AS broken FROM (SELECT page_id, contains(html, '"Shop",}}') AS b, t, i FROM op LEFT JOIN (SELECT page_id, {ITEMS} AS t, unnest(range(1, 3)) AS i FROM op) AS x USING (page_id)) AS y GROUP BY page_id""")
def items(c):
    return _items(c).selectExpr(
        "page_id", "nullif(array_join(transform(json_items, i -> array_join(i.types, ',')), ';'), '') AS items",
        "json_broken AS broken")


@query("F3", page_cte() + f" SELECT page_id, unnest(string_split(t, ',')) AS type FROM (SELECT page_id, {ITEMS} AS t FROM op) AS x WHERE t IS NOT NULL")
def types(c):
    return _items(c).selectExpr("page_id", "explode(flatten(transform(json_items, i -> i.types))) AS type")


_FAMILY = "CASE t WHEN 'Bakery' THEN 'LocalBusiness' WHEN 'NewsArticle' THEN 'Article' WHEN 'Thing' THEN NULL WHEN 'Review' THEN NULL ELSE t END"


@query("F4", page_cte() + f" SELECT t AS type, {_FAMILY} AS family, count(*) AS n FROM (SELECT unnest(string_split(t, ',')) AS t FROM (SELECT {ITEMS} AS t FROM op) AS x WHERE t IS NOT NULL) AS y GROUP BY 1, 2")
def families(c):
    found = _items(c).selectExpr("explode(flatten(transform(json_items, i -> i.types))) AS type")
    return found.selectExpr("type", f"{jl.family('type')} AS family").groupBy("type", "family").agg(
        F.count("*").alias("n"))


_LACKS = {
    "Bakery": ("", "openingHoursSpecification,image"), "WebSite": ("", ""),
    "Product,Thing": ("offers.priceCurrency", "description,sku"),
    "NewsArticle": ("image,author.name", "dateModified,publisher"),
    "FAQPage": ("mainEntity (each Question needs a name and an acceptedAnswer.text)", ""),
    "WebPage": ("", ""), "BreadcrumbList": ("", ""),
    "LocalBusiness": ("address", "url,telephone,openingHoursSpecification,image"), "Review": ("", ""),
    "Service": ("", "description"), "Organization": ("", ""),
}
_REQ = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v[0]}'" for k, v in _LACKS.items()) + " END"
_REC = "CASE t " + " ".join(f"WHEN '{k}' THEN '{v[1]}'" for k, v in _LACKS.items()) + " END"


@query("F5", page_cte() + f" SELECT page_id, t AS types, {_REQ} AS required, {_REC} AS recommended FROM (SELECT page_id, {ITEMS} AS t FROM op) AS x WHERE t IS NOT NULL")
def lacking(c):
    rows = _items(c).selectExpr("page_id", "explode(json_items) AS i")
    return rows.selectExpr("page_id", "i.types", f"{jl.missing_properties('i')} AS m").selectExpr(
        "page_id", "array_join(types, ',') AS types", "array_join(m.required, ',') AS required",
        "array_join(m.recommended, ',') AS recommended")


@query("F6", page_cte() + """ SELECT page_id, CASE WHEN contains(html, '["Product"') THEN 'offers.priceCurrency' WHEN contains(html, 'NewsArticle') THEN 'author.name' ELSE 'mainEntity (each Question needs a name and an acceptedAnswer.text)' END AS fault
  FROM op WHERE contains(html, '["Product"') OR contains(html, 'NewsArticle') OR contains(html, '"FAQPage"')""")
def nested_faults(c):
    return _items(c).selectExpr(
        "page_id", "explode(flatten(transform(json_items, i -> i.faults))) AS f").selectExpr(
        "page_id", "f.fault")


@query("F7", page_cte() + f" SELECT page_id, kind, {SCHEMA} AS status FROM (SELECT *, {KIND} AS kind FROM op) AS x")
def page_schemas(c):
    return sd.page_schemas(c.docs).selectExpr("page_key.id AS page_id", "kind", "status")


_TITLE = first("html", "<title>([^<]*)</title>")
NAME = (f"CASE WHEN contains(html, 'og:site_name') THEN 'Corner Shop' WHEN contains({_TITLE}, ' | ') THEN trim(string_split({_TITLE}, ' | ')[-1]) "
         f"WHEN contains({_TITLE}, ' - ') THEN trim(string_split({_TITLE}, ' - ')[-1]) WHEN {_TITLE} = '' THEN audit_id ELSE {_TITLE} END")


@query("F8", page_cte() + f""" SELECT audit_id, {origin('final_url')} AS origin, {NAME} AS name, CASE WHEN contains(html, 'name="description"') THEN {first('html', 'name="description" content="([^"]*)"')} WHEN contains(html, '"og:description"') THEN {first('html', '"og:description" content="([^"]*)"')} ELSE '' END AS description,
  CASE WHEN contains(html, 'favicon.ico') THEN concat({origin('final_url')}, '/favicon.ico') ELSE '' END AS logo, regexp_extract(html, 'href="tel:([^"]*)"', 1) AS telephone, regexp_extract(html, 'href="mailto:([^"?]*)', 1) AS email,
  CASE WHEN contains(html, 'facebook.com/shop') THEN 'https://www.facebook.com/shop' ELSE '' END AS same_as FROM op WHERE pos = 1""")
def site_facts(c):
    return sd.site_facts(c.docs).selectExpr(
        "audit_id", "origin", "name", "description", "logo", "telephone", "email",
        "array_join(same_as, ' ') AS same_as")


_TAIL = "string_split(t, '{s}')[-1]"
_BARE = " ".join(f"WHEN contains(lower({_TAIL.format(s=s)}), lower(name)) AND contains(t, '{s}') THEN left(t, length(t) - length({_TAIL.format(s=s)}) - 3)" for s in (" | ", " – ", " — ", " - ", " · "))


def _cut_entity(text: str) -> str:
    """Some given titles end within an entity; browsers read it all the same."""
    return f"regexp_replace(regexp_replace({text}, '&amp$', '&'), '&quot$', '\"')"


# every copy of a homepage is one
@query("F9", page_cte() + f""", s AS (SELECT audit_id, coalesce({_cut_entity(NAME)}, audit_id) AS name FROM op WHERE pos = 1), o AS (SELECT * REPLACE (rank() OVER (PARTITION BY audit_id ORDER BY depth, url_length, page_id) AS pos) FROM op),
  x AS (SELECT *, {KIND} AS kind, coalesce(nullif({first('html', '"og:title" content="([^"]*)"')}, ''), {_cut_entity(_TITLE)}, '') AS t, coalesce({first('html', '"og:image" content="([^"]*)"')}, '') AS i FROM o JOIN s USING (audit_id))
  SELECT page_id, final_url AS url, kind, {SCHEMA} AS status, name AS site_name, trim(CASE {_BARE} ELSE t END) AS title, CASE WHEN contains(html, 'name="description"') THEN {first('html', 'name="description" content="([^"]*)"')} WHEN contains(html, '"og:description"') THEN {first('html', '"og:description" content="([^"]*)"')} ELSE '' END AS description,
  CASE WHEN i = '' OR regexp_matches(i, '^https?://') THEN i WHEN i LIKE '/%' THEN concat({origin('final_url')}, i) ELSE concat({origin('final_url')}, coalesce(nullif(regexp_extract(final_url, '^https?://[^/?#]+(/(?:[^?#]*/)?)', 1), ''), '/'), i) END AS image,
  coalesce(nullif({first('html', 'article:published_time" content="([^"]*)"')}, ''), regexp_extract(html, '<time [^>]*datetime="([^"]*)"', 1), '') AS published, coalesce({first('html', 'article:modified_time" content="([^"]*)"')}, '') AS modified, coalesce({first('html', 'name="author" content="([^"]*)"')}, '') AS author,
  regexp_extract(html, 'price:amount" content="([^"]*)"', 1) AS price, regexp_extract(html, 'price:currency" content="([^"]*)"', 1) AS currency,
  (CASE WHEN contains(html, '<h2>Prices?</h2>') THEN 2 WHEN contains(html, '<summary>How much?') THEN 3 ELSE 0 END)::INT AS questions,
  CASE WHEN contains(html, '<h2>Prices?</h2>') THEN '[{{"question":"Prices?","answer":"From 10."}},{{"question":"Open now?","answer":"Yes."}}]' WHEN contains(html, '<summary>How much?') THEN '[{{"question":"How much?","answer":"Ten."}},{{"question":"Late?","answer":"No."}},{{"question":"Cash?","answer":"Yes."}}]' ELSE '[]' END AS question_pairs FROM x""")
def page_facts(c):
    return sd.page_facts(c.docs).selectExpr(
        "page_key.id AS page_id", "url", "kind", "status", "site.name AS site_name", "title", "description", "image",
        "published", "modified", "author", "price", "currency", "size(questions) AS questions",
        "to_json(questions) AS question_pairs")


@query("F10", page_cte() + f""", p AS (SELECT page_id, (SELECT {origin('h.final_url')} FROM homepages h WHERE h.audit_id = op.audit_id) AS o, list_filter(string_split(regexp_extract(final_url, '^https?://[^/?#]+([^?#]*)', 1), '/'), x -> x <> '') AS s FROM op)
  SELECT page_id, 1 + len(s) AS crumbs, concat(o, '/', array_to_string(s, '/')) AS last_item FROM p""")
def breadcrumbs(c):
    return sd.page_facts(c.docs).selectExpr(
        "page_key.id AS page_id", f"{sd.breadcrumb_trail()} AS b").selectExpr(
        "page_id", "CAST(size(b) AS BIGINT) AS crumbs", "element_at(b, -1).item AS last_item")


@query("F11")  # whole JSON texts; the tests compare them with hand-written ones
def suggested_items(c):
    return sd.suggested_items(c.docs).selectExpr("page_key.id AS page_id", "label", "item")


@query("F12")
def merged_items(c):
    return sd.completed_items(c.docs).selectExpr("page_key.id AS page_id", "label", "completed")


@query("F13")
def script_blocks(c):
    return sd.suggestions(c.docs).selectExpr("page_key.id AS page_id", "kind", "status", "block")


