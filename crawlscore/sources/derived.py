"""Audit inputs derived from the given tables, in SQL that Spark and DuckDB both read.

The given `pages` table holds raw HTML of real-looking but bare pages: no images, forms,
descriptions, structured data, response headers or probe results. These statements derive
those from the rows at hand: every page gets a set of traits from the MD5 of its address,
and the traits decide which markup and which headers are added to its own HTML. The derived
tables grow with the given ones. Backslashes are avoided, since the two dialects treat them
differently inside string literals.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _trait(position: int, of: str = "mark") -> str:
    return f"instr('0123456789abcdef', substr({of}, {position}, 1)) - 1"


def _pick(trait: str, choices: list[tuple[str, str]], default: str = "''") -> str:
    arms = " ".join(f"WHEN {trait} {cond} THEN {value}" for cond, value in choices)
    return f"CASE {arms} ELSE {default} END"


PAGE_KEYS = """
SELECT page_id, url, lower(regexp_extract(url, '^https?://([^/?#]+)', 1)) AS audit_id,
  regexp_replace(url, '#.*$', '') AS final_url,
  regexp_replace(regexp_extract(url, '^https?://[^/?#]+(/[^?#]*)', 1), '/+$', '') AS page_path,
  md5(url) AS mark, html AS raw_html
FROM pages
"""

PAGE_TRAITS = (
    "SELECT page_id, url, audit_id, final_url, raw_html, mark, "
    "length(page_path) - length(replace(page_path, '/', '')) AS depth, length(url) AS url_length, "
    + ", ".join(f"{_trait(i)} AS t{i}" for i in range(1, 33))
    + " FROM page_keys"
)

_ID = "CAST(page_id AS STRING)"

HEAD_EXTRA = "concat(" + ", ".join([
    _pick("t1", [
        (">= 3", "'<meta name=\"Viewport\" content=\"width = device-width, initial-scale=1\">'"),
        ("= 2", "'<meta name=\"viewport\" content=\"width=1024\">'"),
    ]),
    _pick("t2", [
        ("< 4", "''"),
        ("< 7", "'<meta name=\"description\" content=\"Short summary.\">'"),
        ("< 9", "concat('<meta name=\"description\" content=\"',"
                " repeat('Long words about offers &amp; prices ', 6), '\">')"),
    ], "concat('<meta name=\"description\" content=\"Hand made goods, repairs and advice from a"
       " family workshop, page ', " + _ID + ", '.\">')"),
    _pick("t3", [
        ("< 6", "concat('<link rel=\"canonical\" href=\"', final_url, '\">')"),
        ("< 7", "'<link rel=\"canonical\" href=\"/home\">'"),
        ("< 8", "'<link rel=\"canonical\" href=\"https://a.example.org/\"><link rel=\"canonical\""
                " href=\"https://b.example.org/\">'"),
        ("< 9", "'<link rel=\"canonical\" href=\"https://other.example.org/\">'"),
    ]),
    _pick("t4", [("= 0", "'<meta name=\"robots\" content=\"NOINDEX, follow\">'")]),
    _pick("t5", [
        ("< 6", "concat('<meta property=\"og:title\" content=\"Page ', " + _ID + ", '\"><meta"
                " property=\"og:description\" content=\"About us &amp; you\"><meta"
                " property=\"og:image\" content=\"https://img.example.net/', " + _ID + ", '.png\">"
                "<meta name=\"twitter:card\" content=\"summary\"><meta property=\"og:site_name\""
                " content=\"Corner Shop\">')"),
        ("< 8", "'<meta property=\"og:title\" content=\"T\"><meta property=\"og:description\""
                " content=\"D\"><meta property=\"og:image\" content=\"/preview.png\"><meta"
                " name=\"twitter:card\" content=\"summary\">'"),
        ("< 10", "'<meta property=\"og:title\" content=\"Only a title\"><meta property=\"og:type\""
                 " content=\"article\">'"),
        ("< 11", "'<meta property=\"og:image\" content=\"img/p.png\">'"),
        ("< 12", "'<meta property=\"product:price:amount\" content=\"12.50\"><meta"
                 " property=\"product:price:currency\" content=\"EUR\">'"),
        ("< 13", "'<link rel=\"shortcut icon\" href=\"/favicon.ico\">'"),
    ]),
    _pick("t6", [
        ("< 2", "'<script src=\"https://cdn.example.net/jquery-3.4.1.min.js\"></script>'"),
        ("< 3", "'<script src=\"http://cdn.example.net/bootstrap@4.1.0/bootstrap.js\"></script>'"),
        ("< 5", "'<script src=\"/js/jquery-3.7.1.min.js\" defer></script>'"),
        ("< 6", "'<script type=\"Module\" src=\"/app.js\"></script>'"),
        ("< 7", "'<script async src=\"/lodash/4.17.20/lodash.js\"></script>'"),
        ("< 8", "'<link rel=\"Stylesheet\" href=\"http://static.example.net/site.css\">'"),
        ("< 9", "'<meta http-equiv=\"refresh\" content=\"5; url=/next\">'"),
        ("< 10", "'<meta name=\"referrer\" content=\"strict-origin\">'"),
        ("< 11", "'<meta name=\"referrer\" content=\"unsafe-url, origin\">'"),
        ("< 12", "'<meta http-equiv=\"Content-Security-Policy\" content=\"default-src self\">'"),
    ], "'<link rel=\"stylesheet\" href=\"https://static.example.net/site.css\">'"),
    "CASE WHEN json_ld = '' THEN '' ELSE concat('<script type=\"application/ld+json\">', json_ld,"
    " '</script>') END",
]) + ")"

JSON_LD = _pick("t7", [
    ("< 3", "''"),
    ("< 5", "concat('{\"@context\":\"https://schema.org\",\"@graph\":[{\"@type\":\"Bakery\","
            "\"name\":\"Shop ', " + _ID + ", '\",\"address\":{\"streetAddress\":\"1 Mill Road\"},"
            "\"url\":\"https://shop.example/\",\"telephone\":\"+15550100\"},{\"@type\":\"WebSite\","
            "\"name\":\"Shop\",\"url\":\"https://shop.example/\"}]}')"),
    ("< 6", "'{\"@type\":\"Organization\",\"name\":\"Shop\",}'"),
    ("< 7", "'{\"@type\":[\"Product\",\"Thing\"],\"name\":\"Bread\",\"image\":\"b.png\","
            "\"offers\":{\"price\":\"9\"},\"brand\":\"Mill\",\"sku\":\"\"}'"),
    ("< 8", "'{\"@type\":\"NewsArticle\",\"headline\":\"News\",\"image\":[],\"author\":"
            "{\"@type\":\"Person\"},\"datePublished\":\"2024-01-02\"}'"),
    ("< 9", "'{\"@type\":\"FAQPage\",\"mainEntity\":[{\"@type\":\"Question\",\"name\":\"Open?\","
            "\"acceptedAnswer\":{\"text\":\"Yes\"}},{\"@type\":\"Question\",\"name\":\"Late?\"}]}'"),
    ("< 10", "'[{\"@type\":\"WebPage\",\"name\":\"Home\",\"url\":\"https://shop.example/\","
             "\"description\":\"Bread\"},{\"@type\":\"BreadcrumbList\",\"itemListElement\":[1]}]'"),
    ("< 11", "'[{\"@type\":\"LocalBusiness\",\"name\":\"Shop\",\"aggregateRating\":{\"ratingValue\""
             ":5}},{\"@type\":\"Review\",\"name\":\"R\"},7]'"),
    ("< 12", "'{\"@type\":\"Service\",\"name\":\"Repair\",\"provider\":{\"name\":\"Shop\"},"
             "\"serviceType\":\"Repair\",\"areaServed\":\"Here\"}'"),
    ("< 13", "'{\"@type\":\"Organization\",\"name\":\"Shop\",\"url\":\"https://shop.example/\","
             "\"logo\":\"l.png\",\"sameAs\":[\"https://x.com/shop\"],\"contactPoint\":{\"telephone\":"
             "\"1\"},\"@graph\":[{\"@type\":\"WebSite\",\"name\":\"Shop\",\"url\":\"https://u/\"},"
             "{\"name\":\"no type\"}]}'"),
])

BODY_EXTRA = "concat(" + ", ".join([
    _pick("t8", [
        ("< 4", "''"),
        ("< 7", "'<img src=\"/img/IMG_1234.jpg\" alt=\"photo\"><img src=\"/img/team.png\">'"),
        ("< 10", "'<img src=\"/a/rye.jpg\" alt=\"Rye bread\" width=\"10\" height=\"10\""
                 " loading=\"lazy\"><img src=\"/a/oat.jpg\" alt=\"Oat bread\" width=\"10\""
                 " height=\"10\"><img src=\"/a/bun.jpg\" alt=\"\" width=\"10\" height=\"10\"><img"
                 " src=\"/a/DSC_0042.jpg\" alt=\"Cake on a stand\" width=\"10\" height=\"10\">'"),
        ("< 12", "'<img src=\"http://img.example.net/old.gif\" alt=\"DSC 0042\" width=\"9\">'"),
        ("< 13", "'<img src=\"data:image/png;base64,xx\"><img src=\"\" alt=\"x\">'"),
        ("< 14", "concat('<img src=\"/long.jpg\" alt=\"', repeat('Sour dough loaf ', 10),"
                 " '\" width=\"9\" height=\"9\"><img src=\"/b1.jpg\" alt=\"Banner.\"><img"
                 " src=\"/b2.jpg\" alt=\"Market stall\"><img src=\"/b3.jpg\" alt=\"Oven door\">')"),
    ], "'<img data-src=\"/x/bread.jpg\" alt=\"Rye bread on a board\" width=\"9\" height=\"9\">'"),
    _pick("t9", [
        ("< 3", "'<form><label for=\"e\">Mail</label><input id=\"e\" type=\"email\"><input"
                " type=\"hidden\" name=\"h\"></form>'"),
        ("< 6", "'<form><input type=\"text\" placeholder=\"Name\"><textarea></textarea><input"
                " type=\"submit\" value=\"Go\"></form>'"),
        ("< 7", "'<form><label>Name <input name=\"n\"></label><select aria-label=\"Size\"></select>"
                "</form>'"),
        ("< 8", "'<form><input type=\"search\"><input type=\"submit\"><button></button></form>'"),
    ]),
    _pick("t10", [
        ("< 3", "'<p>Ring us: <a href=\"tel:+8801717863320\">+880 1717-863320</a></p>'"),
        ("< 5", "'<a href=\"mailto:hi@shop.example?subject=x\">Mail</a>'"),
        ("< 8", "'<p>Ring 01717863320 or +1 (555) 123-4567 today.</p>'"),
        ("< 9", "'<a href=\"https://wa.me/8801717863320\">Chat</a>'"),
        ("< 10", "'<iframe src=\"https://www.google.com/maps/embed?pb=1\"></iframe>'"),
        ("< 11", "'<p>Write to hello@shop.example soon.</p>'"),
    ]),
    _pick("t11", [
        ("< 3", "'<h2>Services</h2><h4>Deep</h4>'"),
        ("< 4", "'<h1>Welcome</h1>'"),
        ("< 5", "'<h3></h3>'"),
        ("< 7", "'<h2><img alt=\"Our story\" src=\"/s.png\" width=\"1\" height=\"1\"></h2>'"),
        ("< 9", "'<h2>Prices?</h2><p>From 10.</p><h3>Open <b>now</b>?</h3><p> </p><p>Yes.</p>'"),
        ("< 11", "'<details><summary>How much?</summary><p>Ten.</p></details><h4>Late?</h4>"
                 "<p>No.</p><h4>Cash?</h4><p>Yes.</p>'"),
        ("< 12", "'<h1> </h1>'"),
    ]),
    _pick("t12", [
        ("< 3", "'<a href=\"https://www.facebook.com/shop\">Facebook</a>'"),
        ("< 6", "'<a href=\"https://partner.example.info/a#x\">Partner</a>'"),
        ("< 8", "'<a href=\"/privacy-policy\">Privacy</a>'"),
        ("< 10", "'<a href=\"/about-us\">About us</a>'"),
        ("< 11", "'<a href=\"/cart\"><img src=\"/cart.png\" alt=\"\" width=\"1\" height=\"1\"></a>'"),
        ("< 12", "'<a href=\"/basket\" aria-label=\"Basket\"></a>'"),
        ("< 13", "'<a href=\"/Wedding_Cakes\">Cakes</a><a href=\"/shop?PHPSESSID=1&amp;size=2\">"
                 "Shop</a><a href=\"../up/./x.php\">Up</a>'"),
        ("< 14", "'<a href=\"/files/menu.pdf\">Menu</a><a href=\"//cdn.example.net/x\">Net</a>'"),
    ]),
    _pick("t13", [
        ("< 5", "'<p>Copyright 2019-2024</p>'"),
        ("< 8", "'<p>Copyright 2021</p>'"),
        ("< 9", "'<p>What our customers say</p>'"),
    ]),
    _pick("t14", [("< 8", "'<div role=\"main\"></div>'")]),
    _pick("t15", [("< 4", "'<header></header>'")]),
]) + ")"

# --- one row per page, with derived markup and response headers -----------------------------------
SITE_PAGES = f"""
SELECT page_id, url, audit_id, final_url, depth, url_length, mark,
  CASE WHEN t16 = 0 THEN 'application/pdf' WHEN t16 < 8 THEN 'text/html; charset=utf-8'
    ELSE 'text/html' END AS content_type,
  CASE WHEN t17 < 6 THEN 'max-age=31536000; includeSubDomains' WHEN t17 < 9 THEN 'max-age=600'
    ELSE '' END AS hsts,
  CASE WHEN t18 < 4 THEN 'default-src self; frame-ancestors self' WHEN t18 < 6 THEN
    'default-src self' ELSE '' END AS csp,
  CASE WHEN t19 < 4 THEN 'default-src self' ELSE '' END AS csp_report_only,
  CASE WHEN t20 < 9 THEN 'NoSniff' WHEN t20 < 10 THEN 'sniff' ELSE '' END AS nosniff,
  CASE WHEN t21 < 5 THEN 'sameorigin' WHEN t21 < 7 THEN 'ALLOW-FROM x' ELSE '' END AS xfo,
  CASE WHEN t22 < 5 THEN 'no-referrer, strict-origin' WHEN t22 < 7 THEN 'Unsafe-URL' ELSE '' END
    AS referrer_policy,
  CASE WHEN t23 = 0 THEN 'noindex' ELSE '' END AS x_robots,
  CASE WHEN t24 = 0 THEN replace(html, '<!DOCTYPE html>', '') WHEN t24 = 1 THEN
    concat('  <!-- made by hand -->', html) ELSE html END AS html
FROM (
  SELECT *, replace(replace(replace(raw_html, '</head>', concat({HEAD_EXTRA}, '</head>')),
    '<footer>', concat({BODY_EXTRA}, '<footer>')),
    '<meta charset="utf-8">', CASE WHEN t25 < 2 THEN '' ELSE '<meta charset="utf-8">' END) AS html
  FROM (SELECT *, {JSON_LD} AS json_ld FROM page_traits) AS with_json
) AS marked
"""

# --- one row per site: its homepage by the one rule used everywhere --------------------------------
HOMEPAGES = """
SELECT audit_id, page_id, final_url, html, mark
FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY depth, url_length, page_id) AS rn
      FROM site_pages WHERE content_type <> 'application/pdf') AS ranked
WHERE rn = 1
"""

SITES = (
    "SELECT audit_id, final_url AS home_url, html AS home_html, "
    + ", ".join(f"{_trait(i, 'md5(audit_id)')} AS s{i}" for i in range(1, 33))
    + " FROM homepages"
)

# --- what a browser, a prober, a speed test and DNS would have returned ------------------------------
RENDERS = """
SELECT audit_id, home_url AS url,
  replace(home_html, '<footer>', '<p>Loaded later: <a href="/late">late link</a></p><footer>')
    AS html,
  CASE WHEN s1 < 2 THEN 100 WHEN s1 < 5 THEN 20000 WHEN s1 < 8 THEN 5000 ELSE 1500 END
    AS text_length,
  CASE WHEN s2 < 4 THEN 'TypeError: x is null|404 on /app.js|TypeError: x is null' ELSE '' END
    AS console_errors,
  CASE WHEN s3 < 4 THEN '3.4.0' WHEN s3 < 8 THEN '3.10.1' ELSE '' END AS jquery_version
FROM sites WHERE s4 < 13
"""

SITE_PROBE = """
SELECT audit_id,
  CASE WHEN s5 < 5 THEN home_url WHEN s5 < 9 THEN replace(home_url, 'http://', 'https://')
    WHEN s5 < 12 THEN 'http://plain.example.net/' END AS http_final_url,
  CASE WHEN s6 < 4 THEN '# Corner Shop' WHEN s6 < 7 THEN ' Corner Shop guide' ELSE '' END
    AS llms_txt_text,
  CASE WHEN s7 < 10 THEN 'https://img.example.net/p.png' ELSE '' END AS og_image_url,
  CASE WHEN s7 < 2 THEN 0 WHEN s7 < 4 THEN 404 ELSE 200 END AS og_image_status,
  CASE WHEN s7 < 6 THEN '' ELSE 'image/png' END AS og_image_type, s7 = 7 AS og_image_too_big
FROM sites WHERE s8 < 14
"""

AGENT_PROBE = """
SELECT audit_id, 'ai' AS agent, CASE WHEN s9 < 3 THEN 403 WHEN s9 < 4 THEN 0 ELSE 200 END
    AS status_code, CASE WHEN s10 < 4 THEN 300 ELSE 2000 END AS text_length, s11 = 0 AS challenge
FROM sites WHERE s8 < 14
UNION ALL
SELECT audit_id, 'browser', CASE WHEN s9 < 2 THEN 503 ELSE 200 END, 2000, FALSE
FROM sites WHERE s8 < 13
"""

COOKIES = """
SELECT audit_id, 'id' AS name, 'ads.example.net' AS domain, TRUE AS third_party FROM sites
WHERE s12 < 6
UNION ALL
SELECT audit_id, 'track', CASE WHEN s12 < 3 THEN 'ads.example.net' ELSE 'cdn.example.org' END,
  TRUE FROM sites WHERE s12 < 5
UNION ALL
SELECT audit_id, 'session', audit_id, FALSE FROM sites WHERE s13 < 9
"""

DEVICE_VIEWS = """
SELECT audit_id, 'mobile' AS name, 390 AS width, CASE WHEN s14 < 3 THEN 980 ELSE 390 END
    AS layout_width, CASE WHEN s15 < 4 THEN 1010 WHEN s15 < 6 THEN 392 ELSE 390 END AS scroll_width,
  CASE WHEN s16 < 1 THEN 0 ELSE 40 END AS tap_targets,
  CASE WHEN s16 < 5 THEN 0 WHEN s16 < 8 THEN 2 ELSE 9 END AS small_tap_targets,
  CASE WHEN s17 < 1 THEN 0 ELSE 4000 END AS text_chars,
  CASE WHEN s17 < 6 THEN 100 WHEN s17 < 10 THEN 400 ELSE 1600 END AS small_text_chars,
  CASE WHEN s18 < 4 THEN 'Menu | #|Our story | /x' WHEN s18 < 8 THEN 'Book now | /y'
    WHEN s18 < 11 THEN 'Write | MAILTO:a@b.example' ELSE '' END AS first_screen
FROM sites WHERE s4 < 13
UNION ALL
SELECT audit_id, 'tablet', 820, CASE WHEN s19 < 2 THEN 980 ELSE 820 END,
  CASE WHEN s19 < 6 THEN 1200 ELSE 820 END, 30, 0, 4000, 0, ''
FROM sites WHERE s4 < 12
"""

_AXE = [
    ("color-contrast", "serious", "s20 < 6", 8), ("region", "moderate", "s21 < 6", 3),
    ("meta-viewport", "critical", "s22 < 3", 1), ("duplicate-id", "minor", "s23 < 5", 6),
    ("image-alt", "critical", "s24 < 8", 2), ("odd-rule", "unknown", "s25 < 3", 1),
]
AXE_RULES = "\nUNION ALL\n".join(
    f"SELECT audit_id, '{rule}' AS id, '{impact}' AS impact, {nodes} AS nodes, NOT ({bad}) AS passed"
    " FROM sites WHERE s4 < 13"
    for rule, impact, bad, nodes in _AXE
)

SECURITY_FACTS = """
SELECT audit_id, audit_id AS domain,
  CASE WHEN s26 < 2 THEN 'self-signed certificate' ELSE '' END AS cert_error,
  CAST(CASE WHEN s26 < 5 THEN CAST(NULL AS STRING) WHEN s26 < 8 THEN '2024-08-19 23:59:59+00:00'
    WHEN s26 < 11 THEN '2024-02-13 05:30:00+05:30' WHEN s26 < 13 THEN '2024-02-06 23:59:59+00:00'
    ELSE '2024-01-29 22:00:00-01:00' END AS TIMESTAMP) AS cert_expires,
  CAST(CASE WHEN s27 < 4 THEN CAST(NULL AS STRING) WHEN s27 < 8 THEN '2024-11-27 00:00:00+00:00'
    WHEN s27 < 12 THEN '2024-02-26 12:00:00+00:00' ELSE '2024-02-08 00:00:00+00:00' END AS TIMESTAMP)
    AS domain_expires,
  CASE WHEN s31 < 8 THEN TRUE WHEN s31 < 12 THEN FALSE END AS has_mx,
  s28 < 13 AS dns_checked,
  CASE WHEN s29 < 8 THEN 'v=spf1 -all' ELSE '' END AS spf,
  CASE WHEN s30 < 5 THEN 'v=DMARC1; p=reject' WHEN s30 < 10 THEN 'v=DMARC1; P = none' ELSE '' END
    AS dmarc,
  s31 < 13 AS files_checked, s31 < 4 AS git_exposed, s31 < 2 AS env_exposed,
  CASE WHEN s32 < 5 THEN TRUE WHEN s32 < 13 THEN FALSE END AS security_txt
FROM sites WHERE s28 < 15
"""

_PSI_JSON = (
    "concat('{{\"lighthouseResult\":{{\"categories\":{{\"performance\":{{\"score\":', {score}, "
    "'}}}},\"audits\":{{\"largest-contentful-paint\":{{\"numericValue\":', {lcp}, "
    "'}},\"cumulative-layout-shift\":{{\"numericValue\":', {cls}, '}},\"total-blocking-time\":"
    "{{\"numericValue\":', {tbt}, '}},\"first-contentful-paint\":{{\"numericValue\":', {fcp}, "
    "'}},\"total-byte-weight\":{{\"numericValue\":', {size}, '}},\"render-blocking-resources\":"
    "{{\"details\":{{\"overallSavingsMs\":', {savings}, ',\"items\":[', {blocking}, ']}}}},"
    "\"offscreen-images\":{{\"details\":{{\"items\":[', {offscreen}, ']}}}}}}}}', {field}, '}}')"
)


def _psi(trait: str, **over: str) -> str:
    values = {
        "score": f"CASE WHEN {trait} < 5 THEN '0.31' WHEN {trait} < 10 THEN '0.72' ELSE '0.96' END",
        "lcp": f"CASE WHEN {trait} < 6 THEN '5200.5' WHEN {trait} < 9 THEN '2900' ELSE '1800' END",
        "cls": f"CASE WHEN {trait} < 4 THEN '0.31' WHEN {trait} < 7 THEN '0.2' ELSE '0.04' END",
        "tbt": f"CASE WHEN {trait} < 8 THEN '820' ELSE '120' END",
        "fcp": f"CASE WHEN {trait} < 5 THEN '2400' ELSE '900' END",
        "size": f"CASE WHEN {trait} < 6 THEN '5452595' WHEN {trait} < 11 THEN '3000000' ELSE"
                " '900000' END",
        "savings": f"CASE WHEN {trait} < 3 THEN '1350' ELSE '200' END",
        "blocking": f"CASE WHEN {trait} < 7 THEN '{{\"url\":\"a.css\"}},{{\"url\":\"b.js\"}},"
                    "{\"note\":1}' ELSE '' END",
        "offscreen": f"CASE WHEN {trait} < 9 THEN '{{\"url\":\"x.jpg\"}}' ELSE '' END",
        "field": f"CASE WHEN {trait} < 2 THEN ',\"loadingExperience\":{{\"metrics\":{{"
                 "\"LARGEST_CONTENTFUL_PAINT_MS\":{\"percentile\":3100},"
                 "\"CUMULATIVE_LAYOUT_SHIFT_SCORE\":{\"percentile\":5},"
                 "\"INTERACTION_TO_NEXT_PAINT\":{\"percentile\":650}}}' WHEN "
                 f"{trait} < 4 THEN ',\"loadingExperience\":{{\"metrics\":{{}}}},"
                 "\"originLoadingExperience\":{\"metrics\":{\"LARGEST_CONTENTFUL_PAINT_MS\":"
                 "{\"percentile\":2000},\"FIRST_CONTENTFUL_PAINT_MS\":{\"percentile\":1500}}}'"
                 " ELSE '' END",
    }
    values.update(over)
    return _PSI_JSON.format(**values)


PSI_RAW = f"""
SELECT audit_id, 'mobile' AS strategy, {_psi('s1')} AS json FROM sites WHERE s2 < 12
UNION ALL
SELECT audit_id, 'desktop', {_psi('s3')} FROM sites WHERE s2 < 14
"""

ROBOTS_FILES = """
SELECT audit_id, concat(regexp_extract(home_url, '^(https?://[^/?#]+)', 1), '/robots.txt') AS url,
  CASE WHEN s6 < 3 THEN 404 ELSE 200 END AS status_code,
  CASE WHEN s7 < 1 THEN 'text/html' ELSE 'text/plain' END AS content_type,
  CASE WHEN s8 < 4 THEN concat('User-agent: *', chr(10), 'Disallow: /', chr(10))
    WHEN s8 < 8 THEN concat('# rules', chr(10), 'User-agent: GPTBot', chr(10), 'User-agent: ',
      'PerplexityBot', chr(10), 'Disallow: /', chr(10), chr(10), 'User-agent: *', chr(10),
      'Allow: /en', chr(10), 'Disallow: /The', chr(10), 'Disallow:', chr(10), 'SITEMAP: ',
      'https://', audit_id, '/sitemap.xml', chr(10))
    WHEN s8 < 10 THEN concat('<html>', chr(10), 'Disallow: /')
    ELSE concat('User-agent: *', chr(10), 'Disallow: /de # comment', chr(10), 'Disallow: /fr',
      chr(10), 'sitemap: https://', audit_id, '/a.xml', chr(10), 'Sitemap: https://', audit_id,
      '/b.xml') END AS text
FROM sites
"""

SITEMAP_FILES = """
SELECT audit_id, concat('https://', audit_id, '/sitemap.xml') AS url, s9 < 14 AS ok,
  CASE WHEN s10 < 3 THEN '<html><body>Not found</body></html>'
    WHEN s10 < 5 THEN concat('<urlset><url><loc>https://', audit_id, '/a</loc></url>')
    WHEN s10 < 6 THEN '<!DOCTYPE x [<!ENTITY a "b">]><urlset><url><loc>&a;</loc></url></urlset>'
    WHEN s10 < 7 THEN '<urlset></urlset>'
    WHEN s10 < 10 THEN concat('<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">',
      '<sitemap><loc>https://', audit_id, '/part.xml</loc></sitemap></sitemapindex>')
    ELSE concat('<?xml version="1.0"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">',
      '<url><loc> https://', audit_id, '/en/1 </loc></url><url><loc>https://', audit_id,
      '/en/2</loc><lastmod>2024-01-01</lastmod></url></urlset>') END AS text
FROM sites WHERE s11 < 14
UNION ALL
SELECT audit_id, concat('https://', audit_id, '/part.xml'), TRUE,
  concat('<urlset><url><loc>https://', audit_id, '/p1</loc></url></urlset>')
FROM sites WHERE s12 < 12
"""

# --- audit history and findings, from the events and customers at hand -------------------------------
CHECKUPS = """
SELECT event_id AS id, concat('https://site', CAST(user_id AS STRING), '.example.org/') AS url,
  concat('site', CAST(user_id AS STRING), '.example.org') AS domain,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'done' WHEN event_type = 'error' THEN
    'failed' WHEN value < 20 THEN 'queued' ELSE 'running' END AS status,
  ts AS created_at,
  CASE WHEN event_type = 'error' AND value < 20 THEN NULL ELSE ts + INTERVAL '2' SECOND END
    AS started_at,
  CASE WHEN event_type = 'signup' THEN NULL WHEN value < 40 THEN ts + INTERVAL '50' SECOND
    ELSE ts + INTERVAL '2000' SECOND END AS finished_at,
  CASE WHEN event_type IN ('view', 'click', 'purchase') THEN
    CAST(least(floor(value), 100) AS INT) END AS health_score,
  CASE WHEN event_type = 'click' AND value > 200 THEN '' ELSE
    concat('v', CAST(user_id AS STRING)) END AS ip_hash,
  CASE WHEN event_type <> 'view' THEN CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) END
    AS lead_id
FROM events
"""

REQUESTS = """
SELECT event_id AS id, concat('https://site', CAST(user_id AS STRING), '.example.org/') AS url,
  ts + INTERVAL '7' HOUR AS requested_at
FROM events WHERE event_type = 'signup'
"""

LEADS = """
SELECT c_custkey AS id,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN concat('=', c_name) ELSE c_name END AS name,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN concat('+', c_name, '@example.org') ELSE
    concat(c_name, '@Example.org') END AS email,
  c_acctbal > 0 AS consent, TIMESTAMP '2024-01-05 10:00:00' AS created_at
FROM customer
"""

# one finding per event; its check, severity, impact and effort come from the event
FINDING_ROWS = """
SELECT concat('audit', CAST(user_id AS STRING)) AS audit_id, category,
  concat(category, '.check_', CAST(number AS STRING)) AS check_id, number AS check_ord,
  event_id AS finding_ord, concat('code_', event_type) AS code, severity,
  CASE WHEN d1 < 5 THEN 'high' WHEN d1 < 10 THEN 'medium' ELSE 'low' END AS impact,
  CASE WHEN d2 < 7 THEN 'low' WHEN d2 < 12 THEN 'medium' ELSE 'high' END AS effort,
  1 + number AS weight, concat('message ', CAST(event_id AS STRING)) AS message, value, ts
FROM (
  SELECT *, CASE WHEN number < 2 THEN 'performance' WHEN number < 4 THEN 'accessibility' WHEN
    number < 6 THEN 'best_practices' WHEN number < 8 THEN 'seo' ELSE 'agentic' END AS category,
    instr('0123456789abcdef', substr(mark, 1, 1)) - 1 AS d1,
    instr('0123456789abcdef', substr(mark, 2, 1)) - 1 AS d2,
    CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'info' WHEN 'purchase' THEN 'warn'
      WHEN 'signup' THEN 'fail' ELSE 'warn' END AS severity
  FROM (SELECT *, md5(CAST(event_id AS STRING)) AS mark, CAST(substr(CAST(100 +
    CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS STRING), 3, 1) AS INT) AS number
    FROM events) AS marked
) AS placed
"""

# one result per audit and check
RESULT_ROWS = """
SELECT audit_id, check_id, category, check_ord, min(weight) AS weight,
  CASE WHEN min(value) > 60 THEN 'skipped' WHEN min(value) > 55 THEN 'error' ELSE 'ran' END AS status,
  CASE WHEN min(value) > 55 THEN CAST(NULL AS DOUBLE) ELSE min(CASE severity WHEN 'fail' THEN 0.0
    WHEN 'warn' THEN 0.5 ELSE 1.0 END) END AS score,
  CASE WHEN min(value) > 60 THEN 'No speed test was made.' ELSE '' END AS note,
  max(CASE WHEN severity = 'fail' AND impact = 'high' THEN 1 ELSE 0 END) = 1 AS high_impact_fail
FROM finding_rows GROUP BY audit_id, check_id, category, check_ord
"""

SUBSCRIPTIONS = """
SELECT c_custkey AS id, concat('customer', CAST(c_custkey AS STRING), '@example.org') AS email,
  concat('https://site', CAST(c_custkey AS STRING), '.example.org/') AS url,
  c_acctbal > 1000 AS active,
  CASE WHEN c_nationkey < 12 THEN TIMESTAMP '2024-01-10 00:00:00' WHEN c_nationkey < 20 THEN
    TIMESTAMP '2024-01-20 00:00:00' ELSE TIMESTAMP '2024-03-01 00:00:00' END AS next_check_at
FROM customer
"""

REPORT_EMAILS = """
SELECT event_id AS id, event_id - 1 AS checkup_id, ts AS created_at FROM events
WHERE event_type IN ('purchase', 'error')
UNION ALL
SELECT event_id, event_id, ts FROM events WHERE value > 50
"""

# name -> SQL; later ones read earlier ones
DERIVED = {
    "checkups": CHECKUPS,
    "requests": REQUESTS,
    "leads": LEADS,
    "finding_rows": FINDING_ROWS,
    "result_rows": RESULT_ROWS,
    "subscriptions": SUBSCRIPTIONS,
    "report_emails": REPORT_EMAILS,
    "page_keys": PAGE_KEYS,
    "page_traits": PAGE_TRAITS,
    "site_pages": SITE_PAGES,
    "homepages": HOMEPAGES,
    "sites": SITES,
    "renders": RENDERS,
    "site_probe": SITE_PROBE,
    "agent_probe": AGENT_PROBE,
    "cookies": COOKIES,
    "device_views": DEVICE_VIEWS,
    "axe_rules": AXE_RULES,
    "security_facts": SECURITY_FACTS,
    "psi_raw": PSI_RAW,
    "robots_files": ROBOTS_FILES,
    "sitemap_files": SITEMAP_FILES,
}
PREREQUISITES = {
    "checkups": [], "requests": [], "leads": [], "finding_rows": [], "subscriptions": [],
    "report_emails": [], "result_rows": ["finding_rows"],
    "page_keys": [],
    "page_traits": ["page_keys"],
    "site_pages": ["page_traits"],
    "homepages": ["site_pages"],
    "sites": ["homepages"],
}


def chain(*names: str) -> list[str]:
    """The derived tables needed for `names`, in the order they can be built."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for earlier in PREREQUISITES.get(name, ["sites"]):
            add(earlier)
        if name not in wanted:
            wanted.append(name)

    for name in names:
        add(name)
    return wanted


def with_clause(*names: str) -> str:
    """The same derivation as common table expressions, for one SQL statement."""
    return "WITH " + ",\n".join(f"{n} AS ({DERIVED[n].strip()})" for n in chain(*names))


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived table over the given `pages` table."""
    ctes = with_clause(name)
    for table in ("pages", "events", "customer"):
        ctes = re.sub(rf"FROM {table}\b", f"FROM parquet.`{sf_dir}/{table}.parquet`", ctes)
    return spark.sql(f"{ctes} SELECT * FROM {name}")


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived pages in the shape of the `pages` input table of an audit."""
    rows = derived(spark, sf_dir, "site_pages")
    names = {
        "content-type": "content_type", "strict-transport-security": "hsts",
        "content-security-policy": "csp",
        "content-security-policy-report-only": "csp_report_only",
        "x-content-type-options": "nosniff", "x-frame-options": "xfo",
        "referrer-policy": "referrer_policy", "x-robots-tag": "x_robots",
    }
    entries = F.array(*[
        F.struct(F.lit(header).alias("key"), F.col(column).alias("value"))
        for header, column in names.items()
    ])
    return rows.select(
        "audit_id",
        F.struct(
            F.col("depth").cast("bigint").alias("depth"),
            F.col("url_length").cast("bigint").alias("length"), F.col("page_id").alias("id"),
        ).alias("page_key"),
        "url", "final_url", F.lit(200).alias("status_code"),
        F.map_from_entries(F.filter(entries, lambda e: e["value"] != "")).alias("headers"),
        F.col("html").alias("text"),
    )
