"""Address, text and element functions as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import elements as el
from crawlscore.functions import text as tx
from crawlscore.functions import urls
from crawlscore.functions.blocks import head_block, outline_text, preview_block
from crawlscore.operators.checks.features import FEATURES, layered
from crawlscore.suite.corpus import query
from crawlscore.suite.oracle_pages import decoded, first, origin, page_cte

HOST = "lower(regexp_extract(url, '^https?://([^/?#]+)', 1))"
PATH = "regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1)"
SITE = "regexp_extract({h}, '([^.]+[.][^.]+)$', 1)"


def _pages(select: str) -> str:
    return f"SELECT page_id, {select} FROM pages"


# --- B: addresses ------------------------------------------------------------------------------


@query("B1", _pages("regexp_replace(concat(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1), CASE WHEN "
                    f"{PATH} = '' THEN '/' ELSE {PATH} END, regexp_extract(url, '([?][^#]+)', 1)), '#.*$', '') AS normalized"))
def normalize(c):
    return urls.normalize_urls(c.table("pages").select("page_id", "url"), "url").select(
        "page_id", "normalized")


@query("B2", _pages(f"{origin('url')} AS origin"))
def origins(c):
    return c.table("pages").select("page_id", urls.origin(F.col("url")).alias("origin"))


@query("B3", _pages(f"{HOST} AS domain"))
def domains(c):
    return c.table("pages").select("page_id", urls.domain(F.col("url")).alias("domain"))


@query("B4", _pages(SITE.format(h=HOST) + " AS site"))
def site_domains(c):
    return c.table("pages").select("page_id", urls.site_domain(urls.domain(F.col("url"))).alias("site"))


@query("B5", f"""WITH x AS (SELECT page_id, {SITE.format(h=HOST)} AS s, lead({SITE.format(h=HOST)})
  OVER (ORDER BY page_id) AS t FROM pages) SELECT page_id, s = t AS same FROM x WHERE t IS NOT NULL""")
def same_sites(c):
    p = c.table("pages").select("page_id", "url")
    return p.alias("a").join(
        p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other")), "page_id"
    ).select("page_id", urls.same_site(urls.domain(F.col("url")), urls.domain(F.col("other"))).alias("same"))


@query("B6", _pages(f"concat({origin('url')}, '/') AS root"))
def roots(c):
    return c.table("pages").select("page_id", urls.site_root(F.col("url")).alias("root"))


@query("B7", f"""WITH x AS (SELECT page_id, {origin('url')} AS s, lead({origin('url')}) OVER (ORDER BY page_id) AS t FROM pages)
  SELECT page_id, s = t AS same FROM x WHERE t IS NOT NULL""")
def same_origins(c):
    p = c.table("pages").select("page_id", "url")
    return p.join(
        p.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other")), "page_id"
    ).select("page_id", urls.same_origin(F.col("url"), F.col("other")).alias("same"))


@query("B8", page_cte(hrefs=True) + " SELECT page_id, count(*) AS links, count(DISTINCT u) AS different, min(u) AS lowest, "
       "max(u) AS highest FROM (SELECT page_id, regexp_replace(link, '#.*$', '') AS u FROM link_rows) AS x GROUP BY page_id")
def absolutes(c):
    from crawlscore.plans.side_tables import links

    return links(c.docs).groupBy(F.col("page_key.id").alias("page_id")).agg(
        F.count("*").alias("links"), F.countDistinct("link").alias("different"),
        F.min("link").alias("lowest"), F.max("link").alias("highest"))


@query("B9", _pages(f"""array_to_string(list_filter([
  CASE WHEN regexp_matches({PATH}, '[A-Z]') THEN 'capital letters' END,
  CASE WHEN contains({PATH}, '_') THEN 'underscores instead of hyphens' END,
  CASE WHEN contains({PATH}, '%20') OR contains({PATH}, ' ') OR contains({PATH}, '+') THEN 'spaces' END,
  CASE WHEN contains({PATH}, '//') THEN 'double slash' END,
  CASE WHEN starts_with(url, 'http:') THEN 'links to the insecure http:// version' END], x -> x IS NOT NULL), ', ') AS problems,
  array_to_string(list_filter([CASE WHEN length(url) > 115 THEN 'longer than 115 characters' END,
  CASE WHEN len(list_filter(string_split({PATH}, '/'), x -> x <> '')) > 4 THEN 'more than 4 folders deep' END,
  CASE WHEN regexp_matches({PATH}, '[.]html$') THEN 'technical ending (html)' END], x -> x IS NOT NULL), ', ') AS notes"""))
def url_problems(c):
    return c.table("pages").select(
        "page_id", F.array_join(urls.url_problems(F.col("url"), F.lit(True)), ", ").alias("problems"),
        F.array_join(urls.url_notes(F.col("url")), ", ").alias("notes"))


@query("B10", _pages(f"concat('https://', regexp_extract(url, '://([^/?#]+)', 1), lower({PATH}), regexp_extract(url, '([?][^#]+)', 1)) AS clean"))
def clean_urls(c):
    return c.table("pages").select("page_id", urls.clean_url(F.col("url")).alias("clean"))


@query("B11", page_cte(hrefs=True) + " SELECT page_id, count(*) FILTER (WHERE NOT regexp_matches(lower(link), '[.](pdf|js|png)([?]|$)')) AS pages "
       "FROM link_rows GROUP BY page_id")
def page_addresses(c):
    from crawlscore.plans.side_tables import links

    return links(c.docs).groupBy(F.col("page_key.id").alias("page_id")).agg(
        F.count_if(urls.is_page_address(F.col("link"))).alias("pages"))


@query("B12", _pages(f"array_to_string(list_filter(string_split(lower({PATH}), '/'), x -> x <> ''), ' > ') AS segments"))
def segments(c):
    return c.table("pages").select(
        "page_id", F.array_join(urls.path_segments(F.col("url")), " > ").alias("segments"))


_IMG = page_cte() + """, img AS (SELECT page_id, unnest(regexp_extract_all(html, '<img[^>]*>')) AS tag FROM op)"""


def _images(c):
    return layered(c.docs, FEATURES, {"images"}).select(
        F.col("page_key.id").alias("page_id"), F.explode("images").alias("i"))


@query("B13", _IMG + """ SELECT page_id, regexp_replace(regexp_extract(regexp_extract(tag, ' src="([^"]*)"', 1), '([^/]*)$', 1),
  '[.](jpg|png|gif)$', '') AS stem, count(*) AS n FROM img WHERE NOT contains(tag, 'src="data:') GROUP BY 1, 2""")
def stems(c):
    return _images(c).where("NOT startswith(i.src, 'data:')").groupBy(
        "page_id", urls.file_stem(F.col("i.src")).alias("stem")).agg(F.count("*").alias("n"))


@query("B14", _IMG + """ SELECT page_id, CASE WHEN NOT contains(tag, 'alt=') THEN 'no alt text' WHEN regexp_matches(lower(alt), '^(photo|banner[.])$')
  THEN concat('alt text "', alt, '" says nothing') WHEN regexp_matches(alt, '^DSC [0-9]+$') THEN 'alt text is a file name' ELSE '' END AS problem,
  count(*) AS n FROM (SELECT *, regexp_extract(tag, 'alt="([^"]*)"', 1) AS alt FROM img) AS x GROUP BY 1, 2""")
def alts(c):
    return _images(c).groupBy("page_id", tx.alt_problem(F.col("i.alt")).alias("problem")).agg(
        F.count("*").alias("n"))


@query("B15", "SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, "
       "left(regexp_replace(text, '[^0-9]', '', 'g'), 20) AS first_digits FROM documents")
def digit_strings(c):
    numbers = tx.digits(F.col("text"))
    return c.table("documents").select(
        "doc_id", F.length(numbers).cast("bigint").alias("n_digits"),
        F.left(numbers, F.lit(20)).alias("first_digits"))


@query("B16", "SELECT c_custkey, length(c_name) >= 9 AND right(regexp_replace(c_name, '[^0-9]', '', 'g'), 9) = "
       "right(concat('880', regexp_replace(c_name, '[^0-9]', '', 'g')), 9) AND "
       "length(regexp_replace(c_name, '[^0-9]', '', 'g')) >= 9 AS same FROM customer")
def same_numbers(c):
    number = tx.digits(F.col("c_name"))
    return c.table("customer").select(
        "c_custkey", tx.same_number(number, F.concat(F.lit("880"), number)).alias("same"))


@query("B17")  # the pattern looks behind, which DuckDB's expressions cannot
def phones(c):
    return c.table("documents").select(
        "doc_id", F.explode(tx.phones_in(F.col("text"))).alias("phone"))


@query("B18", "SELECT doc_id, regexp_matches(text, '[\\w.+-]+@[\\w-]+(?:[.][\\w-]+)+') AS has_email FROM documents")
def emails(c):
    return c.table("documents").select("doc_id", tx.has_email(F.col("text")).alias("has_email"))


def _el(c, name: str, sql: str):
    return c.docs.selectExpr("page_key.id AS page_id", f"{sql} AS {name}")


@query("B19", page_cte() + " SELECT page_id, array_to_string(regexp_extract_all(html, 'href=\"tel:([^\"]*)\"', 1), ',') AS tel, "
       "array_to_string(regexp_extract_all(html, 'href=\"mailto:([^\"]*)\"', 1), ',') AS mail FROM op")
def targets(c):
    return c.docs.selectExpr(
        "page_key.id AS page_id", f"array_join({el.link_targets('elements', 'tel:')}, ',') AS tel",
        f"array_join({el.link_targets('elements', 'mailto:')}, ',') AS mail")


@query("B20", page_cte() + " SELECT page_id, contains(html, '//wa.me/') AS chat, contains(html, 'google.com/maps') AS map FROM op")
def signs(c):
    return c.docs.selectExpr(
        "page_key.id AS page_id", f"{el.has_link_to('elements', fv.WHATSAPP_SIGNS)} AS chat",
        f"{el.has_link_to('elements', fv.MAP_SIGNS)} AS map")


@query("B21", "SELECT o_orderkey, [o_custkey // 10, o_custkey % 10] > [o_orderkey // 100, o_orderkey % 100] AS newer FROM orders")
def versions(c):
    left = F.concat_ws(".", F.floor(F.col("o_custkey") / 10), F.col("o_custkey") % 10)
    right = F.concat_ws(".", F.floor(F.col("o_orderkey") / 100), F.col("o_orderkey") % 100)
    return c.table("orders").select(
        "o_orderkey", (tx.version_tuple(left) > tx.version_tuple(right)).alias("newer"))


@query("B22", page_cte() + """ SELECT page_id, library, version, outdated FROM (SELECT page_id, CASE WHEN contains(html, 'jquery-3.4.1') THEN 'jQuery 3.4.1 yes'
  WHEN contains(html, 'jquery-3.7.1') THEN 'jQuery 3.7.1 no' WHEN contains(html, 'bootstrap@4.1.0') THEN 'Bootstrap 4.1.0 yes' WHEN contains(html, '/lodash/4.17.20')
  THEN 'Lodash 4.17.20 yes' END AS x FROM op) AS y, LATERAL (SELECT split_part(x, ' ', 1) AS library, split_part(x, ' ', 2) AS version, split_part(x, ' ', 3) = 'yes' AS outdated) AS z
  WHERE x IS NOT NULL""")
def libraries(c):
    return c.docs.selectExpr("page_key.id AS page_id", "inline(script_libraries)")


@query("B23", page_cte() + f""", t AS (SELECT page_id, {first('html', '<title>([^<]*)</title>')} AS t, {PATH.replace('url', 'final_url')} AS p FROM op)
  SELECT page_id, CASE WHEN contains(t, ' | ') THEN trim(string_split(t, ' | ')[-1]) WHEN contains(t, ' - ') THEN trim(string_split(t, ' - ')[-1]) ELSE t END AS site_name,
  CASE WHEN s = '' THEN '' ELSE concat(upper(left(s, 1)), lower(substr(s, 2))) END AS slug FROM (SELECT *, trim(regexp_replace(regexp_extract(p, '([^/]*)/*$', 1), '[-_]+', ' ', 'g')) AS s FROM t) AS u""")
def slugs(c):
    slug = F.regexp_extract(urls.path_of(F.col("final_url")), "([^/]*)/*$", 1)
    rows = layered(c.docs, FEATURES, {"title"})
    return rows.select(
        F.col("page_key.id").alias("page_id"),
        tx.site_name_from_title(F.col("title")).alias("site_name"), tx.humanize(slug).alias("slug"))


# --- B: numbers and words -----------------------------------------------------------------------


@query("B24", "SELECT event_id, CAST(floor(value + 0.5) AS INT) AS rounded FROM events")
def rounded(c):
    return c.table("events").select("event_id", tx.round_half_up(F.col("value")).alias("rounded"))


@query("B25", """SELECT DISTINCT m AS minutes, CASE WHEN m < 60 THEN concat('about ', m, ' minutes') WHEN m < 720 THEN CASE WHEN h = 1 THEN 'about 1 hour' ELSE concat('about ', h, ' hours') END
  ELSE CASE WHEN d = 1 THEN 'about 1 day' ELSE concat('about ', d, ' days') END END AS words FROM (SELECT m, CAST(round_even(m / 60.0, 0) AS INT) AS h, CAST(round_even(m / 480.0, 0) AS INT) AS d
  FROM (SELECT CAST(floor(l_quantity * 40 + l_linenumber * 5) AS INT) AS m FROM lineitem) AS x) AS y""")
def duration_words(c):
    minutes = F.floor(F.col("l_quantity") * 40 + F.col("l_linenumber") * 5).cast("int")
    return c.table("lineitem").select(minutes.alias("minutes")).distinct().select(
        "minutes", tx.duration(F.col("minutes")).alias("words"))


@query("B26", """SELECT o_custkey, CASE WHEN t = 1 THEN 'Your homepage is open' WHEN k = t THEN concat('All ', t, ' pages we checked are open')
  ELSE concat(k, ' of the ', t, ' pages we checked ', CASE WHEN k = 1 THEN 'is open' ELSE 'are open' END) END AS sentence
  FROM (SELECT o_custkey, count(*) AS t, count(*) FILTER (WHERE o_orderstatus = 'O') AS k FROM orders GROUP BY o_custkey) AS x""")
def page_sentences(c):
    counts = c.table("orders").groupBy("o_custkey").agg(
        F.count("*").alias("t"), F.count_if(F.col("o_orderstatus") == "O").alias("k"))
    return counts.select(
        "o_custkey", tx.on_pages(F.col("k"), F.col("t"), "is open", "are open").alias("sentence"))


@query("B27", """SELECT o_custkey, round(greatest(0, 1 - (f + 0.5 * p) / t::DOUBLE), 9)::DOUBLE AS score FROM (SELECT o_custkey, count(*) AS t,
  count(*) FILTER (WHERE o_orderstatus = 'F') AS f, count(*) FILTER (WHERE o_orderstatus = 'P') AS p FROM orders GROUP BY o_custkey) AS x""")
def share_scores(c):
    counts = c.table("orders").groupBy("o_custkey").agg(
        F.count("*").alias("t"), F.count_if(F.col("o_orderstatus") == "F").alias("f"),
        F.count_if(F.col("o_orderstatus") == "P").alias("p"))
    return counts.select("o_custkey", F.round(
        tx.share_score(F.col("t"), F.col("f"), F.col("p")), 9).alias("score"))


_SCORE = "CASE WHEN value <= 100 THEN CAST(floor(value) AS INT) END"


@query("B28", f"""SELECT event_id, CASE WHEN s < 50 THEN 'urgent' WHEN s < 90 THEN 'attention' WHEN s IS NOT NULL THEN 'healthy' END AS band,
  CASE WHEN s < 50 THEN 'Needs urgent care' WHEN s < 90 THEN 'Needs attention' WHEN s IS NOT NULL THEN 'Healthy' ELSE 'Not checked' END AS label
  FROM (SELECT event_id, {_SCORE} AS s FROM events) AS x""")
def bands(c):
    rows = c.table("events").selectExpr("event_id", f"{_SCORE} AS s")
    return rows.select("event_id", tx.band(F.col("s")).alias("band"),
                       tx.band_label(F.col("s")).alias("label"))


@query("B29", """WITH x AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'info' WHEN 'purchase' THEN 'warn' WHEN 'error' THEN 'fail' ELSE event_type END AS s FROM events)
  SELECT event_id, CASE s WHEN 'fail' THEN 'Needs treatment' WHEN 'warn' THEN 'Worth fixing' WHEN 'info' THEN 'Good to know' WHEN 'pass' THEN 'Healthy' ELSE s END AS label,
  CASE s WHEN 'fail' THEN 'urgent' WHEN 'warn' THEN 'attention' WHEN 'pass' THEN 'healthy' ELSE 'none' END AS band FROM x""")
def severities(c):
    rows = c.table("events").selectExpr(
        "event_id", "CASE event_type WHEN 'view' THEN 'pass' WHEN 'click' THEN 'info' WHEN 'purchase' "
                    "THEN 'warn' WHEN 'error' THEN 'fail' ELSE event_type END AS s")
    return rows.select("event_id", tx.severity_label(F.col("s")).alias("label"),
                       tx.severity_band(F.col("s")).alias("band"))


_NOTE = ("concat('Element has insufficient color contrast of ', CAST(CAST(floor(value) AS INT) AS STRING), '.11 (foreground color: #', substr(md5(CAST(event_id AS STRING)), 1, 6), "
         "', background color: #', substr(md5(CAST(event_id AS STRING)), 7, 3), ', font size: 12pt). Expected contrast ratio of 4.5:1')")


@query("B30", """SELECT event_id, concat(CAST(floor(value) AS INT), '.11') AS ratio, concat('#', substr(md5(CAST(event_id AS STRING)), 1, 6)) AS fg,
  concat('#', substr(md5(CAST(event_id AS STRING)), 7, 3)) AS bg, '4.5:1' AS expected FROM events""")
def contrasts(c):
    rows = c.table("events").selectExpr("event_id", f"{_NOTE} AS note")
    return rows.select("event_id", tx.contrast_facts(F.col("note")).alias("f")).select(
        "event_id", "f.ratio", "f.fg", "f.bg", "f.expected")


@query("B31", _pages(f"regexp_replace({HOST}, '^www[.]', '') AS host, concat({PATH}, regexp_extract(url, '([?][^#]+)', 1)) AS path"))
def hosts_and_paths(c):
    return c.table("pages").select("page_id", urls.url_host(F.col("url")).alias("host"),
                                   urls.url_path(F.col("url")).alias("path"))


@query("B32", page_cte() + """ SELECT page_id, array_to_string(list_slice(h, 1, 3), ' ') AS shown, greatest(len(h) - 3, 0)::INT AS more
  FROM (SELECT page_id, list_transform(regexp_extract_all(html, '<a href="([^"]*)"', 1), x -> replace(x, '&amp;', '&')) AS h FROM op) AS x""")
def first_few(c):
    hrefs = f"transform({el.tagged('elements', 'a')}, e -> e.attrs['href'])"
    rows = c.docs.selectExpr("page_key.id AS page_id", f"{hrefs} AS h")
    return rows.select("page_id", F.array_join(tx.first_items(F.col("h"), 3), " ").alias("shown"),
                       tx.remaining(F.col("h"), 3).alias("more"))


def _pad(byte: int) -> str:
    """The salt's padded key against one byte, as a DuckDB blob."""
    return "'" + "".join(f"\\x{b ^ byte:02X}" for b in b"salt".ljust(64, b"\0")) + "'::BLOB"


@query("B33", f"""SELECT event_id, sha256({_pad(0x5C)} || unhex(sha256({_pad(0x36)} || encode(concat('10.0.', user_id // 256, '.', user_id % 256))))) AS ip_hash FROM events""")
def ip_hashes(c):
    ip = F.concat_ws(".", F.lit("10"), F.lit("0"), F.floor(F.col("user_id") / 256),
                     F.col("user_id") % 256)
    return c.table("events").select("event_id", tx.hash_ip(ip, "salt").alias("ip_hash"))


_SUMMARY = "concat('Fix any of the following:', chr(10), '  ', event_type, ' is wrong ', chr(10), chr(10), 'fix all: x', chr(10), props)"


@query("B34", "SELECT event_id, concat(event_type, ' is wrong ', props) AS problem FROM events")
def problem_texts(c):
    return c.table("events").selectExpr("event_id", f"{_SUMMARY} AS s").select(
        "event_id", tx.problem_text(F.col("s")).alias("problem"))


@query("B35", "SELECT event_id, replace(replace(replace(props, '&', '&amp;'), '<', '&lt;'), '\"', '&quot;') AS escaped FROM events")
def escapes(c):
    return c.table("events").select("event_id", tx.html_escape(F.col("props")).alias("escaped"))


# --- C: elements -----------------------------------------------------------------------------------


def _features(c, *names: str):
    return layered(c.docs, FEATURES, set(names)).selectExpr("page_key.id AS page_id", *names)


@query("C1", page_cte() + f""" SELECT page_id, CASE WHEN contains(html, 'name="description"') THEN {first('html', '<meta name="description" content="([^"]*)"')} END AS description,
  CASE WHEN contains(html, '"og:title"') THEN {first('html', '"og:title" content="([^"]*)"')} END AS og_title,
  CASE WHEN contains(html, 'http-equiv="refresh"') THEN '5; url=/next' END AS refresh_meta FROM op""")
def metas(c):
    return _features(c, "description", "og_title", "refresh_meta")


@query("C2", page_cte() + f" SELECT page_id, {first('html', '<title>([^<]*)</title>')} AS title FROM op")
def titles(c):
    return _features(c, "title")


@query("C3", page_cte() + """ SELECT page_id, len(regexp_extract_all(lower(html), 'rel="(shortcut )?icon"')) AS icons,
  len(regexp_extract_all(lower(html), 'rel="stylesheet"')) AS sheets FROM op""")
def rels(c):
    return c.docs.selectExpr(
        "page_key.id AS page_id",
        f"CAST(size({el.links_with_rel('elements', 'icon')}) AS BIGINT) AS icons",
        f"CAST(size({el.links_with_rel('elements', 'stylesheet')}) AS BIGINT) AS sheets")


@query("C4", page_cte() + """ SELECT page_id, CASE WHEN n = 1 THEN 'body > nav > ul > li > a' ELSE concat('body > nav > ul > li:nth-of-type(', i, ') > a') END AS path
  FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n, unnest(range(1, len(regexp_extract_all(html, '<li>')) + 1)) AS i FROM op) AS x""")
def css_paths(c):
    return c.docs.selectExpr("page_key.id AS page_id", f"explode({el.tagged('elements', 'a')}) AS e").selectExpr(
        "page_id", "e.path").where("startswith(path, 'body > nav')")


@query("C5", page_cte() + """ SELECT page_id, concat('<img src="', coalesce(nullif(left(regexp_extract(src, '([^/]*)$', 1), 50), ''), left(src, 50)), '">') AS label
  FROM (SELECT page_id, unnest(regexp_extract_all(html, '<img[^>]* src="([^"]+)"', 1)) AS src FROM op) AS x""")
def descriptions(c):
    return c.docs.selectExpr(
        "page_key.id AS page_id",
        f"explode(filter({el.tagged('elements', 'img')}, e -> {el.attr('src')} <> '')) AS e"
    ).selectExpr("page_id", f"{el.described()} AS label").where("label LIKE '<img src=%' ")


@query("C6", page_cte() + """ SELECT page_id, i AS shot_ord, replace(hrefs[i], '&amp;', '&') AS href, CASE WHEN i <= n THEN
    'body > nav > ul > li' || CASE WHEN n = 1 THEN '' ELSE concat(':nth-of-type(', i, ')') END || ' > a' END AS selector
  FROM (SELECT page_id, len(regexp_extract_all(html, '<li>')) AS n, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM op) AS x,
    LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS i) AS h""")
def shots(c):
    """All links of a page; their paths are compared within the page's menu."""
    return _shots(c).withColumn("selector", F.when(F.col("selector").startswith("body > nav"), F.col("selector")))


@query("C6_all", page_cte() + """ SELECT page_id, i AS shot_ord, replace(hrefs[i], '&amp;', '&') AS href
  FROM (SELECT page_id, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hrefs FROM op) AS x, LATERAL (SELECT unnest(range(1, len(hrefs) + 1)) AS i) AS h""")
def all_shots(c):
    return _shots(c).drop("selector")


def _shots(c):
    found = el.shots(el.tagged("elements", "a"), "final_url")
    rows = c.docs.selectExpr("page_key.id AS page_id", f"posexplode({found}) AS (i, s)")
    return rows.selectExpr("page_id", "CAST(i + 1 AS BIGINT) AS shot_ord", "s.selector", "s.match_value AS href")


_TEXT = ("replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '(?s)<script.*?</script>|<!--.*?-->', '', 'g'), "
         "'</?[a-z][^>]*>', '', 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&')")
_FLAT = "len(regexp_replace({t}, '\\s+', '', 'g'))"


@query("C8", page_cte() + f" SELECT page_id, {_FLAT.format(t=_TEXT)} AS letters FROM op")
def visible_text(c):
    return c.docs.selectExpr(
        "page_key.id AS page_id",
        "CAST(length(regexp_replace(visible_text, r'[\\s\\x00]+', '')) AS BIGINT) AS letters")


_PIECES = ("len(array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), "
           "'(?s)<script.*?</script>|<!--.*?-->', chr(1), 'g'), '</?[a-z][^>]*>', chr(1), 'g'), '&middot;', '·'), '&copy;', '©'), '&quot;', '\"'), '&amp;', '&'), chr(1)), "
           "x -> trim(x)), x -> x <> ''), ' '))")


@query("C9", page_cte() + f" SELECT page_id, {_PIECES}::INT AS visible_length FROM op")
def visible_lengths(c):
    return c.docs.selectExpr("page_key.id AS page_id", "visible_length")


@query("C10", page_cte() + """ SELECT page_id, name, count(*) AS n FROM (SELECT page_id, CASE WHEN contains(a, 'aria-label=') THEN regexp_extract(a, 'aria-label="([^"]*)"', 1)
  ELSE """ + decoded("trim(regexp_replace(a, '<[^>]*>', '', 'g'))") + """ END AS name FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<a href=[^>]*>.*?</a>|<button[^>]*>.*?</button>')) AS a FROM op) AS x) AS y GROUP BY 1, 2""")
def names(c):
    rows = c.docs.selectExpr("page_key.id AS page_id", f"explode({el.controls('elements')}) AS e")
    return rows.selectExpr("page_id", f"{el.accessible_name()} AS name").groupBy(
        "page_id", "name").agg(F.count("*").alias("n"))


@query("C11", page_cte() + """ SELECT page_id, len(f)::INT AS fields_total, len(list_filter(f, x -> NOT contains(x, 'id="e"') AND NOT contains(x, 'name="n"') AND NOT contains(x, 'aria-label=')))::INT AS fields_unlabelled
  FROM (SELECT page_id, list_filter(regexp_extract_all(html, '<(?:input|select|textarea)[^>]*>'), x -> NOT regexp_matches(x, 'type="(hidden|submit)"')) AS f FROM op) AS x""")
def labels(c):
    return _features(c, "fields_total", "fields_unlabelled")


_OUT = ("list_transform(regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>'), h -> {'level': CAST(substr(h, 3, 1) AS INT), 'text': trim("
        + decoded("regexp_replace(regexp_replace(h, '<img[^>]* ?alt=\"([^\"]*)\"[^>]*>', '\\1', 'g'), ' ?<[^>]*>', '', 'g')") + ")})")


@query("C12", page_cte() + f" SELECT page_id, array_to_string(list_transform({_OUT}, x -> concat(x.level, ' ', x.text)), '|') AS outline FROM op")
def outlines(c):
    return layered(c.docs, FEATURES, {"outline"}).selectExpr(
        "page_key.id AS page_id",
        "array_join(transform(outline, h -> concat(h.level, ' ', h.text)), '|') AS outline")


@query("C13", page_cte() + f""" SELECT page_id, array_to_string(list_transform(range(1, len(o) + 1), i -> concat(repeat('  ', (o[i].level - 1)::INT), 'H', o[i].level, '  ',
  CASE WHEN o[i].text = '' THEN '(no text)' WHEN length(o[i].text) <= 80 THEN o[i].text ELSE concat(left(o[i].text, 77), '...') END,
  CASE WHEN m[i] <> '' THEN concat('   <-- ', m[i]) ELSE '' END)), chr(10)) AS outline FROM (SELECT page_id, o, list_transform(range(1, len(o) + 1), i -> array_to_string(list_filter([
  CASE WHEN o[i].text = '' THEN 'empty' END, CASE WHEN o[i].level = 1 AND len(list_filter(o, x -> x.level = 1)) > 1 THEN concat('one of ', len(list_filter(o, x -> x.level = 1)), ' H1s') END,
  CASE WHEN i > 1 AND o[i].level > o[i - 1].level + 1 THEN concat('skips H', o[i - 1].level + 1) END], x -> x IS NOT NULL), ', ')) AS m
  FROM (SELECT page_id, {_OUT} AS o FROM op) AS x) AS y""")
def outline_texts(c):
    rows = layered(c.docs, FEATURES, {"outline"})
    return rows.selectExpr("page_key.id AS page_id", f"{outline_text('outline')} AS outline")


@query("C14", page_cte() + " SELECT page_id, " + ", ".join(
    f"coalesce({first('html', pattern)}, '') AS {name}" for name, pattern in [
        ("title", '"og:title" content="([^"]*)"'), ("description", '"og:description" content="([^"]*)"'),
        ("image", '"og:image" content="([^"]*)"'), ("site_name", '"og:site_name" content="([^"]*)"'),
        ("type", '"og:type" content="([^"]*)"'), ("twitter_card", '"twitter:card" content="([^"]*)"')]) + " FROM op")
def preview_tags(c):
    rows = layered(c.docs, FEATURES, {
        "og_title", "og_description", "preview_image", "og_site_name", "og_type", "twitter_card"})
    return rows.selectExpr(
        "page_key.id AS page_id", "coalesce(og_title, '') AS title",
        "coalesce(og_description, '') AS description", "preview_image AS image",
        "coalesce(og_site_name, '') AS site_name", "coalesce(og_type, '') AS type",
        "coalesce(twitter_card, '') AS twitter_card")


@query("C15", page_cte() + """ SELECT page_id, array_to_string(list_filter([CASE WHEN NOT contains(html, '"og:title"') THEN 'og:title' END, CASE WHEN NOT contains(html, '"og:description"') THEN 'og:description' END,
  CASE WHEN NOT contains(html, '"og:image"') THEN 'og:image' END, CASE WHEN NOT contains(html, 'twitter:card') THEN 'twitter:card' END,
  CASE WHEN regexp_matches(html, '"og:image" content="(/|img)') THEN 'og:image is not a full address' END], x -> x IS NOT NULL), ', ') AS problems FROM op""")
def preview_problems(c):
    return layered(c.docs, FEATURES, {"preview_problems"}).selectExpr(
        "page_key.id AS page_id", "array_join(preview_problems, ', ') AS problems")


def _preview(c):
    rows = layered(c.docs, FEATURES, {
        "title", "description", "og_title", "og_description", "preview_image", "og_url", "og_type",
        "og_site_name", "twitter_card"})
    image = urls.absolute(F.col("final_url"), F.col("preview_image"))
    return rows.withColumn("image_url", F.coalesce(
        F.when(F.col("preview_image") != "", image), F.lit("")))


_IMAGE = (f"CASE WHEN contains(html, 'content=\"/preview.png\"') THEN concat({origin('final_url')}, '/preview.png') WHEN contains(html, 'content=\"img/p.png\"') THEN "
          f"concat({origin('final_url')}, regexp_extract(final_url, '^https?://[^/?#]+((?:/[^/?#]*)*/)[^/?#]*(?:[?].*)?$', 1), 'img/p.png') ELSE {first('html', '\"og:image\" content=\"([^\"]*)\"')} END")


@query("C16", page_cte() + f""" SELECT page_id, regexp_replace(audit_id, '^www[.]', '') AS domain, CASE WHEN contains(html, '"og:title"') THEN {first('html', '"og:title" content="([^"]*)"')} ELSE {first('html', '<title>([^<]*)</title>')} END AS title,
  CASE WHEN contains(html, '"og:description"') THEN {first('html', '"og:description" content="([^"]*)"')} ELSE {first('html', '<meta name="description" content="([^"]*)"')} END AS description, {_IMAGE} AS image_url FROM op""")
def previews(c):
    return _preview(c).select(
        F.col("page_key.id").alias("page_id"), urls.url_host(F.col("final_url")).alias("domain"),
        F.expr("coalesce(nullif(og_title, ''), title)").alias("title"),
        F.expr("coalesce(nullif(og_description, ''), description, '')").alias("description"),
        "image_url")


@query("C17", page_cte() + """ SELECT page_id, CASE WHEN contains(html, '"og:type"') THEN 'article' ELSE 'website' END AS og_type, NOT contains(html, '"og:image"') AS asks_picture, 7::BIGINT AS lines FROM op""")
def preview_blocks(c):
    rows = _preview(c).selectExpr("page_key.id AS page_id", f"{preview_block()} AS block")
    return rows.selectExpr(
        "page_id", "regexp_extract(block, 'og:type\" content=\"([a-z]+)', 1) AS og_type",
        "contains(block, 'REPLACE: full address') AS asks_picture",
        "CAST(size(split(block, '\\n')) AS BIGINT) AS lines")


@query("C18", page_cte() + f""" SELECT page_id, array_to_string(list_filter([CASE WHEN {first('html', '<title>([^<]*)</title>')} = '' THEN 'title' END, CASE WHEN {first('html', '<meta name="description" content="([^"]*)"')} = '' THEN 'description' END,
  CASE WHEN NOT contains(lower(html), 'name="viewport"') THEN 'viewport' END, CASE WHEN NOT contains(html, '<meta charset') THEN 'charset' END, CASE WHEN NOT contains(html, 'rel="canonical"') THEN 'canonical' END,
  CASE WHEN NOT contains(html, '<html lang') THEN 'lang' END], x -> x IS NOT NULL), ',') AS missing FROM op""")
def core_tags(c):
    rows = layered(c.docs, FEATURES, {"core_tags_missing", "lang"})
    return rows.selectExpr(
        "page_key.id AS page_id",
        "array_join(concat(core_tags_missing, if(lang = '', array('lang'), CAST(array() AS ARRAY<STRING>))), ',') AS missing")


@query("C19", page_cte() + """ SELECT page_id, CASE WHEN contains(html, 'content="NOINDEX') THEN 9 ELSE 8 END::BIGINT AS lines, NOT contains(html, 'name="description"') AS asks_description,
  replace(CASE WHEN regexp_matches(html, 'rel="canonical" href="http') THEN regexp_extract(html, 'rel="canonical" href="([^"]*)"', 1) ELSE final_url END, '&', '&amp;') AS canonical FROM op""")
def head_blocks(c):
    rows = layered(c.docs, FEATURES, {"title", "description", "canonicals", "lang", "robots_meta"})
    blocks = rows.selectExpr("page_key.id AS page_id", f"{head_block()} AS block")
    return blocks.selectExpr(
        "page_id", "CAST(size(split(block, '\\n')) AS BIGINT) AS lines",
        "contains(block, 'REPLACE: what this page offers') AS asks_description",
        "regexp_extract(block, 'canonical\" href=\"([^\"]*)', 1) AS canonical")


@query("C20", page_cte() + """ SELECT page_id, q.question, q.answer FROM op, LATERAL (SELECT unnest(CASE WHEN contains(html, '<h2>Prices?</h2>') THEN [{'question': 'Prices?', 'answer': 'From 10.'}, {'question': 'Open now?', 'answer': 'Yes.'}]
  WHEN contains(html, '<summary>How much?') THEN [{'question': 'How much?', 'answer': 'Ten.'}, {'question': 'Late?', 'answer': 'No.'}, {'question': 'Cash?', 'answer': 'Yes.'}] ELSE [] END) AS q) AS x""")
def questions(c):
    return c.docs.selectExpr("page_key.id AS page_id", f"inline({el.question_pairs('elements')})")


@query("C21", page_cte() + """ SELECT page_id, regexp_extract(html, 'href="tel:([^"?]*)', 1) AS phone, regexp_extract(html, 'href="mailto:([^"?]*)', 1) AS mail FROM op""")
def link_values(c):
    rows = layered(c.docs, FEATURES, {"first_phone", "first_mail"})
    return rows.selectExpr("page_key.id AS page_id", "first_phone AS phone", "first_mail AS mail")


@query("C22", page_cte() + """ SELECT page_id, CASE WHEN contains(html, 'facebook.com/shop') THEN 'https://www.facebook.com/shop' ELSE '' END AS profiles FROM op""")
def profiles(c):
    return layered(c.docs, FEATURES, {"profiles"}).selectExpr(
        "page_key.id AS page_id", "array_join(profiles, ' ') AS profiles")


@query("C23", page_cte() + """ SELECT page_id, len(list_filter(string_split_regex(regexp_replace(regexp_replace(regexp_replace(html, '(?s)^.*?<body>', ''), '<!--.*?-->', ' ', 'g'), '</?[a-z][^>]*>', ' ', 'g'), '\\s+'), w -> w <> ''))::INT AS body_words FROM op""")
def word_counts(c):
    return c.docs.selectExpr("page_key.id AS page_id", "body_words")
