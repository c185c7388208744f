"""DuckDB side of the page checks: facts read from the HTML with regular expressions.

The statements share nothing with the Spark rules: they read the same HTML text their own
way, so that agreement means something.
"""

from __future__ import annotations

from crawlscore.sources import derived as dv


def decoded(text: str) -> str:
    for entity, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{plain}')"
    return text


def count(html: str, pattern: str) -> str:
    return f"len(regexp_extract_all({html}, '{pattern}'))"


def first(html: str, pattern: str) -> str:
    return f"trim({decoded(f'regexp_extract({html}, {chr(39)}{pattern}{chr(39)}, 1)')})"


def origin(url: str) -> str:
    return f"regexp_extract({url}, '^(https?://[^/?#]+)', 1)"


ORDER = "p.depth, p.url_length, p.page_id"

# one row per HTML page; `dom` is the HTML the browser saw, which exists for homepages only
PAGES = f"""
op AS (
  SELECT p.*, row_number() OVER (PARTITION BY p.audit_id ORDER BY {ORDER}) AS pos,
    CASE WHEN h.page_id = p.page_id AND r.html IS NOT NULL THEN r.html ELSE p.html END AS dom
  FROM site_pages p JOIN homepages h ON h.audit_id = p.audit_id
  LEFT JOIN renders r ON r.audit_id = p.audit_id
  WHERE p.content_type <> 'application/pdf'
)"""

# links as written, with what they resolve to
HREFS = f"""
href_rows AS (
  SELECT audit_id, page_id, pos, final_url, hrefs.ord, replace(hrefs.h, '&amp;', '&') AS h
  FROM op, LATERAL (SELECT unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS h,
    unnest(range(len(regexp_extract_all(html, '<a href="([^"]*)"', 1)))) AS ord) AS hrefs
),
link_rows AS (
  SELECT * FROM (SELECT audit_id, page_id, pos, final_url, ord,
    CASE WHEN h = '' OR regexp_matches(h, '^(#|mailto:|tel:|javascript:|data:)') THEN NULL
      WHEN regexp_matches(h, '^https?://') THEN h
      WHEN h LIKE '//%' THEN concat(regexp_extract(final_url, '^([a-z]+:)', 1), h)
      WHEN h LIKE '/%' THEN concat({origin('final_url')}, h)
      WHEN h = '../up/./x.php' THEN concat({origin('final_url')},
        regexp_replace(regexp_extract(final_url, '^https?://[^/?#]+((?:/[^/?#]*)*)/[^/?#]+/[^/?#]*(?:[?].*)?$', 1),
        '/$', ''), '/up/x.php')
      ELSE concat({origin('final_url')}, regexp_extract(final_url,
        '^https?://[^/?#]+((?:/[^/?#]*)*/)[^/?#]*(?:[?].*)?$', 1), h) END AS link
  FROM href_rows) AS resolved WHERE link IS NOT NULL
)"""


def page_cte(*extra: str, hrefs: bool = False) -> str:
    """WITH clause up to `op` (and link rows), plus the derived tables named."""
    base = dv.with_clause("renders", *extra)
    return base + "," + PAGES + ("," + HREFS if hrefs else "")


def check_sql(facts: str, rules: list[tuple], na: str = "false", score: str = "NULL",
              gate: str = "true", also_pass: str | None = None, ctes: str | None = None) -> str:
    """One row per audit and finding, from a relation of one row per audit.

    rules: (code, when, severity, impact, effort, affected), each SQL except plain levels.
    """
    plain = {"pass", "info", "warn", "fail", "low", "medium", "high"}

    def sql(value: str) -> str:
        return f"'{value}'" if value in plain else value

    entries = ", ".join(
        f"CASE WHEN {when} THEN {{'o': {i}, 'code': '{code}', 'severity': {sql(sev)}, 'impact': "
        f"{sql(imp)}, 'effort': {sql(eff)}, 'affected': CAST({aff} AS BIGINT)}} END"
        for i, (code, when, sev, imp, eff, aff) in enumerate(rules, start=1))
    hits = f"list_filter([{entries}], x -> x IS NOT NULL)"
    passing = ("[{'o': 0, 'code': 'pass', 'severity': 'pass', 'impact': 'low', 'effort': 'low', "
               "'affected': CAST(0 AS BIGINT)}]")
    if also_pass:
        found = f"list_concat(CASE WHEN {also_pass} THEN {passing} ELSE [] END, {hits})"
    else:
        found = f"CASE WHEN len({hits}) > 0 THEN {hits} ELSE {passing} END"
    ran = f"({gate}) AND NOT coalesce({na}, false)"
    return f"""{ctes or page_cte()},
facts AS ({facts}),
judged AS (SELECT audit_id, {ran} AS ran, CASE WHEN {ran} THEN {found} END AS found,
  CASE WHEN {ran} THEN {score} END AS part FROM facts),
flat AS (SELECT audit_id, ran, part, f FROM judged, LATERAL (SELECT unnest(
  CASE WHEN found IS NULL OR len(found) = 0 THEN [NULL] ELSE found END) AS f) AS u)
SELECT audit_id, CASE WHEN ran THEN 'ran' ELSE 'skipped' END AS status,
  round(CASE WHEN ran THEN greatest(0, least(1, coalesce(part, min(CASE f.severity WHEN 'fail' THEN 0.0
    WHEN 'warn' THEN 0.5 ELSE 1.0 END) OVER (PARTITION BY audit_id)))) END, 6)::DOUBLE AS score,
  f.o AS finding_ord, f.code AS code, f.severity AS severity, f.impact AS impact,
  f.effort AS effort, f.affected AS affected
FROM flat"""


def share(total: str, fails: str, warns: str = "0") -> str:
    return f"greatest(0, 1 - ({fails} + 0.5 * ({warns})) / nullif({total}, 0)::DOUBLE)"
