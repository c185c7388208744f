"""Scans, stored answers and sinks as queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import robots
from crawlscore.operators import ranking, robots_access
from crawlscore.plans import audit, element_evidence, evidence
from crawlscore.session import shared_folder
from crawlscore.sources import derived as dv
from crawlscore.sources import pages as pg
from crawlscore.sources import payloads as pl
from crawlscore.sources import sinks, snapshots
from crawlscore.suite.corpus import AS_OF, query
from crawlscore.suite.oracle_pages import page_cte

SITE_PAGES = dv.with_clause("site_pages")


@query("A1", SITE_PAGES + " SELECT page_id, split_part(content_type, ';', 1) AS content_type, content_type <> 'application/pdf' AS is_html, TRUE AS ok FROM site_pages")
def scan(c):
    return pg.scan_pages(c.pages).select(
        F.col("page_key.id").alias("page_id"), "content_type", "is_html", "ok")


@query("A2", SITE_PAGES + " SELECT page_id, final_url FROM site_pages WHERE content_type <> 'application/pdf'")
def html_only(c):
    return pg.html_pages(c.pages).select(F.col("page_key.id").alias("page_id"), "final_url")


@query("A3", page_cte() + """ SELECT page_id, len(regexp_extract_all(html, '<a[ >]')) AS links, len(regexp_extract_all(html, '<img[ >]')) AS images, len(regexp_extract_all(html, '<h[1-6][ >]')) AS headings,
  len(regexp_extract_all(html, '<meta[ >]')) AS metas, len(regexp_extract_all(html, '<(?:input|select|textarea)[ >]')) AS fields FROM op""")
def extract(c):
    def of(*tags: str) -> str:
        names = ", ".join(f"'{t}'" for t in tags)
        return f"CAST(size(filter(elements, e -> e.tag IN ({names}))) AS BIGINT)"

    return pg.page_docs(c.pages, c.parts).selectExpr(
        "page_key.id AS page_id", f"{of('a')} AS links", f"{of('img')} AS images",
        f"{of('h1', 'h2', 'h3', 'h4', 'h5', 'h6')} AS headings", f"{of('meta')} AS metas",
        f"{of('input', 'select', 'textarea')} AS fields")


@query("A4", page_cte() + " SELECT audit_id, len(regexp_extract_all(dom, '<a[ >]')) AS links, contains(dom, 'late link') AS rendered FROM op WHERE pos = 1")
def rendered_home(c):
    homes = c.docs.groupBy("audit_id").agg(F.min_by("elements", "page_key").alias("crawled"))
    seen = c.render_docs.select("audit_id", F.col("elements").alias("seen"))
    chosen = homes.join(seen, "audit_id", "left").withColumn("els", F.coalesce("seen", "crawled"))
    return chosen.selectExpr(
        "audit_id", "CAST(size(filter(els, e -> e.tag = 'a')) AS BIGINT) AS links",
        "exists(els, e -> coalesce(e.text, '') = 'late link') AS rendered")


ROBOTS = dv.with_clause("robots_files")
ROBOTS_OK = "(status_code = 200 AND content_type <> 'text/html' AND NOT starts_with(text, '<'))"


@query("A5", ROBOTS + f""" SELECT audit_id, {ROBOTS_OK} AS exists, CASE WHEN {ROBOTS_OK} THEN array_to_string(regexp_extract_all(text, '(?i)sitemap: *([^\\n]+)', 1), ' ') ELSE '' END AS sitemaps FROM robots_files""")
def robots_info(c):
    return pl.robots_info(c.derived("robots_files")).select(
        "audit_id", "exists", F.array_join("sitemaps", " ").alias("sitemaps"))


@query("A6", page_cte("robots_files") + """, asked AS (SELECT p.page_id, p.final_url, r.*, regexp_extract(p.final_url, '^https?://[^/?#]+(.*)$', 1) AS path FROM op p JOIN robots_files r USING (audit_id))
  SELECT page_id, CASE WHEN contains(text, 'GPTBot') THEN false WHEN contains(text, 'Disallow: /de') THEN NOT (starts_with(path, '/de') OR starts_with(path, '/fr')) WHEN starts_with(text, 'User-agent: *') THEN false ELSE true END AS gptbot,
  CASE WHEN contains(text, 'GPTBot') THEN starts_with(path, '/en') OR NOT starts_with(path, '/The') WHEN contains(text, 'Disallow: /de') THEN NOT (starts_with(path, '/de') OR starts_with(path, '/fr')) WHEN starts_with(text, 'User-agent: *') THEN false ELSE true END AS other FROM asked""")
def robots_decisions(c):
    files = c.derived("robots_files").selectExpr("audit_id", f"{robots.groups_sql('text')} AS robots_groups")
    asked = c.docs.select("audit_id", F.col("page_key.id").alias("page_id"), "final_url").join(
        files.select("audit_id"), "audit_id", "left_semi")
    one = robots_access.judged(asked, "final_url", files, "GPTBot", "gptbot")
    return robots_access.judged(one, "final_url", files, "OtherBot/1.0", "other").select("page_id", "gptbot", "other")


@query("A6_rules", ROBOTS + """ SELECT audit_id, len(regexp_extract_all(text, 'Disallow: /')) AS denies, len(regexp_extract_all(text, '\\nAllow: ')) + len(regexp_extract_all(text, 'Disallow:\\n')) AS allows
  FROM robots_files WHERE NOT starts_with(text, '<')""")
def robots_rule_rows(c):
    return pl.robots_rules(c.derived("robots_files")).groupBy("audit_id").agg(
        F.count_if(~F.col("allow")).alias("denies"), F.count_if("allow").alias("allows"))


SITEMAP = dv.with_clause("sitemap_files")


@query("A7", SITEMAP + """ SELECT audit_id, url, contains(text, '<sitemapindex') AS is_index, len(regexp_extract_all(text, '<loc>')) AS urls FROM sitemap_files
  WHERE ok AND contains(text, '</') AND regexp_matches(text, '</(urlset|sitemapindex)>$') AND NOT contains(text, 'DOCTYPE')""")
def sitemap_files(c):
    files = pl.sitemap_files(c.derived("sitemap_files"))
    return files.where("is_index IS NOT NULL").selectExpr(
        "audit_id", "url", "is_index", "CAST(size(locations) AS BIGINT) AS urls")


_BYTES = "concat(CASE event_type WHEN 'view' THEN 'FFD8FFE0' WHEN 'click' THEN '89504E470D0A1A0A' WHEN 'purchase' THEN '474946383961' WHEN 'signup' THEN '5249464600000000' ELSE '3C737667' END, CASE WHEN event_type = 'signup' THEN '57454250' ELSE '00' END)"


@query("A8", "SELECT event_id, CASE event_type WHEN 'view' THEN 'image/jpeg' WHEN 'click' THEN 'image/png' WHEN 'purchase' THEN 'image/gif' WHEN 'signup' THEN 'image/webp' ELSE '' END AS type FROM events")
def image_types(c):
    return c.table("events").select(
        "event_id", pl.image_type(F.unhex(F.expr(_BYTES))).alias("type"))


@query("A8_files", """SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' ELSE '' END AS type,
  1000 + s_suppkey % 50 AS length FROM supplier WHERE s_suppkey % 11 <> 0""")
def stored_image_types(c):
    """One file for each supplier, written by tasks in the shared folder and scanned again; other files are not read."""
    folder = f"{shared_folder(c.spark)}/images-{uuid.uuid4().hex}"
    heads = ["FFD8FFE0", "89504E470D0A1A0A", "474946383961", "524946460000000057454250", "3C737667", "52494646000000005741564500"]
    rows = c.table("supplier").select(
        F.concat("s_suppkey", F.when(F.col("s_suppkey") % 11 == 0, ".txt").otherwise(".img")).alias("name"),
        F.rpad(F.unhex(F.get(F.array(*map(F.lit, heads)), (F.col("s_suppkey") % 6).cast("int"))),
               (1000 + F.col("s_suppkey") % 50).cast("int"), F.lit(b"\x01")).alias("content"))
    sinks.write_files(rows, folder).count()
    found = pl.image_files(c.spark, folder, "*.img")
    return found.select(F.regexp_extract("path", r"([0-9]+)[.]img$", 1).cast("bigint").alias("s_suppkey"), "type", "length")


SITEMAP_READ = page_cte("robots_files", "sitemap_files") + f""",
ok AS (SELECT * FROM robots_files WHERE {ROBOTS_OK}),
starts AS (SELECT s.audit_id, x.u, x.i FROM sites s LEFT JOIN ok o ON o.audit_id = s.audit_id, LATERAL (SELECT unnest(CASE WHEN len(regexp_extract_all(coalesce(o.text, ''), '(?i)sitemap: *([^\\n]+)', 1)) > 0 THEN
  regexp_extract_all(o.text, '(?i)sitemap: *([^\\n]+)', 1) ELSE [concat(regexp_extract(s.home_url, '^(https?://[^/?#]+)', 1), '/sitemap.xml')] END) AS u, unnest(range(2)) AS i) AS x WHERE x.u IS NOT NULL),
read AS (SELECT t.audit_id, t.u, t.i, f.text, f.ok AND regexp_matches(f.text, '</(urlset|sitemapindex)>$') AND NOT contains(f.text, 'DOCTYPE') AS good FROM starts t LEFT JOIN sitemap_files f ON f.audit_id = t.audit_id AND f.url = t.u),
child AS (SELECT r.audit_id, regexp_extract(r.text, '<loc>([^<]*)</loc>', 1) AS u, 10 AS i FROM read r WHERE good AND contains(text, '<sitemapindex')),
read2 AS (SELECT t.audit_id, t.u, t.i, f.text, f.ok AND regexp_matches(f.text, '</(urlset|sitemapindex)>$') AS good FROM child t LEFT JOIN sitemap_files f ON f.audit_id = t.audit_id AND f.url = t.u),
steps AS (SELECT audit_id, row_number() OVER (PARTITION BY audit_id ORDER BY i) AS rank, u AS url, coalesce(good, false) AS good,
  CASE WHEN good AND contains(text, '<urlset') THEN len(regexp_extract_all(text, '<loc>')) ELSE 0 END::BIGINT AS urls FROM (SELECT * FROM read UNION ALL SELECT * FROM read2) AS a)"""


@query("A9", SITEMAP_READ + " SELECT audit_id, rank, url, good, urls FROM steps")
def sitemap_following(c):
    return _sitemap_steps(c).select("audit_id", "rank", "url", "good", "urls")


def _sitemap_steps(c):
    starts = pl.sitemap_starts(c.derived("robots_files"), c.derived("sites"))
    return pl.sitemap_steps(pl.sitemap_visits(starts, c.derived("sitemap_files")))


@query("A9_totals", SITEMAP_READ + """ SELECT audit_id, coalesce(bool_or(good), false) AS found, sum(urls)::BIGINT AS urls FROM steps GROUP BY audit_id""")
def sitemap_sums(c):
    starts = pl.sitemap_starts(c.derived("robots_files"), c.derived("sites"))
    return pl.sitemap_totals(pl.sitemap_visits(starts, c.derived("sitemap_files"))).selectExpr(
        "audit_id", "sitemap_found AS found", "CAST(sitemap_urls AS BIGINT) AS urls")


@query("A10", page_cte(hrefs=True) + " SELECT page_id, ord AS link_ord, regexp_replace(link, '#.*$', '') AS link FROM link_rows")
def page_links(c):
    from crawlscore.operators.linkgraph import page_links as found

    return found(c.docs).selectExpr(
        "page_key.id AS page_id", "CAST(link_ord AS BIGINT) AS link_ord", "link")


PSI = dv.with_clause("psi_raw")


def _number(path: str) -> str:
    return f"CAST(json_extract_string(json, '$.lighthouseResult.audits.\"{path}\".numericValue') AS DOUBLE)"


@query("A11", PSI + f""" SELECT audit_id, strategy, CAST(json_extract_string(json, '$.lighthouseResult.categories.performance.score') AS DOUBLE) AS score, {_number('largest-contentful-paint')} AS lcp_ms, {_number('cumulative-layout-shift')} AS cls,
  {_number('total-blocking-time')} AS tbt_ms, {_number('first-contentful-paint')} AS fcp_ms, CAST({_number('total-byte-weight')} AS BIGINT) AS total_bytes,
  array_to_string(list_filter(json_extract_string(json, '$.lighthouseResult.audits."render-blocking-resources".details.items[*].url'), x -> x IS NOT NULL), ' ') AS blocking,
  CAST(json_extract_string(json, '$.lighthouseResult.audits."render-blocking-resources".details.overallSavingsMs') AS DOUBLE) AS savings FROM psi_raw""")
def speed_tests(c):
    return pl.speed_tests(c.derived("psi_raw")).selectExpr(
        "audit_id", "strategy", "score", "lcp_ms", "cls", "tbt_ms", "fcp_ms", "total_bytes",
        "array_join(render_blocking, ' ') AS blocking", "render_blocking_savings_ms AS savings")


def _metric(name: str, key: str) -> str:
    return f"CAST(json_extract_string(json, '$.{key}.metrics.{name}.percentile') AS DOUBLE)"


def _either(name: str) -> str:
    return (f"CASE WHEN contains(json, '\"loadingExperience\":{{\"metrics\":{{\"') THEN {_metric(name, 'loadingExperience')} "
            f"ELSE {_metric(name, 'originLoadingExperience')} END")


@query("A12", PSI + f""" SELECT audit_id, strategy, {_either('LARGEST_CONTENTFUL_PAINT_MS')} AS lcp_ms, {_either('CUMULATIVE_LAYOUT_SHIFT_SCORE')} / 100 AS cls, {_either('INTERACTION_TO_NEXT_PAINT')} AS inp_ms,
  {_either('FIRST_CONTENTFUL_PAINT_MS')} AS fcp_ms, CASE WHEN contains(json, '\"loadingExperience\":{{\"metrics\":{{\"') THEN false WHEN contains(json, 'originLoadingExperience') THEN true END AS origin_wide FROM psi_raw""")
def field_values(c):
    return pl.speed_tests(c.derived("psi_raw")).selectExpr(
        "audit_id", "strategy", "field.lcp_ms", "field.cls", "field.inp_ms", "field.fcp_ms",
        "field.origin_wide")


_DAY = "CASE WHEN c_nationkey < 10 THEN concat('0', CAST(c_nationkey AS STRING)) ELSE CAST(c_nationkey AS STRING) END"
_RDAP = (f"concat('{{\"events\":[{{\"eventAction\":\"registration\",\"eventDate\":\"2001-01-01T00:00:00Z\"}}', CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE concat(',{{\"eventAction\":\"expiration\",\"eventDate\":\"', "
         f"CASE WHEN c_mktsegment = 'MACHINERY' THEN 'soon' WHEN c_mktsegment = 'BUILDING' THEN concat('2025-03-', {_DAY}, 'T10:00:00') ELSE concat('2025-03-', {_DAY}, 'T10:00:00+02:00') END, '\"}}') END, ']}}')")


@query("A13", f"""SELECT c_custkey, CASE WHEN c_mktsegment IN ('FURNITURE', 'MACHINERY') OR c_nationkey = 0 THEN NULL ELSE epoch_us(TIMESTAMP '2025-03-01 10:00:00') + (c_nationkey - 1) * 86400000000
  - CASE WHEN c_mktsegment = 'BUILDING' THEN 0 ELSE 7200000000 END END::BIGINT AS expires_us FROM customer""")
def domain_dates(c):
    return c.table("customer").selectExpr("c_custkey", f"{_RDAP} AS json").select(
        "c_custkey", F.unix_micros(pl.rdap_expiry(F.col("json"))).alias("expires_us"))


_DNS = ("concat('{{\"Status\":', CASE c_mktsegment WHEN 'FURNITURE' THEN '3' WHEN 'MACHINERY' THEN '2' ELSE '0' END, ',\"Answer\":[{{\"type\":16,\"data\":\"\\\\\"v=spf1 a', CAST(c_nationkey AS STRING), '\\\\\" \\\\\" -all\\\\\"\"}},"
        "{{\"type\":15,\"data\":\"10 mx.example.org\"}}]}}')").replace("{{", "{").replace("}}", "}")


@query("A14", "SELECT c_custkey, CASE c_mktsegment WHEN 'FURNITURE' THEN '' WHEN 'MACHINERY' THEN NULL ELSE concat('v=spf1 a', c_nationkey, ' -all') END AS txt, CASE c_mktsegment WHEN 'FURNITURE' THEN '' WHEN 'MACHINERY' THEN NULL ELSE '10 mx.example.org' END AS mx FROM customer")
def dns(c):
    rows = c.table("customer").select(
        "c_custkey", F.concat(
            F.lit('{"Status":'),
            F.expr("CASE c_mktsegment WHEN 'FURNITURE' THEN '3' WHEN 'MACHINERY' THEN '2' ELSE '0' END"),
            F.lit(',"Answer":[{"type":16,"data":"\\"v=spf1 a'), F.col("c_nationkey").cast("string"),
            F.lit('\\" \\" -all\\""},{"type":15,"data":"10 mx.example.org"}]}')).alias("json"))
    return rows.select(
        "c_custkey", F.array_join(pl.dns_records(F.col("json"), "TXT"), ",").alias("txt"),
        F.array_join(pl.dns_records(F.col("json"), "MX"), ",").alias("mx"))


@query("A15", "SELECT event_id, concat('a', event_type, 'b ', event_type) AS value, event_type AS plain FROM events")
def txt_values(c):
    quoted = F.concat(F.lit('"a'), "event_type", F.lit('b " "'), "event_type", F.lit('"'))
    return c.table("events").select(
        "event_id", pl.txt_value(quoted).alias("value"),
        pl.txt_value(F.col("event_type")).alias("plain"))


@query("A16", """SELECT c_custkey, c_mktsegment <> 'MACHINERY' AS dns_checked, CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment <> 'FURNITURE' END AS has_mx,
  CASE WHEN c_mktsegment <> 'MACHINERY' THEN CASE WHEN c_acctbal > 0 THEN 'V=SPF1 -all' ELSE '' END END AS spf, CASE WHEN c_mktsegment <> 'MACHINERY' THEN CASE WHEN c_nationkey < 9 THEN 'v=DMARC1; p=none' ELSE '' END END AS dmarc FROM customer""")
def mail_facts(c):
    known = F.col("c_mktsegment") != "MACHINERY"
    mx = F.when(known, F.when(F.col("c_mktsegment") == "FURNITURE", F.array().cast("array<string>"))
                .otherwise(F.array(F.lit("10 mx"))))
    txt = F.when(F.col("c_acctbal") > 0, F.array(F.lit("other"), F.lit("V=SPF1 -all"))).otherwise(
        F.array(F.lit("other")))
    dmarc = F.when(F.col("c_nationkey") < 9, F.array(F.lit("v=DMARC1; p=none"))).otherwise(
        F.array().cast("array<string>"))
    return c.table("customer").select(
        "c_custkey", pl.mail_records(mx, txt, dmarc).alias("m")).select("c_custkey", "m.*")


@query("A17", "SELECT s_suppkey, CASE WHEN s_nationkey = 0 THEN NULL ELSE epoch_us(TIMESTAMP '2025-06-01 12:00:00') + (s_nationkey - 1) * 86400000000 END::BIGINT AS expires_us, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS issuer FROM supplier")
def certificates(c):
    day = F.expr("CASE WHEN s_nationkey < 10 THEN concat(' ', CAST(s_nationkey AS STRING)) ELSE CAST(s_nationkey AS STRING) END")
    json = F.concat(
        F.lit('{"notAfter":"Jun '), day, F.lit(' 12:00:00 2025 GMT","issuer":[[["countryName","US"]]'),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit(',[["organizationName","'), "s_name", F.lit('"]]'))).otherwise(""),
        F.lit("]}"))
    return c.table("supplier").select("s_suppkey", pl.certificate(json).alias("x")).select(
        "s_suppkey", F.unix_micros("x.expires").alias("expires_us"), "x.issuer")


@query("A18", """SELECT event_id, event_type IN ('view', 'click') AS git_exposed, value < 50 AS env_exposed, event_type <> 'error' AS security_txt FROM events""")
def exposed(c):
    git = F.expr("CASE event_type WHEN 'view' THEN concat('ref: refs/heads/main', chr(10)) WHEN 'click' THEN concat(repeat('ab', 20), chr(10)) WHEN 'error' THEN 'nothing' END")
    env = F.expr("CASE WHEN value < 50 THEN concat('APP_KEY=1', chr(10), '# x', chr(10), 'DB_PASSWORD=2') ELSE concat('APP_KEY=1', chr(10), 'Ab=2') END")
    txt = F.expr("CASE WHEN event_type <> 'error' THEN 'Contact: mailto:a@b.example' ELSE '' END")
    return c.table("events").select("event_id", pl.exposed_files(git, env, txt).alias("x")).select(
        "event_id", "x.*")


@query("A19", """SELECT event_id, CASE event_type WHEN 'view' THEN 'Vercel' WHEN 'click' THEN 'Cloudflare' WHEN 'purchase' THEN CASE WHEN value < 100 THEN '' END WHEN 'signup' THEN CASE WHEN value < 50 THEN 'SiteGround' WHEN value < 90 THEN 'Imunify360' END END AS provider FROM events""")
def firewalls(c):
    rows = c.table("events").selectExpr(
        "event_id",
        "CASE WHEN event_type = 'click' THEN map('cf-mitigated', 'Challenge') ELSE CAST(map() AS MAP<STRING, STRING>) END AS headers",
        "CASE WHEN value < 100 THEN 403 ELSE 200 END AS status",
        "CASE event_type WHEN 'view' THEN 'Vercel Security Checkpoint' WHEN 'purchase' THEN CASE WHEN value < 100 THEN 'solve this captcha' ELSE 'our captcha form' END "
        "WHEN 'signup' THEN CASE WHEN value < 50 THEN 'sgcaptcha' WHEN value < 90 THEN 'imunify' ELSE 'hello' END ELSE 'hello' END AS html")
    return rows.select("event_id", pg.checkpoint_provider(
        F.col("status"), F.col("headers"), F.col("html"), fv.SHORT_PAGE).alias("provider"))


@query("A20", "SELECT doc_id AS audit_id, CASE WHEN n_chars < 3000 THEN text ELSE '' END AS llms_txt_text FROM documents")
def llms(c):
    files = c.table("documents").selectExpr(
        "doc_id AS audit_id", "CASE WHEN n_chars < 3000 THEN 200 ELSE 404 END AS status_code",
        "'text/markdown' AS content_type", "text")
    return pl.llms_text(files)


@query("A21")  # nested documents; read back and compared in the tests
def report_documents(c):
    from crawlscore.operators import scoring

    categories = scoring.category_scores(c.results)
    health = scoring.health_scores(categories)
    folder = f"{shared_folder(c.spark)}/reports-{uuid.uuid4().hex}"
    found = audit.findings(c.results)
    fixes = evidence.snippets(found, c.inputs)
    shown = element_evidence.with_shots(found, element_evidence.finding_elements(c.inputs, found), 3)
    sinks.write_reports(sinks.reports(c.results, categories, health, fixes, shown), folder, AS_OF[:10])
    stored = sinks.read_reports(c.spark, folder)
    return stored.selectExpr(
        "audit_id", "health_score", "health_band", "size(categories) AS categories",
        "size(results) AS results", "coalesce(size(snippets), 0) AS snippets", "coalesce(size(elements), 0) AS elements",
        "aggregate(results, 0L, (n, r) -> n + size(r.findings)) AS findings")


@query("A22", dv.with_clause("finding_rows") + """ SELECT audit_id, count(*) AS findings, max(finding_ord) AS newest FROM finding_rows
  WHERE audit_id NOT IN (SELECT audit_id FROM finding_rows WHERE value > 300) OR value > 100 GROUP BY audit_id""")
def replaced_findings(c):
    """First all findings, then a second run that replaces some audits' findings."""
    table = snapshots.FindingsTable(c.spark, f"{shared_folder(c.spark)}/findings-{uuid.uuid4().hex}")
    table.replace(c.derived("finding_rows").drop("ts", "value", "weight"))
    again = c.derived("finding_rows").where("value > 300").select("audit_id").distinct()
    fresh = c.derived("finding_rows").where("value > 100").join(again, "audit_id", "left_semi")
    table.replace(fresh.drop("ts", "value", "weight"))
    return table.read().groupBy("audit_id").agg(
        F.count("*").alias("findings"), F.max("finding_ord").alias("newest"))


@query("A23", dv.with_clause("leads", "checkups") + """ SELECT CASE WHEN l.name LIKE '=%' THEN concat('''', l.name) ELSE l.name END AS name, CASE WHEN l.email LIKE '+%' THEN concat('''', l.email) ELSE l.email END AS email, CASE WHEN consent THEN 'yes' ELSE 'no' END AS consent,
  '2024-01-05T10:00:00' AS created_at, coalesce(string_agg(c.domain, ' ' ORDER BY c.created_at DESC, c.id DESC), '') AS websites, coalesce(CAST(arg_max(coalesce(c.health_score, -1), (c.created_at, c.id)) AS VARCHAR), '') AS latest_health_score
  FROM leads l LEFT JOIN checkups c ON c.lead_id = l.id GROUP BY ALL""".replace("coalesce(CAST(arg_max(coalesce(c.health_score, -1), (c.created_at, c.id)) AS VARCHAR), '')", "coalesce(CAST(nullif(arg_max(coalesce(c.health_score, -1), (c.created_at, c.id)), -1) AS VARCHAR), '')"))
def lead_export(c):
    return sinks.leads_export(c.derived("leads"), c.derived("checkups"))


@query("A23_sites", dv.with_clause("leads", "checkups") + """ SELECT l.id AS lead_id, CASE WHEN l.name LIKE '=%' THEN concat('''', l.name) ELSE l.name END AS name,
  row_number() OVER (PARTITION BY l.id ORDER BY c.created_at DESC, c.id DESC) AS rank, c.domain AS website,
  CAST(first_value(c.health_score) OVER (PARTITION BY l.id ORDER BY c.created_at DESC, c.id DESC) AS VARCHAR) AS latest_health_score
  FROM leads l JOIN checkups c ON c.lead_id = l.id""")
def lead_sites(c):
    """The export as ranked rows, one per lead and audited website."""
    rows = sinks.lead_sites(c.derived("leads"), c.derived("checkups"))
    return rows.where("rank IS NOT NULL").select("lead_id", "name", "rank", "website", F.nullif("latest_health_score", F.lit("")).alias("latest_health_score"))


@query("A24", """SELECT event_id, CAST(floor(value) AS INT) AS health_score FROM events WHERE event_type NOT IN ('error', 'click')""")
def documents_read_back(c):
    raw = c.table("events").selectExpr(
        "CASE event_type WHEN 'error' THEN concat('{\"audit_id\":\"', event_id, '\",') "
        "WHEN 'click' THEN '{\"health_score\": 3}' "
        "ELSE concat('{\"audit_id\":\"', event_id, '\",\"health_score\":', CAST(floor(value) AS INT), '}') END AS doc")
    return sinks.parse_reports(raw, "doc").selectExpr(
        "CAST(audit_id AS BIGINT) AS event_id", "health_score")
