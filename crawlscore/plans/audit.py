"""The audit: documents and side data in, results, findings and scores out.

One aggregation per site carries all page measures of all selected checks (one shuffle of a
few numbers per site and task). Side tables come down to one row per site and join on the
same key. All rules are then evaluated on that one row, so scoring a site needs no further
look at its pages.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.operators.checks.features import FEATURES, WORD, layered
from crawlscore.operators.checks.spec import Check
from crawlscore.plans import side_tables as st
from crawlscore.plans.catalog import catalogue
from crawlscore.session import materialise

AGGREGATE = re.compile(r"^(count_if|sum)\((.*)\)$", re.S)
HOME = re.compile(r"\bhome\.(?!dom_)(\w+)")
HOME_DOM = re.compile(r"\bhome\.dom_(\w+)")
DOM = re.compile(r"\bdom_(\w+)")
CAPABILITY_TABLES = {
    "probes": "site_probe", "render": "renders", "pagespeed": "speed_tests",
    "security": "security_facts",
}
SKIP_NOTES = {
    "probes": "The extra requests were not made.",
    "render": "The browser visit was not made.",
    "pagespeed": "No speed test was made.",
    "security": "Security facts were not looked up.",
}
NOT_APPLICABLE = fv.NOTE_NOT_APPLICABLE
FAILED = fv.NOTE_FAILED


@dataclass
class AuditInputs:
    """Tables of an audit run; only `docs` (from `page_docs`) is a must.

    `extra` holds tables of one's own collectors, one row per audit: name -> table.
    """

    docs: DataFrame
    render_docs: DataFrame | None = None
    renders: DataFrame | None = None
    robots_files: DataFrame | None = None
    sitemaps: DataFrame | None = None
    site_probe: DataFrame | None = None
    agent_probe: DataFrame | None = None
    url_status: DataFrame | None = None
    cookies: DataFrame | None = None
    device_views: DataFrame | None = None
    axe_rules: DataFrame | None = None
    speed_tests: DataFrame | None = None
    security_facts: DataFrame | None = None
    capabilities: DataFrame | None = None  # audit_id, capability, available, reason
    as_of: str = "2026-01-01 00:00:00"
    extra: dict[str, DataFrame] = field(default_factory=dict)


def _all_sql(check: Check) -> str:
    rule_parts = [
        p for r in check.rules for p in (r.when, r.severity, r.impact, r.effort, r.affected, r.message)
    ]
    return " ".join([
        *check.facts.values(), *rule_parts, check.na, check.partial, check.passed,
        check.pass_when or "", check.findings or "",
    ])


def site_facts(inputs: AuditInputs, checks: list[Check], stage: bool = False) -> DataFrame:
    """One row per audit with every measure the given checks need."""
    features = dict(FEATURES)
    for check in checks:
        features.update(check.features)
    text = " ".join(_all_sql(check) for check in checks)
    facts = {name: sql for check in checks for name, sql in check.facts.items()}
    counted = {n: AGGREGATE.match(s) for n, s in facts.items() if AGGREGATE.match(s)}
    derived = {n: s for n, s in facts.items() if n not in counted}
    tables = sorted({t for check in checks for t in check.tables})

    seen_facts = {n for n, m in counted.items() if DOM.search(m.group(2))}
    home_names = set(HOME.findall(text)) | set(HOME_DOM.findall(text))
    seen_names = set(HOME_DOM.findall(text))
    if "h1_groups" in tables:
        home_names |= {"h1s", "empty_heading", "h1_not_first"}
        seen_names |= {"h1s", "empty_heading", "h1_not_first"}
    bodies = {n: DOM.sub(r"\1", m.group(2)) for n, m in counted.items()}
    shares = {
        f"share_{n}": f"if({bodies[n]}, 1, 0)" if counted[n].group(1) == "count_if" else bodies[n]
        for n in seen_facts
    }
    wanted = {w for body in bodies.values() for w in WORD.findall(body)} | home_names

    pages = layered(inputs.docs, features, wanted)
    home_fields = sorted(home_names)
    home = [f"{n}" for n in home_fields] + [f"{sql} AS {n}" for n, sql in sorted(shares.items())]
    site = pages.groupBy("audit_id").agg(
        F.count("*").alias("pages"),
        F.min("page_key").alias("home_key"),
        F.expr(f"min_by(struct({', '.join(['final_url AS url', *home])}), page_key)").alias("home"),
        *[F.expr(f"{m.group(1)}({bodies[n]})").alias(n) for n, m in counted.items()],
    ).withColumn("home_url", F.col("home.url"))
    if stage:
        # one row per site, read again by the side tables that need the homepage
        site = materialise(site, "page-facts")

    dom_fields = sorted(seen_names) + sorted(shares)
    if dom_fields and inputs.render_docs is not None:
        seen_wanted = seen_names | {w for s in shares.values() for w in WORD.findall(s)}
        rendered = layered(inputs.render_docs, features, seen_wanted)
        seen = [*sorted(seen_names), *[f"{s} AS {n}" for n, s in sorted(shares.items())]]
        rendered = rendered.selectExpr("audit_id", f"struct({', '.join(seen)}) AS seen").groupBy("audit_id").agg(
            F.max_by("seen", F.to_json("seen")).alias("seen"))
        site = site.join(rendered, "audit_id", "left")
        picks = [f"if(seen IS NULL, home.{n}, seen.{n}) AS {n}" for n in dom_fields]
        site = site.withColumn("rendered", F.col("seen").isNotNull())
    else:
        picks = [f"home.{n} AS {n}" for n in dom_fields]
        site = site.withColumn("rendered", F.lit(False))
    if picks:
        site = site.withColumn("dom", F.expr(f"struct({', '.join(picks)})")).drop("seen")
    site = site.withColumns({
        n: F.expr(f"{n} - home.share_{n} + dom.share_{n}") for n in sorted(seen_facts)
    }) if seen_facts else site

    for name in tables:
        side = _side_table(inputs, name, site, features)
        if side is None:
            schema = _EMPTY_TABLES.get(name, "")
            site = site.withColumn(name, F.lit(None).cast(f"struct<{schema}>"))
            continue
        fields = [c for c in side.columns if c != "audit_id"]
        # several rows for a site: the largest counts, whatever their order
        side = side.groupBy("audit_id").agg(F.max(F.struct(*fields)).alias(name))
        site = site.join(side, "audit_id", "left")
    site = site.withColumn("as_of_year", F.year(F.lit(inputs.as_of).cast("timestamp")))
    rewritten = {n: HOME_DOM.sub(r"dom.\1", s) for n, s in derived.items()}
    return layered(site, rewritten, set(rewritten))


_EMPTY_TABLES = {
    "robots": "robots_url:string,robots_exists:boolean,robots_sitemaps:array<string>,robots_groups:"
              "array<struct<agents:array<string>,rules:array<struct<allow:boolean,path:string>>>>",
    "sitemaps": "sitemap_found:boolean,sitemap_urls:bigint",
    "site_probe": "http_final_url:string,llms_txt_text:string,og_image_url:string,"
                  "og_image_status:int,og_image_type:string,og_image_too_big:boolean",
    "agents": "ai:struct<status_code:int,text_length:int,challenge:boolean>,"
              "browser:struct<status_code:int,text_length:int,challenge:boolean>",
    "link_status": "internal_total:bigint,internal_broken:bigint,external_verified:bigint,"
                   "external_broken:bigint,image_total:bigint,image_broken:bigint",
    "render": "text_length:int,error_count:int,error_examples:string,outdated_libraries:int",
    "cookies": "third_party_domains:bigint",
    "device_views": "mobile:struct<width:int,layout_width:int,scroll_width:int,tap_targets:int,"
                    "small_tap_targets:int,text_chars:int,small_text_chars:int,"
                    "first_screen_links:array<string>>,tablet:struct<width:int,layout_width:int,"
                    "scroll_width:int,tap_targets:int,small_tap_targets:int,text_chars:int,"
                    "small_text_chars:int,first_screen_links:array<string>>",
    "axe": "axe_rules:bigint,axe_penalty:double,axe_found:array<struct<rank:int,id:string,"
           "impact:string,nodes:int>>",
    "speed": "mobile:struct<{t}>,desktop:struct<{t}>".replace(
        "{t}", "score:double,lcp_ms:double,cls:double,tbt_ms:double,fcp_ms:double,"
               "speed_index_ms:double,total_bytes:bigint,render_blocking:array<string>,"
               "render_blocking_savings_ms:double,offscreen_images:array<string>,"
               "unsized_images:array<string>,field:struct<lcp_ms:double,cls:double,inp_ms:double,"
               "fcp_ms:double,origin_wide:boolean>"),
    "security": "domain:string,cert_error:string,cert_expires:timestamp,domain_expires:timestamp,"
                "cert_days:int,domain_days:int,has_mx:boolean,dns_checked:boolean,"
                "spf:string,dmarc:string,files_checked:boolean,git_exposed:boolean,"
                "env_exposed:boolean,security_txt:boolean",
    "h1_groups": "h1_shared_only:bigint,h1_first_key:struct<depth:bigint,length:bigint,id:bigint>,"
                 "h1_home_shared:boolean",
    "title_groups": "titles_shared:bigint",
    "address_quality": "addresses:bigint,addresses_bad:bigint,addresses_noted:bigint",
}


def _side_table(
    inputs: AuditInputs, name: str, site: DataFrame, features: dict[str, str]
) -> DataFrame | None:
    if name in inputs.extra:
        return inputs.extra[name]
    plain = {
        "robots": (inputs.robots_files, st.robots_table),
        "sitemaps": (inputs.sitemaps, lambda t: t),
        "site_probe": (inputs.site_probe, lambda t: t),
        "agents": (inputs.agent_probe, st.agents_table),
        "link_status": (inputs.url_status, st.link_status_table),
        "render": (inputs.renders, st.render_table),
        "cookies": (inputs.cookies, st.cookies_table),
        "device_views": (inputs.device_views, st.device_table),
        "axe": (inputs.axe_rules, st.axe_table),
        "speed": (inputs.speed_tests, st.speed_table),
        "security": (inputs.security_facts, lambda t: st.security_table(t, inputs.as_of)),
    }
    if name in plain:
        table, build = plain[name]
        return None if table is None else build(table)
    if name == "title_groups":
        return st.title_groups(inputs.docs)
    if name == "address_quality":
        return st.address_quality(inputs.docs, site)
    if name == "h1_groups":
        pages = layered(inputs.docs, features, {"h1s", "empty_heading", "h1_not_first"})
        pages = pages.selectExpr(
            "audit_id", "page_key", "h1s", "empty_heading OR h1_not_first AS faulty")
        homes = site.where("rendered").selectExpr(
            "audit_id", "home_key AS page_key", "home.h1s AS raw_h1s",
            "home.empty_heading OR home.h1_not_first AS raw_faulty", "dom.h1s AS seen_h1s",
            "dom.empty_heading OR dom.h1_not_first AS seen_faulty",
        )
        return st.h1_groups(pages, homes)
    raise ValueError(f"no side table {name}")


def capabilities(inputs: AuditInputs) -> DataFrame:
    """Which capabilities each audit has, with the reason for each one it lacks."""
    if inputs.capabilities is not None:
        listed = inputs.capabilities
    else:
        present = [
            table.selectExpr("audit_id", f"'{name}' AS capability", "true AS available",
                             "CAST(NULL AS STRING) AS reason").distinct()
            for name, attribute in CAPABILITY_TABLES.items()
            if (table := getattr(inputs, attribute)) is not None
        ]
        if not present:
            return inputs.docs.selectExpr(
                "audit_id", "array('') AS caps", "map('', '') AS reasons").limit(0)
        listed = reduce(DataFrame.unionByName, present)
    unique = listed.groupBy("audit_id", "capability").agg(
        F.bool_or("available").alias("available"), F.max("reason").alias("reason"))
    return unique.groupBy("audit_id").agg(
        F.collect_set(F.when(F.col("available"), F.col("capability"))).alias("caps"),
        F.map_from_entries(F.collect_list(F.when(
            F.col("reason").isNotNull(), F.struct("capability", "reason")))).alias("reasons"),
    )


def _usable(site: DataFrame, check: Check) -> bool:
    """Does the check's SQL fit the data? A faulty check must not stop the others."""
    try:
        site.selectExpr(check.findings_sql(), f"({check.na})", f"({check.partial})").schema
        return True
    except PySparkException:
        return False


def _resolved(sql: str) -> str:
    return HOME_DOM.sub(r"dom.\1", sql)


def _result_struct(check: Check, order: int, usable: bool) -> str:
    head = (
        f"'check_id', '{check.check_id}', 'category', '{check.category}', "
        f"'title', \"{check.title}\", 'weight', {check.weight}, 'check_ord', {order}"
    )
    finding_type = (
        "ARRAY<STRUCT<finding_ord:INT,code:STRING,severity:STRING,impact:STRING,effort:STRING,"
        "affected:BIGINT,message:STRING>>"
    )
    if not usable:
        return (
            f"named_struct({head}, 'status', 'error', 'note', '{FAILED}', "
            f"'partial', CAST(NULL AS DOUBLE), 'findings', CAST(array() AS {finding_type}))"
        )
    requires = ", ".join(f"'{r}'" for r in sorted(check.requires))
    lacking = f"array_sort(array_except(CAST(array({requires}) AS ARRAY<STRING>), caps))"
    notes = ", ".join(f"'{k}', '{v}'" for k, v in SKIP_NOTES.items())
    note = (
        f"coalesce(try_element_at(reasons, get({lacking}, 0)), "
        f"try_element_at(map({notes}), get({lacking}, 0)), 'Not checked.')"
    )
    gate = f"size({lacking}) > 0" if check.requires else "false"
    note = note if check.requires else "''"
    na, partial = _resolved(f"coalesce({check.na}, false)"), _resolved(check.partial)
    findings = _resolved(check.findings_sql())
    return (
        f"named_struct({head}, 'status', CASE WHEN {gate} OR {na} THEN 'skipped' ELSE 'ran' END, "
        f"'note', CASE WHEN {gate} THEN {note} WHEN {na} THEN '{NOT_APPLICABLE}' ELSE '' END, "
        f"'partial', CASE WHEN {gate} OR {na} THEN NULL ELSE CAST({partial} AS DOUBLE) END, "
        f"'findings', CAST(CASE WHEN {gate} OR {na} THEN array() ELSE {findings} END AS "
        f"{finding_type}))"
    )


SEVERITY_SCORE = "CASE {} WHEN 'fail' THEN 0.0D WHEN 'warn' THEN 0.5D ELSE 1.0D END"


def check_results(inputs: AuditInputs, only: list[str] | None = None, stage: bool = False) -> DataFrame:
    """One row per audit and check: status, score, note and the findings.

    Rows exist for every check, also for those that did not run. With `stage` the rows per site are
    written between the steps, which pays when many checks run.
    """
    every = catalogue()
    checks = [c for i, c in every.items() if only is None or i in only]
    order = {check_id: i for i, check_id in enumerate(every)}
    sound = [c for c in checks if _facts_usable(inputs, c)]
    site = site_facts(inputs, sound, stage)
    if stage:
        # one short row per site: written, so that the long list of rules is planned over a
        # plain scan and adaptive execution does not optimise it again after every stage
        site = materialise(site, "site-facts")
    if any(c.requires for c in checks):
        site = site.join(capabilities(inputs), "audit_id", "left")
        site = site.withColumns({
            "caps": F.coalesce("caps", F.array().cast("array<string>")),
            "reasons": F.coalesce("reasons", F.create_map().cast("map<string,string>")),
        })
    custom = {c.check_id for c in checks} - {c.check_id for c in _built_in()}
    usable = {
        c.check_id: c in sound and (c.check_id not in custom or _usable(site, c)) for c in checks
    }
    structs = [_result_struct(c, order[c.check_id], usable[c.check_id]) for c in checks]
    rows = site.selectExpr("audit_id", f"inline(array({', '.join(structs)}))")
    worst = F.array_min(F.expr(
        f"transform(findings, f -> {SEVERITY_SCORE.format('f.severity')})"))
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("partial", worst, F.lit(1.0))))
    return rows.select(
        "audit_id", "check_id", "category", "title", "weight", "check_ord", "status",
        F.when(F.col("status") == "ran", score).alias("score"), "note",
        F.expr("exists(findings, f -> f.severity = 'fail' AND f.impact = 'high')")
        .alias("high_impact_fail"), "findings",
    )


def _built_in() -> list[Check]:
    from crawlscore.plans.catalog import BUILT_IN

    return BUILT_IN


def _facts_usable(inputs: AuditInputs, check: Check) -> bool:
    """Registered checks are analysed alone first; built-in ones are known to be sound."""
    if check in _built_in():
        return True
    try:
        site_facts(inputs, [check]).schema
        return True
    except (PySparkException, ValueError):
        return False


def findings(results: DataFrame) -> DataFrame:
    """One row per finding, in report order within its audit."""
    why = {c.check_id: c for c in catalogue().values()}
    spark = results.sparkSession
    advice = spark.createDataFrame(
        [(i, c.why, c.fix) for i, c in why.items()],
        "check_id string, why_it_matters string, how_to_fix string",
    )
    rows = results.where("status = 'ran'").selectExpr(
        "audit_id", "check_id", "category", "title", "check_ord", "inline(findings)")
    return rows.join(F.broadcast(advice), "check_id").select(
        "audit_id", "check_id", "category", "title", "check_ord", "finding_ord", "code",
        "severity", "impact", "effort", "affected", "message", "why_it_matters", "how_to_fix",
    )


def finding_pages(inputs: AuditInputs, results: DataFrame, only: list[str] | None = None) -> DataFrame:
    """The pages each finding is about, one row per page and finding.

    The pages stay rows: no list is built per site, so a huge site stays spread out.
    """
    checks = [c for i, c in catalogue().items() if only is None or i in only]
    features = dict(FEATURES)
    for check in checks:
        features.update(check.features)
    flagged = [
        (c.check_id, r.code, DOM.sub(r"\1", r.pages).replace("is_home", "{home}"),
         bool(DOM.search(r.pages)))
        for c in checks for r in c.rules if r.pages
    ]

    def candidates(df: DataFrame, home: str, seen_only: bool) -> DataFrame:
        entries = [
            f"CASE WHEN {sql.format(home=home)} THEN named_struct('check_id', '{i}', 'code', "
            f"'{code}', 'seen', {str(seen).lower()}) END"
            for i, code, sql, seen in flagged if seen or not seen_only
        ]
        wanted = {w for _, _, sql, _ in flagged for w in WORD.findall(sql)}
        wide = layered(df, features, wanted)
        return wide.selectExpr(
            "audit_id", "page_key", "final_url AS url",
            f"inline(array_compact(array({', '.join(entries)})))")

    homes = inputs.docs.groupBy("audit_id").agg(F.min("page_key").alias("home_key"))
    reported = findings(results).select("audit_id", "check_id", "code").distinct()
    reported = reported.join(homes, "audit_id")
    crawled = candidates(inputs.docs, "false", False)
    if inputs.render_docs is not None:
        rendered = candidates(
            inputs.render_docs.join(homes, "audit_id").withColumnRenamed("home_key", "page_key"),
            "true", True)
        with_render = inputs.render_docs.select("audit_id", F.lit(True).alias("rendered")).distinct()
        reported = reported.join(with_render, "audit_id", "left")
        crawled = crawled.join(reported, ["audit_id", "check_id", "code"]).where(
            "NOT (seen AND coalesce(rendered, false) AND page_key = home_key)")
        rendered = rendered.join(
            reported.drop("home_key", "rendered"), ["audit_id", "check_id", "code"])
        keep = ["audit_id", "check_id", "code", "page_key", "url"]
        return crawled.select(*keep).unionByName(rendered.select(*keep))
    return crawled.join(reported, ["audit_id", "check_id", "code"]).select(
        "audit_id", "check_id", "code", "page_key", "url")
