"""Scoring and report operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.operators import scoring as sc
from crawlscore.operators import treatment as tr
from crawlscore.plans import audit as au
from crawlscore.plans.catalog import catalogue
from crawlscore.sources import derived as dv
from crawlscore.suite.corpus import corpus, query
from crawlscore.suite.oracle_pages import page_cte

FINDINGS = dv.with_clause("finding_rows")
RESULTS = dv.with_clause("result_rows")
SEV = "CASE severity WHEN 'fail' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END"
IMP = "CASE impact WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
EFF = "CASE effort WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END"
WEIGHT = "CASE category WHEN 'performance' THEN 25 WHEN 'seo' THEN 25 WHEN 'best_practices' THEN 20 ELSE 15 END"
SCORE = "CASE severity WHEN 'fail' THEN 0.0 WHEN 'warn' THEN 0.5 ELSE 1.0 END"
QUICK = "(impact IN ('high', 'medium') AND effort = 'low')"
CATS = ", ".join(f"('{c}', {i})" for i, c in enumerate(fv.CATEGORIES))
CATEGORY_SCORES = RESULTS + f""",
per AS (SELECT audit_id, category, sum(weight * score) FILTER (WHERE status = 'ran' AND score IS NOT NULL) AS w, sum(weight) FILTER (WHERE status = 'ran' AND score IS NOT NULL) AS t, count(*) FILTER (WHERE status = 'ran' AND score IS NOT NULL) AS r,
  count(*) FILTER (WHERE status <> 'ran') AS k, coalesce(bool_or(high_impact_fail) FILTER (WHERE status = 'ran' AND score IS NOT NULL), false) AS h, arg_min(note, check_ord) FILTER (WHERE status <> 'ran' AND note <> '') AS n FROM result_rows GROUP BY 1, 2),
cs AS (SELECT a.audit_id, c.category, c.ord, CASE WHEN h THEN least(89, CAST(floor(100 * w / t + 0.5) AS INT)) ELSE CAST(floor(100 * w / t + 0.5) AS INT) END AS score, coalesce(r, 0) AS checks_run, coalesce(k, 0) AS checks_skipped,
  CASE WHEN r > 0 THEN '' ELSE coalesce(n, 'Not checked.') END AS note FROM (SELECT DISTINCT audit_id FROM result_rows) a CROSS JOIN (VALUES {CATS}) AS c(category, ord) LEFT JOIN per p ON p.audit_id = a.audit_id AND p.category = c.category)"""


def category_scores_sql(found: str, check_ids: list[str]) -> str:
    """Category scores of the rows (audit_id, check_id, status, score, severity, impact) of a statement."""
    weights = ", ".join(f"('{i}', {catalogue()[i].weight})" for i in check_ids)
    rows = f"""WITH result_rows AS (
  SELECT audit_id, f.check_id, split_part(f.check_id, '.', 1) AS category, 1 AS check_ord, any_value(weight) AS weight, any_value(status) AS status,
    min(score) AS score, '' AS note, coalesce(bool_or(severity = 'fail' AND impact = 'high'), false) AS high_impact_fail
  FROM ({found}) AS f JOIN (VALUES {weights}) AS w(check_id, weight) ON w.check_id = f.check_id GROUP BY 1, 2)"""
    return CATEGORY_SCORES.replace(RESULTS, rows, 1) + " SELECT audit_id, category, score, checks_run, checks_skipped FROM cs"


HEALTH = CATEGORY_SCORES + f", health AS (SELECT audit_id, CAST(floor(sum({WEIGHT} * score) / sum(CASE WHEN score IS NOT NULL THEN {WEIGHT} END)::DOUBLE + 0.5) AS INT) AS health_score FROM cs GROUP BY audit_id)"
BAND = "CASE WHEN {s} < 50 THEN 'urgent' WHEN {s} < 90 THEN 'attention' WHEN {s} IS NOT NULL THEN 'healthy' END"


def site_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health and category scores of every site, from its pages and side data."""
    categories = sc.category_scores(corpus(spark, sf_dir).results)
    return sc.health_scores(categories).join(sc.wide_scores(categories), "audit_id")


# one or two checks per category that read nothing but pages
PAGE_ONLY = [
    "seo.title", "seo.meta_description", "best_practices.https", "best_practices.doctype",
    "accessibility.html_lang", "accessibility.image_alt", "performance.image_dimensions",
    "agentic.landmarks",
]


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Health and category scores of every site, from checks that need its pages alone."""
    tables = corpus(spark, sf_dir)
    results = au.check_results(au.AuditInputs(docs=tables.docs), PAGE_ONLY, stage=True)
    categories = sc.category_scores(results)
    return sc.health_scores(categories).join(sc.wide_scores(categories), "audit_id")


def _findings(c):
    return c.derived("finding_rows")


def _categories(c):
    return sc.category_scores(c.derived("result_rows"))


@query("G1", FINDINGS + f" SELECT audit_id, check_id, min({SCORE})::DOUBLE AS score FROM finding_rows GROUP BY 1, 2")
def worst(c):
    return sc.worst_scores(_findings(c))


@query("G2", FINDINGS + f" SELECT audit_id, check_id, greatest(0, least(1, CASE WHEN min(value) < 20 THEN min(value) / 10 - 0.5 ELSE min({SCORE}) END))::DOUBLE AS score FROM finding_rows GROUP BY 1, 2")
def final(c):
    rows = _findings(c).groupBy("audit_id", "check_id").agg(
        F.min("value").alias("v"), F.min(sc.severity_score()).alias("worst"))
    partial = F.when(F.col("v") < 20, F.col("v") / 10 - 0.5)
    return rows.select("audit_id", "check_id", sc.final_score(partial, F.col("worst")).alias("score"))


@query("G3")  # the statuses of all 69 checks; each check is compared on its own as E1-E69
def statuses(c):
    return c.results.groupBy("check_id", "status").agg(F.count("*").alias("audits"))


@query("G4", CATEGORY_SCORES + " SELECT audit_id, category, score, checks_run, checks_skipped, note FROM cs")
def categories(c):
    return _categories(c).select(
        "audit_id", "category", "score", "checks_run", "checks_skipped", "note")


@query("G5", FINDINGS + " SELECT audit_id, category, bool_or(severity = 'fail' AND impact = 'high') AS capped FROM finding_rows GROUP BY 1, 2")
def capped(c):
    return sc.high_impact_fails(_findings(c))


@query("G6", CATEGORY_SCORES + " SELECT audit_id, string_agg(category, ',' ORDER BY ord) AS categories FROM cs GROUP BY 1")
def five(c):
    rows = _categories(c).groupBy("audit_id").agg(
        F.array_sort(F.collect_list(F.struct("category_ord", "category"))).alias("x"))
    return rows.selectExpr("audit_id", "array_join(transform(x, y -> y.category), ',') AS categories")


@query("G7", HEALTH + f" SELECT audit_id, health_score, {BAND.format(s='health_score')} AS health_band FROM health")
def health(c):
    return sc.health_scores(_categories(c))


@query("G8", CATEGORY_SCORES + " SELECT audit_id, " + ", ".join(f"max(score) FILTER (WHERE category = '{x}') AS {x}" for x in fv.CATEGORIES) + " FROM cs GROUP BY 1")
def wide(c):
    return sc.wide_scores(_categories(c))


@query("G9", page_cte() + " SELECT audit_id, 69::BIGINT AS checks, 69::BIGINT AS different, 345::BIGINT AS weight FROM sites".replace(
    "345", str(sum(c.weight for c in catalogue().values()))))
def checklist(c):
    return c.results.groupBy("audit_id").agg(
        F.count("*").alias("checks"), F.countDistinct("check_id").alias("different"),
        F.sum("weight").alias("weight"))


PROBLEM = "severity IN ('fail', 'warn')"


@query("H1", FINDINGS + f" SELECT finding_ord, severity FROM finding_rows WHERE {PROBLEM}")
def problems(c):
    return tr.problems(_findings(c)).select("finding_ord", "severity")


@query("H2", FINDINGS + f" SELECT finding_ord, {QUICK} AS quick_win FROM finding_rows")
def quick(c):
    return _findings(c).select("finding_ord", tr.quick_win().alias("quick_win"))


PLAN = f", plan AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY CASE WHEN {QUICK} THEN 0 ELSE 1 END, {IMP}, {EFF}, {SEV}, check_ord, finding_ord) AS plan_ord FROM finding_rows WHERE {PROBLEM})"


@query("H3", FINDINGS + PLAN + f" SELECT audit_id, finding_ord, {QUICK} AS quick_win, plan_ord FROM plan")
def plan(c):
    return tr.treatment_plan(_findings(c)).select(
        "audit_id", "finding_ord", "quick_win", F.col("plan_ord").cast("bigint").alias("plan_ord"))


RISK = f", risk AS (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY {IMP}, {SEV}, -{WEIGHT}, check_ord, finding_ord) AS risk_ord FROM finding_rows WHERE {PROBLEM})"


@query("H4", FINDINGS + RISK + " SELECT audit_id, finding_ord, risk_ord FROM risk WHERE risk_ord <= 3")
def risks(c):
    return tr.top_risks(_findings(c)).select(
        "audit_id", "finding_ord", F.col("risk_ord").cast("bigint").alias("risk_ord"))


@query("H5", CATEGORY_SCORES + f""", f AS (SELECT audit_id, category, string_agg(concat(check_id, '/', code), ',' ORDER BY {SEV}, {IMP}, check_ord, finding_ord) FILTER (WHERE {PROBLEM}) AS p, count(*) FILTER (WHERE {PROBLEM}) AS k,
  count(*) FILTER (WHERE severity = 'info') AS notes, count(*) FILTER (WHERE severity = 'pass') AS healthy, count(*) FILTER (WHERE severity = 'fail') AS s FROM finding_rows GROUP BY 1, 2)
SELECT cs.audit_id, cs.category, coalesce(p, '') AS problems, coalesce(notes, 0) AS notes, coalesce(healthy, 0) AS healthy, CASE WHEN score IS NULL THEN 'Not checked this time.' WHEN coalesce(k, 0) = 0 THEN 'Healthy: nothing to fix here.' WHEN s > 0 THEN
  concat(CASE WHEN k = 1 THEN '1 issue' ELSE concat(k, ' issues') END, ' found; ', CASE WHEN s = 1 THEN '1 needs' ELSE concat(s, ' need') END, ' treatment.') ELSE concat(CASE WHEN k = 1 THEN '1 issue' ELSE concat(k, ' issues') END, ' worth fixing.') END AS headline
FROM cs LEFT JOIN f USING (audit_id, category)""")
def signs(c):
    rows = tr.vital_signs(_findings(c), _categories(c))
    return rows.select(
        "audit_id", "category", F.array_join("problems", ",").alias("problems"),
        F.size("notes").cast("bigint").alias("notes"),
        F.size("healthy").cast("bigint").alias("healthy"), "headline")


@query("H5_rows", FINDINGS + f""" SELECT audit_id, category, kind, row_number() OVER (PARTITION BY audit_id, category, kind
  ORDER BY CASE WHEN kind = 'problem' THEN {SEV} * 10 + {IMP} END, check_ord, finding_ord) AS rank, concat(check_id, '/', code) AS name FROM (
  SELECT *, CASE severity WHEN 'info' THEN 'note' WHEN 'pass' THEN 'healthy' ELSE 'problem' END AS kind FROM finding_rows) AS x""")
def sign_rows(c):
    return tr.vital_sign_rows(_findings(c))


@query("H6", FINDINGS + PLAN + f""", issues AS (SELECT audit_id, check_id, finding_ord, {QUICK} AS quick_win, CASE WHEN {QUICK} THEN 0 ELSE 1 END AS part, plan_ord AS place FROM plan
  UNION ALL SELECT audit_id, check_id, finding_ord, false, 2, row_number() OVER (PARTITION BY audit_id ORDER BY check_ord, finding_ord) FROM finding_rows WHERE severity = 'info')
SELECT audit_id, row_number() OVER (PARTITION BY audit_id ORDER BY part, place) AS issue_ord, concat(replace(replace(check_id, '.', '-'), '_', '-'), '-', row_number() OVER (PARTITION BY audit_id, check_id ORDER BY part, place)) AS key, quick_win FROM issues""")
def issues(c):
    return tr.issue_rows(_findings(c)).select(
        "audit_id", F.col("issue_ord").cast("bigint").alias("issue_ord"), "key", "quick_win")


@query("H7", FINDINGS + " SELECT category, severity, count(*) AS issues FROM finding_rows WHERE severity <> 'pass' GROUP BY ROLLUP (category, severity)")
def totals(c):
    return tr.issue_totals(_findings(c))


@query("H8", HEALTH + f""", k AS (SELECT audit_id, count(*) FILTER (WHERE severity = 'fail') AS f, count(*) FILTER (WHERE {PROBLEM}) AS t FROM finding_rows GROUP BY 1)
SELECT audit_id, CASE WHEN health_score >= 90 AND coalesce(t, 0) = 0 THEN 'Your website is in excellent health.' WHEN health_score >= 90 THEN 'Your website is in good health, with a few things worth polishing.'
  WHEN health_score < 50 THEN concat('Your website needs urgent care: ', CASE WHEN f = 1 THEN '1 serious problem is' ELSE concat(coalesce(f, 0), ' serious problems are') END, ' likely costing you customers.')
  WHEN f > 0 THEN concat('Your website works, but ', CASE WHEN f = 1 THEN '1 serious problem is' ELSE concat(f, ' serious problems are') END, ' holding your business back.')
  ELSE concat('Your website works, but ', coalesce(t, 0), ' issues are holding your business back.') END AS verdict FROM health LEFT JOIN k USING (audit_id)""")
def verdicts(c):
    return tr.verdicts(tr.counters(_findings(c)), sc.health_scores(_categories(c))).select(
        "audit_id", "verdict")


_SPECIFIC = {"performance": 0, "seo": 1, "accessibility": 2, "best_practices": 3, "agentic": 4}
_SERVICE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{fv.SERVICES[i][0]}'" for k, i in _SPECIFIC.items()) + " END"


@query("H9", CATEGORY_SCORES + f""", need AS (SELECT audit_id, category, score, {_SERVICE} AS service FROM cs WHERE score < 90)
  SELECT * FROM need UNION ALL SELECT audit_id, NULL, NULL, 'Full rebuild' FROM need GROUP BY audit_id HAVING count(*) >= 3""")
def services(c):
    return tr.recommendations(_categories(c))


@query("H10", FINDINGS + f""", m AS (SELECT audit_id, CASE effort WHEN 'low' THEN 20 WHEN 'medium' THEN 150 ELSE 960 END AS m FROM finding_rows WHERE {PROBLEM})
  SELECT audit_id, sum(m)::INT AS total_minutes, count(*) FILTER (WHERE m < 60) AS diy_count, coalesce(sum(m) FILTER (WHERE m >= 60), 0)::INT AS developer_minutes FROM m GROUP BY 1""")
def fix_times(c):
    return tr.fix_summary(_findings(c)).select(
        "audit_id", "total_minutes", "diy_count", "developer_minutes")


@query("H11", FINDINGS + f""" SELECT audit_id, finding_ord, pick FROM (SELECT *, row_number() OVER (PARTITION BY audit_id ORDER BY {SEV}, check_ord, finding_ord) AS pick FROM finding_rows WHERE severity <> 'pass') AS x""")
def evidence(c):
    return tr.evidence(_findings(c).withColumn("shot_ord", F.lit(0))).select(
        "audit_id", "finding_ord", F.col("pick").cast("bigint").alias("pick"))


@query("H12", page_cte("robots_files") + """ SELECT audit_id, CASE WHEN s4 >= 13 THEN 'The browser visit failed.|' ELSE '' END || concat('robots.txt keeps robots off ', n, ' page(s), which were left out.') AS notes FROM sites JOIN (SELECT audit_id, count(*) AS n FROM op GROUP BY 1) AS x USING (audit_id)""")
def notes(c):
    failed = c.derived("sites").selectExpr(
        "audit_id", "'render' AS capability", "s4 < 13 AS available",
        "'The browser visit failed.' AS reason")
    return tr.runner_notes(c.docs.select("audit_id", "final_url"), failed).select(
        "audit_id", F.array_join("notes", "|").alias("notes"))


@query("H13", FINDINGS + RISK + " SELECT audit_id, string_agg(message, '|' ORDER BY risk_ord) AS messages FROM risk WHERE risk_ord <= 3 GROUP BY 1")
def digests(c):
    return tr.digest(_findings(c)).select("audit_id", F.array_join("messages", "|").alias("messages"))


@query("audit_scores")
def all_scores(c):
    """The whole chain: pages and side data to scores."""
    return site_scores(c.spark, c.sf_dir)


@query("page_scores")
def quick_scores(c):
    """The flagship: scores from pages alone."""
    return page_scores(c.spark, c.sf_dir)


@query("finding_pages")
def finding_pages(c):
    """The pages of every finding, as rows."""
    return au.finding_pages(c.inputs, c.results).selectExpr(
        "audit_id", "check_id", "code", "page_key.id AS page_id", "url")
