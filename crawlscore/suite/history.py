"""Comparison and audit-history operators as queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.operators import comparison as cp
from crawlscore.operators import history as hs
from crawlscore.operators import scoring as sc
from crawlscore.sources import derived as dv
from crawlscore.suite.corpus import query
from crawlscore.suite.scores import CATEGORY_SCORES, SEV

NOW = "2024-01-20 12:00:00"
CHECKUPS = dv.with_clause("checkups")
FINDINGS = dv.with_clause("finding_rows")


def _us(column: str) -> str:
    return f"epoch_us({column})"


PREVIOUS = """, prev AS (SELECT c.id, (SELECT max((p.created_at, p.id)) FROM checkups p WHERE p.url = c.url AND p.status = 'done' AND p.created_at < c.created_at)[2] AS previous_id FROM checkups c)"""


@query("I1", CHECKUPS + """ SELECT c.id, p.id AS previous_id, p.health_score AS previous_score FROM checkups c ASOF LEFT JOIN (SELECT * FROM checkups WHERE status = 'done') p ON p.url = c.url AND p.created_at < c.created_at""")
def previous(c):
    return cp.previous_audits(c.derived("checkups")).select("id", "previous_id", "previous_score")


WORST = f""", worst AS (SELECT audit_id, check_id, arg_min(severity, ({SEV}) * 1000000 + finding_ord) AS severity, arg_min(finding_ord, ({SEV}) * 1000000 + finding_ord) AS first FROM finding_rows WHERE severity IN ('fail', 'warn') GROUP BY 1, 2)"""


@query("I2", FINDINGS + WORST + " SELECT w.audit_id, w.check_id, w.severity, f.message FROM worst w JOIN finding_rows f ON f.finding_ord = w.first")
def worst(c):
    return cp.problems_by_check(c.derived("finding_rows")).select(
        "audit_id", "check_id", "severity", "message")


@query("I3", CHECKUPS + """ SELECT c.id, c.health_score - p.health_score AS delta, CASE WHEN c.health_score > p.health_score THEN 'up' WHEN c.health_score < p.health_score THEN 'down' ELSE 'same' END AS direction,
  abs(coalesce(c.health_score - p.health_score, 0)) AS size FROM checkups c ASOF LEFT JOIN (SELECT * FROM checkups WHERE status = 'done') p ON p.url = c.url AND p.created_at < c.created_at""")
def change(c):
    pairs = cp.previous_audits(c.derived("checkups"))
    return pairs.select("id", cp.score_change(
        F.col("previous_score"), F.col("health_score")).alias("x")).select("id", "x.*")


# each audit against its neighbour in the list of audits
_PAIRS = ", pairs AS (SELECT concat('audit', user_id) AS audit_id, concat('audit', user_id + 1) AS previous_id FROM (SELECT DISTINCT user_id FROM events) AS u WHERE user_id + 1 IN (SELECT user_id FROM events))"
_KNOWN = ", known AS (SELECT DISTINCT audit_id, check_id FROM finding_rows WHERE value < 100)"


def _pairs(c, right: str):
    users = c.table("events").select("user_id").distinct()
    following = users.select((F.col("user_id") - 1).alias("user_id"))
    return users.join(following, "user_id", "left_semi").selectExpr(
        "concat('audit', user_id) AS audit_id", f"concat('audit', user_id + 1) AS {right}")


def _known(c):
    return c.derived("finding_rows").where("value < 100").select("audit_id", "check_id").distinct()


@query("I4", FINDINGS + WORST + _PAIRS + _KNOWN + """, n AS (SELECT p.*, w.check_id, w.severity FROM pairs p JOIN worst w USING (audit_id)), o AS (SELECT p.audit_id, p.previous_id, w.check_id, w.severity FROM pairs p JOIN worst w ON w.audit_id = p.previous_id)
  SELECT coalesce(n.audit_id, o.audit_id) AS audit_id, coalesce(n.check_id, o.check_id) AS check_id, CASE WHEN n.check_id IS NULL THEN 'fixed' WHEN o.check_id IS NOT NULL THEN 'still' WHEN k.check_id IS NOT NULL THEN 'new' ELSE 'newly_checked' END AS change, coalesce(n.severity, o.severity) AS severity
  FROM n FULL JOIN o ON n.audit_id = o.audit_id AND n.check_id = o.check_id LEFT JOIN known k ON k.audit_id = n.previous_id AND k.check_id = n.check_id""")
def changes(c):
    return cp.changes(_pairs(c, "previous_id"), c.derived("finding_rows"), _known(c)).select(
        "audit_id", "check_id", "change", "severity")


RIVALS = CATEGORY_SCORES + _PAIRS + """, side AS (SELECT p.audit_id, a.category, a.score AS ours, b.score AS theirs, CASE WHEN a.score > b.score THEN 'ours' WHEN a.score < b.score THEN 'theirs' ELSE 'tie' END AS leader
  FROM pairs p JOIN cs a USING (audit_id) JOIN cs b ON b.audit_id = p.previous_id AND b.category = a.category)"""


def _side(c):
    return cp.rival_scores(_pairs(c, "rival_id"), sc.category_scores(c.derived("result_rows")))


@query("I5", RIVALS + " SELECT * FROM side")
def rivals(c):
    return _side(c).select("audit_id", "category", "ours", "theirs", "leader")


@query("I5_counts", RIVALS + " SELECT audit_id, count(*) FILTER (WHERE leader = 'ours') AS ahead, count(*) FILTER (WHERE leader = 'theirs') AS behind FROM side GROUP BY 1")
def rival_counts(c):
    return cp.rival_counts(_side(c)).select("audit_id", "ahead", "behind")


@query("I6", FINDINGS + WORST + _PAIRS + _KNOWN + """ SELECT p.audit_id, a.check_id, CASE WHEN w.check_id IS NOT NULL THEN 'they' ELSE 'we' END AS solved_by FROM pairs p JOIN known a ON a.audit_id = p.audit_id JOIN known b ON b.audit_id = p.previous_id AND b.check_id = a.check_id
  LEFT JOIN worst w ON w.audit_id = p.audit_id AND w.check_id = a.check_id LEFT JOIN worst v ON v.audit_id = p.previous_id AND v.check_id = a.check_id WHERE (w.check_id IS NULL) <> (v.check_id IS NULL)""")
def solved(c):
    return cp.solved(_pairs(c, "rival_id"), c.derived("finding_rows"), _known(c)).select(
        "audit_id", "check_id", "solved_by")


@query("I7", CATEGORY_SCORES + """ SELECT audit_id, category, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, round(percent_rank() OVER (PARTITION BY right(audit_id, 1), category ORDER BY score), 9) AS percent_rank
  FROM cs WHERE score IS NOT NULL WINDOW w AS (PARTITION BY right(audit_id, 1), category ORDER BY score DESC)""")
def peers(c):
    rows = sc.category_scores(c.derived("result_rows")).withColumn("peer_group", F.right("audit_id", F.lit(1)))
    return cp.peer_ranks(rows).select(
        "audit_id", "category", "rank", F.col("dense_rank").cast("bigint").alias("dense_rank"),
        F.round("percent_rank", 9).alias("percent_rank"))


@query("J1", dv.with_clause("checkups", "requests") + """ SELECT r.id AS request_id, CASE WHEN c.created_at >= r.requested_at - INTERVAL '24' HOUR THEN c.id END AS report_id FROM requests r
  ASOF LEFT JOIN (SELECT * FROM checkups WHERE status = 'done') c ON c.url = r.url AND c.created_at <= r.requested_at""")
def reusable(c):
    return hs.reusable_reports(c.derived("requests"), c.derived("checkups")).select(
        "request_id", "report_id")


@query("J2", CHECKUPS + " SELECT url, arg_max(id, (created_at, id)) AS id FROM checkups WHERE status IN ('queued', 'running') GROUP BY url")
def active(c):
    return hs.in_progress(c.derived("checkups")).select("url", "id")


@query("J3", CHECKUPS + """, s AS (SELECT *, NOT (status = 'failed' AND started_at IS NULL) AS k FROM checkups WHERE ip_hash <> '')
  SELECT id, n AS in_last_hour FROM (SELECT a.id, (SELECT count(*) FROM s b WHERE b.ip_hash = a.ip_hash AND b.k AND b.created_at < a.created_at AND b.created_at >= a.created_at - INTERVAL '1' HOUR) AS n FROM s a) AS x WHERE n >= 2""")
def limited(c):
    return hs.over_rate_limit(c.derived("checkups"), limit=2).select("id", "in_last_hour")


@query("J4", CHECKUPS + f""", steps AS (SELECT at_us, sum(d) AS d FROM (SELECT {_us('created_at')} AS at_us, 1 AS d FROM checkups UNION ALL SELECT {_us('finished_at')}, -1 FROM checkups WHERE finished_at IS NOT NULL) AS x GROUP BY at_us)
  SELECT at_us, (sum(d) OVER (ORDER BY at_us))::BIGINT AS active FROM steps""")
def over_time(c):
    return hs.active_over_time(c.derived("checkups")).select(
        F.unix_micros("at").alias("at_us"), "active")


@query("J5", CHECKUPS + f" SELECT id FROM checkups WHERE status IN ('queued', 'running') AND created_at < TIMESTAMP '{NOW}' - INTERVAL '300' SECOND")
def stuck(c):
    return hs.stuck_audits(c.derived("checkups"), NOW).select("id")


@query("J6", dv.with_clause("subscriptions", "checkups") + f""", due AS (SELECT *, EXISTS (SELECT 1 FROM checkups c WHERE c.url = s.url AND c.status IN ('queued', 'running')) AS busy FROM (SELECT * FROM subscriptions WHERE active AND next_check_at <= TIMESTAMP '{NOW}' ORDER BY next_check_at, id LIMIT 300) s),
  placed AS (SELECT *, coalesce(sum(CASE WHEN busy THEN 0 ELSE 1 END) OVER (ORDER BY next_check_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM due)
  SELECT id, CASE WHEN busy THEN 'deferred' ELSE 'started' END AS action, {_us(f"TIMESTAMP '{NOW}'")} + CASE WHEN busy THEN 1 ELSE 30 END * 86400000000 AS next_us FROM placed WHERE before < 200""")
def due(c):
    return hs.due_rechecks(c.derived("subscriptions"), c.derived("checkups"), NOW, 300, 200).select(
        "id", "action", F.unix_micros(F.col("next_check_at").cast("timestamp")).alias("next_us"))


@query("J7", CHECKUPS + """ SELECT c.id, CASE WHEN n.created_at >= c.created_at THEN n.id ELSE c.id END AS latest_id FROM checkups c LEFT JOIN (SELECT url, max(created_at) AS created_at, arg_max(id, (created_at, id)) AS id FROM checkups WHERE status = 'done' GROUP BY url) n USING (url)""")
def latest(c):
    return hs.latest_finished(c.derived("checkups")).select("id", "latest_id")


@query("J8", dv.with_clause("report_emails", "checkups") + f""" SELECT c.id, greatest(0, {fv.REPORT_EMAILS_PER_DAY} - count(e.id)) AS "left" FROM checkups c LEFT JOIN report_emails e ON e.checkup_id = c.id AND e.created_at >= TIMESTAMP '{NOW}' - INTERVAL '1' DAY GROUP BY c.id""")
def mails(c):
    return hs.emails_left(c.derived("report_emails"), c.derived("checkups"), NOW)


@query("J9", CHECKUPS + """ SELECT c.id, c.health_score - p.health_score AS delta FROM checkups c ASOF JOIN (SELECT * FROM checkups WHERE status = 'done') p ON p.url = c.url AND p.created_at < c.created_at WHERE c.health_score - p.health_score <= -5""")
def drops(c):
    return hs.score_drops(cp.previous_audits(c.derived("checkups"))).select("id", "delta")


@query("J10", dv.with_clause("checkups", "leads") + """ SELECT c.id, CASE WHEN l.id IS NOT NULL THEN 'left their email' ELSE 'has a low score (no contact details)' END AS reason FROM checkups c LEFT JOIN leads l ON l.id = c.lead_id WHERE c.status = 'done' AND (l.id IS NOT NULL OR c.health_score < 40)""")
def alerts(c):
    return hs.owner_alerts(c.derived("checkups"), c.derived("leads"), 40).select("id", "reason")


@query("J11", CHECKUPS + " SELECT CASE WHEN health_score < 50 THEN 'urgent' WHEN health_score < 90 THEN 'attention' WHEN health_score IS NOT NULL THEN 'healthy' ELSE 'none' END AS band, count(*) AS audits FROM checkups GROUP BY 1")
def distribution(c):
    return hs.band_distribution(c.derived("checkups"))


@query("J12", CHECKUPS + " SELECT id, (epoch_us(finished_at) - epoch_us(started_at)) / 1000000.0::DOUBLE AS seconds FROM checkups WHERE started_at IS NOT NULL AND finished_at IS NOT NULL")
def durations(c):
    return hs.durations(c.derived("checkups"))


@query("J13", dv.with_clause("checkups", "leads") + """ SELECT l.id, l.email, count(c.id) AS audits, nullif(arg_max(coalesce(c.health_score, -1), (c.created_at, c.id)), -1) AS newest_score FROM leads l LEFT JOIN checkups c ON c.lead_id = l.id GROUP BY 1, 2""")
def per_lead(c):
    return hs.audits_per_lead(c.derived("leads"), c.derived("checkups"))


@query("J14", FINDINGS + " SELECT finding_ord FROM finding_rows WHERE severity = 'warn' AND impact = 'high' AND contains(message, '77')")
def search(c):
    return hs.search_findings(
        c.derived("finding_rows"), "77", severity="warn", impact="high").select("finding_ord")


@query("J15", dv.with_clause("subscriptions") + f""", asked AS (SELECT DISTINCT lower(concat('Customer', user_id, '@Example.org')) AS email, concat('https://site', user_id, '.example.org/') AS url FROM events)
  SELECT coalesce(s.email, a.email) AS email, coalesce(s.url, a.url) AS url, coalesce(s.active, false) OR a.url IS NOT NULL AS active, CASE WHEN a.url IS NOT NULL AND NOT coalesce(s.active, false) THEN {_us(f"TIMESTAMP '{NOW}'")} + 30 * 86400000000 ELSE {_us('s.next_check_at')} END AS next_us
  FROM subscriptions s FULL JOIN asked a ON a.email = s.email AND a.url = s.url""")
def upsert(c):
    asked = c.table("events").selectExpr(
        "concat('Customer', user_id, '@Example.org') AS email",
        "concat('site', user_id, '.Example.org/pricing?x=', event_id) AS url")
    return hs.subscribe(asked, c.derived("subscriptions"), NOW).select(
        "email", "url", "active",
        F.unix_micros(F.col("next_check_at").cast("timestamp")).alias("next_us"))


@query("J16", "SELECT c_custkey, regexp_replace(c_name, '#', ' ') AS name, lower(concat(c_name, '@X.org')) AS email FROM customer WHERE c_mktsegment <> 'FURNITURE'")
def cleaned(c):
    asked = c.table("customer").selectExpr(
        "c_custkey", "concat(' ', replace(c_name, '#', '   '), chr(10)) AS name",
        "CASE WHEN c_mktsegment = 'FURNITURE' THEN ' ' ELSE concat(' ', c_name, '@X.org ') END AS email",
        "true AS consent")
    keyed = asked.withColumn("name", F.concat_ws("|", "c_custkey", "name"))
    rows = hs.clean_leads(keyed)
    return rows.select(
        F.substring_index("name", "|", 1).cast("bigint").alias("c_custkey"),
        F.trim(F.substring_index("name", "|", -1)).alias("name"), "email")


@query("J17", FINDINGS + """ SELECT check_id, category, severity, count(DISTINCT audit_id) AS audits, count(*) AS "rows" FROM (SELECT DISTINCT audit_id, check_id, category, severity FROM finding_rows WHERE severity IN ('fail', 'warn')) AS d
  GROUP BY GROUPING SETS ((check_id), (category, severity), ())""")
def prevalence(c):
    return hs.prevalence(c.derived("finding_rows"))
