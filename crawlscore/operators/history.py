"""Audit history: reuse, limits, follow-ups, prevalence.

`checkups` has id, url, status, created_at, finished_at, health_score, ip_hash, lead_id. One
address or visitor may own a third of all rows, so nothing here sorts a whole address or
visitor in one task: time buckets split them, and aggregates combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import text as tx, urls
from crawlscore.operators.comparison import last_known

ACTIVE = ["queued", "running"]
FINISHED = ["done", "failed"]


def _ts(column: str = "created_at"):
    return F.unix_micros(F.col(column).cast("timestamp"))


def reusable_reports(requests: DataFrame, checkups: DataFrame,
                     hours: int = fv.REUSE_HOURS) -> DataFrame:
    """For each request the latest finished audit of its address in the hours before.

    An as-of look-back over requests and reports together; what it finds is kept if it is
    young enough.
    """
    done = checkups.where("status = 'done'").groupBy("url", F.col("created_at").alias("at")).agg(
        F.max(F.struct("created_at", "id", "health_score")).alias("report"))
    asked = requests.select("url", F.col("requested_at").alias("at"),
                            F.lit(None).cast(done.schema["report"].dataType).alias("report"))
    instants = done.unionByName(asked).groupBy("url", "at").agg(F.max("report").alias("report"))
    known = last_known(instants, ["url"], "at", "report", "latest", inclusive=True)
    joined = requests.join(
        known.select("url", F.col("at").alias("requested_at"), "latest"), ["url", "requested_at"])
    age = _ts("requested_at") - F.unix_micros(F.col("latest.created_at").cast("timestamp"))
    fresh = age <= hours * 3600 * 1000000
    return joined.select(
        F.col("id").alias("request_id"), "url",
        F.when(fresh, F.col("latest.id")).alias("report_id"),
        F.when(fresh, F.col("latest.health_score")).alias("health_score"))


def in_progress(checkups: DataFrame) -> DataFrame:
    """The newest active audit of each address."""
    return checkups.where(F.col("status").isin(ACTIVE)).groupBy("url").agg(
        F.max_by(F.struct("id", "status", "created_at"), F.struct("created_at", "id")).alias("c")
    ).select("url", "c.id", "c.status", "c.created_at")


def over_rate_limit(checkups: DataFrame, limit: int = fv.RATE_LIMIT_PER_HOUR) -> DataFrame:
    """Starts whose visitor had already used up the limit in the hour before.

    Each start is put into its own hour and the next one, so an hour's window sees the whole
    hour before each of its rows while a busy visitor's history is split by hours. The count is the
    running total before the start less the one an hour earlier, which a marker row reads; so the
    work is linear in the starts of an hour.
    """
    hour = 3600 * 1000000
    counted = "NOT (status = 'failed' AND started_at IS NULL)"
    starts = checkups.where("coalesce(ip_hash, '') <> ''").select(
        "id", "ip_hash", "created_at", _ts().alias("at"),
        F.expr(f"CAST({counted} AS INT)").alias("counts"))
    slot = F.floor(F.col("at") / hour)
    placed = starts.withColumn("own", slot).withColumn("slot", F.explode(F.array(slot, slot + 1)))
    events = placed.select("id", "ip_hash", "slot", "at", "counts", (F.col("own") == F.col("slot")).alias("asks"),
                           F.lit(1).alias("sign"))
    markers = events.where("asks").withColumns({
        "at": F.col("at") - hour, "counts": F.lit(0), "sign": F.lit(-1)})
    before = F.coalesce(F.sum("counts").over(Window.partitionBy("ip_hash", "slot").orderBy("at").rangeBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    totals = events.unionByName(markers).withColumn("total", before * F.col("sign")).where("asks")
    judged = totals.groupBy("id").agg(F.sum("total").alias("in_last_hour")).where(F.col("in_last_hour") >= limit)
    return starts.join(judged, "id").select("id", "ip_hash", "created_at", "in_last_hour")


def active_over_time(checkups: DataFrame, cap: int = fv.QUEUE_CAP) -> DataFrame:
    """How many audits were waiting or running after each start or end.

    Running totals are kept within a minute, the minutes within a day and the days among each other,
    so no task sees more than a minute's steps, a day's minutes, or the small table of days.
    """
    begun = checkups.select(_ts().alias("at"), F.lit(1).alias("step"))
    ended = checkups.where("finished_at IS NOT NULL").select(
        _ts("finished_at").alias("at"), F.lit(-1).alias("step"))
    steps = begun.unionByName(ended).groupBy("at").agg(F.sum("step").alias("step"))
    steps = steps.withColumn("minute", F.floor(F.col("at") / (60 * 1000000)))
    minutes = steps.groupBy("minute").agg(F.sum("step").alias("total")).withColumn(
        "day", F.floor(F.col("minute") / 1440))
    per_day = minutes.groupBy("day").agg(F.sum("total").alias("day_total"))
    earlier_days = per_day.select("day", F.coalesce(F.sum("day_total").over(
        Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        .alias("base_day"))
    earlier_minutes = minutes.withColumn("in_day", F.coalesce(F.sum("total").over(
        Window.partitionBy("day").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0))).join(earlier_days, "day").select(
        "minute", (F.col("in_day") + F.col("base_day")).alias("base"))
    inside = F.sum("step").over(Window.partitionBy("minute").orderBy("at"))
    running = steps.withColumn("inside", inside).join(earlier_minutes, "minute")
    active = F.col("inside") + F.col("base")
    return running.select(
        F.timestamp_micros("at").alias("at"), active.alias("active"), (active >= cap).alias("busy"))


def stuck_audits(checkups: DataFrame, as_of: str) -> DataFrame:
    limit = fv.AUDIT_TIMEOUT_SECONDS + fv.STUCK_GRACE_SECONDS
    now = F.lit(as_of).cast("timestamp")
    return checkups.where(
        ~F.col("status").isin(FINISHED)
        & (F.unix_micros(now) - _ts() > limit * 1000000)).select("id", "url", "status", "created_at")


def due_rechecks(subscriptions: DataFrame, checkups: DataFrame, as_of: str, limit: int,
                 capacity: int | None = None) -> DataFrame:
    """The due subscriptions, oldest first, with what happens to each.

    `limit` and `capacity` belong to the rule: how many are taken per run, and how many audits
    may start before the run stops.
    """
    now = F.lit(as_of).cast("timestamp")
    due = subscriptions.where(F.col("active") & (F.col("next_check_at") <= now)).orderBy(
        "next_check_at", "id").limit(limit)
    busy = in_progress(checkups).select("url", F.lit(True).alias("busy"))
    judged = due.join(busy, "url", "left").withColumn("busy", F.coalesce("busy", F.lit(False)))
    order = Window.orderBy("next_check_at", "id")  # at most `limit` rows
    started = F.sum(F.when(F.col("busy"), 0).otherwise(1)).over(
        order.rowsBetween(Window.unboundedPreceding, -1))
    placed = judged.withColumn("before", F.coalesce(started, F.lit(0)))
    if capacity is not None:
        placed = placed.where(F.col("before") < capacity)
    days = F.when(F.col("busy"), 1).otherwise(fv.RECHECK_EVERY_DAYS)
    return placed.select(
        "id", "url", F.when(F.col("busy"), "deferred").otherwise("started").alias("action"),
        (now + F.make_dt_interval(days)).alias("next_check_at"))


def after_rechecks(subscriptions: DataFrame, actions: DataFrame) -> DataFrame:
    """The subscription table after a run; it stays whole."""
    changed = actions.select("id", F.col("next_check_at").alias("__next"))
    return subscriptions.join(changed, "id", "left").withColumn(
        "next_check_at", F.coalesce("__next", "next_check_at")).drop("__next")


def latest_finished(checkups: DataFrame) -> DataFrame:
    """For each audit the newest finished audit of its address at or after it, else itself.

    The newest finished audit of an address serves all its audits that are not younger.
    """
    newest = checkups.where("status = 'done'").groupBy("url").agg(
        F.max(F.struct("created_at", "id", "health_score")).alias("newest"))
    joined = checkups.join(newest, "url", "left")
    later = F.coalesce(F.col("newest.created_at") >= F.col("created_at"), F.lit(False))
    return joined.select(
        checkups["id"], "url", F.when(later, F.col("newest.id")).otherwise(checkups["id"])
        .alias("latest_id"))


def emails_left(report_emails: DataFrame, checkups: DataFrame, as_of: str,
                per_day: int = fv.REPORT_EMAILS_PER_DAY) -> DataFrame:
    now = F.lit(as_of).cast("timestamp")
    sent = report_emails.where(
        _ts() >= F.unix_micros(now) - F.lit(86400 * 1000000)).groupBy("checkup_id").agg(
        F.count("*").alias("sent"))
    return checkups.join(sent, checkups["id"] == sent["checkup_id"], "left").select(
        checkups["id"], F.greatest(F.lit(0), per_day - F.coalesce("sent", F.lit(0))).alias("left"))


def score_drops(pairs: DataFrame, drop: int = fv.ALERT_ON_DROP) -> DataFrame:
    """Audits that lost at least `drop` points against the one before."""
    return pairs.withColumn("delta", F.col("health_score") - F.col("previous_score")).where(
        F.col("delta") <= -drop)


def owner_alerts(checkups: DataFrame, leads: DataFrame, below: int) -> DataFrame:
    """Finished audits worth an alert: left an address, or a low score without one."""
    done = checkups.where("status = 'done'")
    named = leads.select(F.col("id").alias("lead_id"), "email")
    joined = done.join(named, "lead_id", "left")
    reason = F.when(F.col("email").isNotNull(), fv.ALERT_NAMED).when(
        F.col("health_score") < below, fv.ALERT_LOW_SCORE)
    return joined.select("id", "url", "health_score", "email", reason.alias("reason")).where(
        "reason IS NOT NULL")


def band_distribution(checkups: DataFrame) -> DataFrame:
    return checkups.groupBy(F.coalesce(tx.band(F.col("health_score")), F.lit("none")).alias("band")).agg(
        F.count("*").alias("audits"))


def durations(checkups: DataFrame) -> DataFrame:
    """Seconds from start to end of each finished audit."""
    return checkups.where("started_at IS NOT NULL AND finished_at IS NOT NULL").select(
        "id", ((_ts("finished_at") - _ts("started_at")) / 1000000.0).alias("seconds"))


def audits_per_lead(leads: DataFrame, checkups: DataFrame) -> DataFrame:
    own = checkups.where("lead_id IS NOT NULL").groupBy("lead_id").agg(
        F.count("*").alias("audits"),
        F.max_by("health_score", F.struct("created_at", "id")).alias("newest_score"))
    return leads.join(own, leads["id"] == own["lead_id"], "left").select(
        leads["id"], "email", F.coalesce("audits", F.lit(0)).alias("audits"), "newest_score")


def search_findings(findings: DataFrame, text: str = "", **equal: str) -> DataFrame:
    """Findings by severity, category, impact or effort, and by words in the message."""
    for column, value in equal.items():
        findings = findings.where(F.col(column) == value)
    if text:
        findings = findings.where(F.lower("message").contains(text.lower()))
    return findings


def subscribe(requests: DataFrame, subscriptions: DataFrame, as_of: str) -> DataFrame:
    """Subscriptions after sign-ups: one per mail and site; stopped ones start again."""
    now = F.lit(as_of).cast("timestamp")
    asked = requests.select(
        F.lower("email").alias("email"),
        urls.site_root(urls.normalize_url(F.col("url"))).alias("url"),
    ).where("url IS NOT NULL").distinct()
    later = now + F.make_dt_interval(F.lit(fv.RECHECK_EVERY_DAYS))
    joined = subscriptions.join(
        asked.withColumn("asked", F.lit(True)), ["email", "url"], "full_outer")
    fresh = F.col("asked") & ~F.coalesce("active", F.lit(False))
    return joined.select(
        "email", "url", (F.coalesce("active", F.lit(False)) | F.coalesce("asked", F.lit(False)))
        .alias("active"),
        F.when(fresh, later).otherwise(F.col("next_check_at")).alias("next_check_at"))


def clean_leads(requests: DataFrame) -> DataFrame:
    """Contact details of those who left a mail address."""
    return requests.where("coalesce(trim(email), '') <> ''").select(
        F.trim(F.regexp_replace("name", r"\s+", " ")).alias("name"),
        F.lower(F.trim("email")).alias("email"), "consent")


def prevalence(findings: DataFrame) -> DataFrame:
    """In how many audits each check fails, by check, by category and severity, and overall.

    Findings come once per audit, check and code; counting audits per check first makes the
    grouping sets work on one row per audit and check.
    """
    bad = findings.where("severity IN ('fail', 'warn')").select(
        "audit_id", "check_id", "category", "severity").distinct()
    return bad.groupingSets(
        [["check_id"], ["category", "severity"], []], "check_id", "category", "severity"
    ).agg(F.countDistinct("audit_id").alias("audits"), F.count("*").alias("rows"))
