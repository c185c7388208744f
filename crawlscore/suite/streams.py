"""Streaming operators as queries: the given tables are replayed as a file stream."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscore import fixed_values as fv
from crawlscore.session import shared_folder
from crawlscore.sources import derived as dv
from crawlscore.streaming import alerts, keyed
from crawlscore.streaming.sites import SiteStream
from crawlscore.suite.checks import O
from crawlscore.suite.corpus import query
from crawlscore.suite.oracle_pages import PAGES, count, first, page_cte
from crawlscore.suite.scores import category_scores_sql

CHECKUPS = dv.with_clause("checkups")
DONE = "SELECT * FROM checkups WHERE status = 'done'"


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def _stream(df: DataFrame) -> DataFrame:
    """A table as a stream of its files."""
    folder = _new_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).parquet(folder)


def _drain(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """Run a stream over what is there, and return what it has emitted; a batch that runs again replaces its rows."""
    spark = stream.sparkSession
    folder = folder or f"{_new_folder(spark)}-drained"
    emitted = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    running = (
        stream.writeStream.outputMode(mode).foreachBatch(keep)
        .option("checkpointLocation", f"{folder}-checkpoint").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(emitted).parquet(folder)


def _arrivals(df: DataFrame, number, batches: int):
    """The table's rows land in one folder, those of batch 0 first; yields its stream after each landing."""
    spark, folder = df.sparkSession, _new_folder(df.sparkSession)
    for k in range(batches):
        df.where(number == k).write.mode("append").parquet(folder)
        yield spark.readStream.schema(df.schema).parquet(folder)


def _span(at: str, low, high, batches: int):
    """Which of equally long spans of time a row belongs to."""
    width = ((high or 0) - (low or 0)) // batches + 1
    return F.floor((F.unix_micros(at) - F.lit(low or 0)) / width)


def _replayed(df: DataFrame, at: str, build: Callable[[DataFrame], DataFrame], mode: str, batches: int = 3,
              delay=None, last: DataFrame | None = None) -> DataFrame:
    """Let a table arrive in spans of time, rows with a `delay` that many spans later (the last span at most), and
    return what the stream emitted. The rows of `last` come at the very end."""
    folder = f"{_new_folder(df.sparkSession)}-drained"
    low, high = df.agg(F.min(F.unix_micros(at)), F.max(F.unix_micros(at))).head()
    number = _span(at, low, high, batches)
    if delay is not None:
        number = F.least(number + delay, F.lit(batches - 1))
    rows = df.withColumn("landing", number)
    if last is not None:
        rows, batches = rows.unionByName(last.withColumn("landing", F.lit(batches))), batches + 1
    for stream in _arrivals(rows, F.col("landing"), batches):
        emitted = _drain(build(stream.drop("landing")), mode, folder)
    return emitted


K1_COLUMNS = {
    "title": first("html", "<title>([^<]*)</title>"),
    "h1_count": "len(regexp_extract_all(html, '<h1>'))::INT",
    "is_https": "starts_with(final_url, 'https://')",
    "description": "CASE WHEN contains(html, '<meta name=\"description\"') THEN " + first(
        "html", "<meta name=\"description\" content=\"([^\"]*)\"") + " END",
    "canonicals": f"{count('html', '<link rel=.canonical.')}",
    "images": f"{count('html', '<img[^>]*>')}",
}


@query("K1", page_cte() + " SELECT page_id, " + ", ".join(f"{v} AS {k}" for k, v in K1_COLUMNS.items()) + " FROM op")
def features(c):
    """All row-local features run over the stream; some of each kind are compared."""
    found = _drain(alerts.page_features(_stream(c.pages)), "append")
    return found.select(F.col("page_key.id").alias("page_id"), "title", "h1_count", "is_https", "description",
                        F.size("canonicals").cast("bigint").alias("canonicals"), F.size("images").cast("bigint").alias("images"))


@query("K2", CHECKUPS + """ SELECT (epoch_us(created_at) // 300000000 - k) * 300000000 AS window_us, ip_hash, count(*) AS starts FROM checkups, range(12) AS r(k) GROUP BY 1, 2""")
def rates(c):
    rows = c.derived("checkups").select(F.col("created_at").cast("timestamp"), "ip_hash")
    # the two halves of `start_rates`: counts of a block only grow, so its newest are the largest, and are unfolded once
    emitted = _drain(alerts.rate_blocks(_stream(rows)), "update")
    slots = [n for n in emitted.columns if n.startswith("starts_")]
    newest = emitted.groupBy("block_start", "ip_hash").agg(*[F.max(n).alias(n) for n in slots])
    return alerts.block_rates(newest).select(F.unix_micros("window_start").alias("window_us"), "ip_hash", "starts")


# every eleventh mail lands two of four spans after its own; a day is closed one hour after its end
MAILS = dv.with_clause("report_emails") + """,
bounds AS (SELECT min(epoch_us(created_at)) AS low, (max(epoch_us(created_at)) - min(epoch_us(created_at))) // 4 + 1 AS width FROM report_emails),
landed AS (SELECT *, epoch_us(created_at) AS us, least((epoch_us(created_at) - low) // width + CASE WHEN id % 11 = 0 THEN 2 ELSE 0 END, 3) AS landing
  FROM report_emails, bounds),
marks AS (SELECT landing, max(max(us)) OVER (ORDER BY landing ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - 3600000 AS mark
  FROM landed GROUP BY landing),
judged AS (SELECT us, checkup_id, mark IS NOT NULL AND (us // 86400000000 + 1) * 86400000 <= mark AS dropped
  FROM landed JOIN marks USING (landing))"""


@query("K2_daily", MAILS + " SELECT us // 86400000000 * 86400000000 AS day_us, checkup_id, count(*) AS sent FROM judged WHERE NOT dropped GROUP BY 1, 2")
def daily(c):
    """Report mails per audit and day; mails that land behind the watermark of their day are dropped."""
    return _daily(c)[1].select(F.unix_micros("day").alias("day_us"), "checkup_id", "sent")


@query("K2_dropped", MAILS + " SELECT count(*) AS mails, count(*) FILTER (WHERE dropped) AS dropped FROM judged")
def dropped(c):
    mails, counted = _daily(c)
    both = mails.select(F.lit(1).alias("come"), F.lit(0).alias("sent")).unionByName(counted.select(F.lit(0).alias("come"), "sent"))
    return both.agg(F.coalesce(F.sum("come"), F.lit(0)).alias("mails"), F.coalesce(F.sum("come") - F.sum("sent"), F.lit(0)).alias("dropped"))


def _daily(c) -> tuple[DataFrame, DataFrame]:
    mails = c.derived("report_emails").select("id", "checkup_id", F.col("created_at").cast("timestamp"))
    emitted = _replayed(mails, "created_at", alerts.daily_mails, "update", 4, F.when(F.col("id") % 11 == 0, 2).otherwise(0))
    return mails, emitted.groupBy("day", "checkup_id").agg(F.max("sent").alias("sent"))


ACCEPTED = dv.with_clause("checkups", "requests") + f""" SELECT r.id FROM requests r ASOF LEFT JOIN ({DONE}) c
  ON c.url = r.url AND c.created_at <= r.requested_at WHERE c.id IS NULL OR c.created_at < r.requested_at - INTERVAL '24' HOUR"""


@query("K3", ACCEPTED)
@query("K3_accepted", ACCEPTED)
def accepted(c):
    """Requests and finished audits arrive together, in order of time and in several batches."""
    at = F.col("requested_at").cast("timestamp")
    rows = c.derived("requests").select("id", "url", at.alias("at"), F.lit(False).alias("finished"))
    done = c.derived("checkups").where("status = 'done'").select(
        "id", "url", F.col("created_at").cast("timestamp").alias("at"), F.lit(True).alias("finished"))

    def decide(events: DataFrame) -> DataFrame:
        return alerts.accepted_requests(
            events.where("NOT finished").withColumnRenamed("at", "requested_at"),
            events.where("finished").withColumnRenamed("at", "created_at"))

    return _replayed(rows.unionByName(done), "at", decide, "append").select("id")


@query("K4", CHECKUPS + " SELECT id FROM checkups WHERE finished_at IS NULL AND created_at < (SELECT max(created_at) FROM checkups) - INTERVAL '400' SECOND")
def stuck(c):
    """Starts and ends arrive in three spans of time; every fifth end lands a span late, but before the watermark."""
    at = F.col("created_at").cast("timestamp")
    rows = c.derived("checkups")
    begun = rows.select("id", F.lit("running").alias("status"), at.alias("at"))
    ended = rows.where("finished_at IS NOT NULL").select(
        "id", F.lit("done").alias("status"), (at + F.expr("INTERVAL 1 SECOND")).alias("at"))
    events = begun.unionByName(ended)
    low, high = events.agg(F.min(F.unix_micros("at")), F.max(F.unix_micros("at"))).head()
    late = f"{2 * ((high or 0) - (low or 0)) // 3_000_000 + 60} seconds"
    # when this row comes, the watermark passes the timers of all audits but those of the last 400 seconds
    kept_open = 400 - fv.AUDIT_TIMEOUT_SECONDS - fv.STUCK_GRACE_SECONDS
    tick = begun.agg(F.max("at").alias("at")).where("at IS NOT NULL").select(
        F.lit(-1).cast("bigint").alias("id"), F.lit("done").alias("status"),
        (F.col("at") + F.expr(f"INTERVAL {late}") - F.expr(f"INTERVAL {kept_open} SECOND")).alias("at"))
    delay = F.when((F.col("status") == "done") & (F.col("id") % 5 == 0), 1).otherwise(0)
    return _replayed(events, "at", lambda e: keyed.stuck_audits(e, late=late), "append", 3, delay, tick).select("id")


@query("K5", CHECKUPS + """ SELECT id, delta FROM (SELECT id, health_score - lag(health_score) OVER (PARTITION BY url ORDER BY created_at, id) AS delta FROM checkups WHERE status = 'done') AS x WHERE delta <= -5""")
def drops(c):
    """Audits arrive in four spans of time, every seventh one span late; a row at the end lets the watermark pass them all."""
    rows = c.derived("checkups").where("status = 'done'").select(
        "id", "url", "health_score", F.col("created_at").cast("timestamp"))
    low, high = rows.agg(F.min(F.unix_micros("created_at")), F.max(F.unix_micros("created_at"))).head()
    late = f"{2 * ((high or 0) - (low or 0)) // 4_000_000 + 60} seconds"
    tick = rows.agg(F.max("created_at").alias("at")).where("at IS NOT NULL").select(
        F.lit(-1).cast("bigint").alias("id"), F.lit("").alias("url"), F.lit(None).cast("int").alias("health_score"),
        (F.col("at") + F.expr(f"INTERVAL {late}") + F.expr("INTERVAL 1 HOUR")).alias("created_at"))
    delay = F.when(F.col("id") % 7 == 0, 1).otherwise(0)
    return _replayed(rows, "created_at", lambda a: keyed.score_drops(a, late=late), "append", 4, delay, tick).select("id", "delta")


# --- whole sites ------------------------------------------------------------------------------------
# a site's pages are crawled within minutes; sites come in three batches, and every thirteenth page of the
# first batch's sites comes with the last one, long after its session was closed
SITE_MARK = "(instr('0123456789abcdef', substr(md5(audit_id), 1, 1)) - 1)"
TOO_LATE = f"({SITE_MARK} < 6 AND page_id % 13 = 0)"
SITE_CHECKS = [
    "seo.title", "seo.meta_description", "seo.single_h1", "seo.duplicate_titles", "best_practices.https",
    "best_practices.nosniff", "accessibility.html_lang", "performance.image_dimensions", "agentic.landmarks",
]


def _on_time(statement: str) -> str:
    """A check's statement over the pages that came in time, without what a browser saw."""
    cut = statement.replace("site_pages AS (", "all_site_pages AS (", 1).replace(
        "homepages AS (", f"site_pages AS (SELECT * FROM all_site_pages WHERE NOT {TOO_LATE}),\nhomepages AS (", 1)
    return cut.replace("LEFT JOIN renders r ON r.audit_id = p.audit_id", "LEFT JOIN (SELECT * FROM renders WHERE false) r ON r.audit_id = p.audit_id")


SITE_FINDINGS = " UNION ALL ".join(
    f"SELECT '{i}' AS check_id, * FROM ({_on_time(O[i])}) AS x" for i in SITE_CHECKS)


def _judged_sites(c) -> SiteStream:
    begins = F.timestamp_seconds(F.lit(1_704_067_200) + F.expr(SITE_MARK) * 21_600 + F.expr("page_key.id % 50") * 5)
    rows = c.pages.withColumn("crawled_at", begins)
    tick = rows.limit(1).withColumns({"audit_id": F.lit(""), "crawled_at": F.timestamp_seconds(F.lit(1_800_000_000))})
    mark = F.expr(SITE_MARK)
    landing = F.when(mark < 6, F.when(F.col("page_key.id") % 13 == 0, 2).otherwise(0)).when(mark < 11, 1).otherwise(2)
    landed = rows.withColumn("landing", landing).unionByName(tick.withColumn("landing", F.lit(3)))
    sites = SiteStream(c.spark, _new_folder(c.spark), only=SITE_CHECKS)
    for stream in _arrivals(landed, F.col("landing"), 4):
        sites.run(stream.drop("landing"))
    return sites


@query("K6", SITE_FINDINGS)
def site_findings(c):
    """Findings of each site when its session closes, over four batches with late pages."""
    rows = _judged_sites(c).results()
    return rows.selectExpr(
        "check_id", "audit_id", "status", "round(score, 6) AS score", "explode_outer(findings) AS f"
    ).selectExpr("check_id", "audit_id", "status", "score", "f.finding_ord", "f.code", "f.severity", "f.impact", "f.effort", "f.affected")


@query("K6_scores", category_scores_sql(SITE_FINDINGS, SITE_CHECKS))
def site_scores(c):
    return _judged_sites(c).category_scores().select("audit_id", "category", "score", "checks_run", "checks_skipped")
