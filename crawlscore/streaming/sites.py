"""Check results of whole sites from a stream of crawled pages: a site is judged when its pages have stopped coming.

Two streams work one behind the other. The first parses pages and appends them to a table, exactly once. The second
follows that table with a session per audit; when the watermark closes sessions, the batch plan of the checks runs on
their pages and its results replace those of the same batch, so that a batch that runs again leaves no second copy.
State is one count per open session, however large a site is; pages stay in the table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crawlscore.operators import scoring
from crawlscore.plans.audit import AuditInputs, check_results
from crawlscore.plans.catalog import catalogue
from crawlscore.sources import pages as pg

_OF_PAGES = {"title_groups", "address_quality", "h1_groups"}


def page_checks() -> list[str]:
    """The checks that need nothing but pages."""
    return [i for i, c in catalogue().items() if not c.requires and set(c.tables) <= _OF_PAGES]


class SiteStream:
    """The two streams over one folder: `pages` (the table of parsed pages) and `results`, with their checkpoints.

    Pages have the columns of the `pages` input and crawled_at. An audit's pages that are less than `gap` apart are
    one session. A page counts if it was there when its session's last page came; pages behind the watermark of
    a closed session start a session of their own only if that is still open, else they are dropped.
    """

    def __init__(self, spark: SparkSession, folder: str, gap: str = "10 minutes", late: str = "10 minutes",
                 only: list[str] | None = None):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.gap, self.late = gap, late
        self.only = page_checks() if only is None else only
        self.schema: T.StructType | None = None

    def run(self, pages: DataFrame) -> None:
        """Handles all pages that have arrived since the last call."""
        docs = pg.page_docs(pages, keep=("crawled_at",)).withColumns({
            "arrived_at": F.current_timestamp(), "crawled_day": F.to_date("crawled_at")})
        self.schema = docs.schema
        staging = docs.writeStream.format("parquet").partitionBy("crawled_day").option("path", f"{self.folder}/pages").option(
            "checkpointLocation", f"{self.folder}/pages-checkpoint").trigger(availableNow=True).start()
        staging.awaitTermination()
        staged = self.spark.readStream.schema(self.schema).parquet(f"{self.folder}/pages")
        closing = closed_sessions(staged, self.gap, self.late).writeStream.outputMode("append").foreachBatch(
            self._judge).option("checkpointLocation", f"{self.folder}/results-checkpoint").trigger(availableNow=True).start()
        closing.awaitTermination()

    def _judge(self, closed: DataFrame, number: int) -> None:
        """Results of the sessions closed in one batch; the batch's number names them, so a repeat replaces them."""
        spark = closed.sparkSession
        listed, path = f"{self.folder}/closed/batch={number}", f"{self.folder}/results/batch={number}"
        closed.write.mode("overwrite").parquet(listed)  # the plan below reads it more than once
        at = spark.read.schema(closed.schema).parquet(listed).select(
            F.col("audit_id").alias("of"), "begins", "ends", "last_arrival",
            F.concat("audit_id", F.lit(" "), F.unix_micros("begins").cast("string")).alias("session"))
        first, last = at.agg(F.min(F.to_date("begins")), F.max(F.to_date("ends"))).head()
        docs = spark.read.schema(self.schema).parquet(f"{self.folder}/pages").where(
            F.col("crawled_day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
        of_session = docs.join(at, (F.col("audit_id") == F.col("of")) & (F.col("crawled_at") >= F.col("begins"))
                               & (F.col("crawled_at") < F.col("ends")) & (F.col("arrived_at") <= F.col("last_arrival")))
        of_session = of_session.withColumn("audit_id", F.col("session")).select(*docs.columns)
        check_results(AuditInputs(docs=of_session), self.only).write.mode("overwrite").parquet(path)

    def results(self) -> DataFrame:
        """One row per finished session and check, with the findings; `session` is unique for an audit's session."""
        columns = check_results(AuditInputs(docs=self.spark.createDataFrame([], self.schema)), self.only).schema
        rows = self.spark.read.schema(T.StructType([*columns.fields, T.StructField("batch", T.IntegerType())])).parquet(
            f"{self.folder}/results")
        named = rows.withColumnRenamed("audit_id", "session")
        return named.select(
            F.regexp_extract("session", r"(?s)^(.*) -?\d+$", 1).alias("audit_id"),
            F.timestamp_micros(F.regexp_extract("session", r"(-?\d+)$", 1).cast("bigint")).alias("begins"), *named.columns)

    def category_scores(self) -> DataFrame:
        rows = self.results()
        names = rows.select("session", F.col("audit_id").alias("of"), "begins").distinct()
        scores = scoring.category_scores(rows.drop("audit_id").withColumnRenamed("session", "audit_id"))
        return scores.withColumnRenamed("audit_id", "session").join(names, "session").withColumnRenamed("of", "audit_id")


def closed_sessions(pages: DataFrame, gap: str, late: str) -> DataFrame:
    """Sessions of an audit's pages (append mode): begin, end, pages, and when the last of them arrived."""
    return pages.withWatermark("crawled_at", late).groupBy(F.session_window("crawled_at", gap), "audit_id").agg(
        F.count("*").alias("pages"), F.max("arrived_at").alias("last_arrival")).select(
        "audit_id", F.col("session_window.start").alias("begins"), F.col("session_window.end").alias("ends"), "pages", "last_arrival")
