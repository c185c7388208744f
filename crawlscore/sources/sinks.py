"""Reports and findings on disk, and reading reports back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.functions.text import safe_cell
from crawlscore.operators import ranking
from crawlscore.session import materialise

REPORT_DDL = (
    "audit_id string, health_score int, health_band string, categories array<struct<category:"
    "string,score:int,band:string,checks_run:bigint,checks_skipped:bigint,note:string>>, results "
    "array<struct<check_id:string,status:string,score:double,note:string,findings:array<struct<finding_ord:int,"
    "code:string,severity:string,impact:string,effort:string,affected:bigint,message:string>>>>, snippets array<struct<check_id:string,title:string,code:string,note:string>>, "
    "elements array<struct<check_id:string,code:string,page:string,selector:string,match_tag:string,match_attr:string,"
    "match_value:string,match_text:string,label:string>>"
)
_ELEMENTS = REPORT_DDL[REPORT_DDL.index(", elements ") + len(", elements "):]
FINDING_BUCKETS = 64


def reports(results: DataFrame, category_scores: DataFrame, health: DataFrame, snippets: DataFrame | None = None,
            shown: DataFrame | None = None) -> DataFrame:
    """One nested document per audit. The lists hold the categories, the checks of the catalogue and
    what these found, the `snippets` for them, and the first elements of each (`shown`, findings with `shots`), so
    their length is bounded by the catalogue, whatever the size of the site."""
    checks = results.groupBy("audit_id").agg(F.expr(
        "transform(array_sort(collect_list(struct(check_ord, check_id, status, score, note, findings))), "
        "r -> struct(r.check_id AS check_id, r.status AS status, r.score AS score, r.note AS note, "
        "r.findings AS findings))"
    ).alias("results"))
    categories = category_scores.groupBy("audit_id").agg(F.expr(
        "transform(array_sort(collect_list(struct(category_ord, category, score, band, checks_run, "
        "checks_skipped, note))), c -> struct(c.category AS category, c.score AS score, c.band AS "
        "band, c.checks_run AS checks_run, c.checks_skipped AS checks_skipped, c.note AS note))"
    ).alias("categories"))
    whole = health.join(categories, "audit_id").join(checks, "audit_id")
    if snippets is None:
        whole = whole.withColumn("snippets", F.lit(None).cast("array<struct<check_id:string,title:string,code:string,note:string>>"))
    else:
        whole = whole.join(snippets.groupBy("audit_id").agg(F.expr(
            "transform(array_sort(collect_list(struct(check_id, snippet_ord, title, code, note))), "
            "s -> struct(s.check_id AS check_id, s.title AS title, s.code AS code, s.note AS note))").alias("snippets")), "audit_id", "left")
    if shown is None:
        whole = whole.withColumn("elements", F.lit(None).cast(_ELEMENTS))
    else:
        whole = whole.join(shown.where("size(shots) > 0").groupBy("audit_id").agg(F.expr(
            "flatten(transform(array_sort(collect_list(struct(check_ord, finding_ord, check_id, code, shots))), f -> transform(f.shots, "
            "s -> struct(f.check_id AS check_id, f.code AS code, s.page AS page, s.selector AS selector, s.match_tag AS match_tag, "
            "s.match_attr AS match_attr, s.match_value AS match_value, s.match_text AS match_text, s.label AS label))))"
        ).alias("elements")), "audit_id", "left")
    return whole.select("audit_id", "health_score", "health_band", "categories", "results", "snippets", "elements")


def write_reports(reports_df: DataFrame, path: str, day: str, format: str = "json") -> None:
    """Reports of one day; writing a day again replaces just that day."""
    writer = reports_df.withColumn("day", F.lit(day)).write.partitionBy("day")
    writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(format).save(path)


def findings_of(reports_df: DataFrame) -> DataFrame:
    """The findings of stored reports as rows, in the order of their checks."""
    checks = reports_df.selectExpr("audit_id", "posexplode(results) AS (check_ord, r)")
    return checks.selectExpr("audit_id", "check_ord", "r.check_id", "split_part(r.check_id, '.', 1) AS category",
                             "r.status", "inline(r.findings)")


def with_bucket(findings: DataFrame, buckets: int = FINDING_BUCKETS) -> DataFrame:
    return findings.withColumn("bucket", F.pmod(F.xxhash64("audit_id"), F.lit(buckets)))


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def replace_findings(findings: DataFrame, path: str, buckets: int = FINDING_BUCKETS) -> None:
    """Replace all findings of the audits at hand; other audits keep theirs.

    Only the buckets that hold one of these audits are read and rewritten: the old rows of
    other audits in them are carried over by an anti join, then the partitions are swapped.
    The new content is staged in a sibling table first, so no file is read while replaced. `buckets` is
    that of the first write; more of them make smaller rewrites.
    """
    spark = findings.sparkSession
    fresh = with_bucket(findings, buckets)
    if not _exists(spark, path):
        fresh.write.partitionBy("bucket").parquet(path)
        return
    old = spark.read.parquet(path)
    audits = fresh.select("audit_id", "bucket").distinct()
    kept = old.join(audits.select("bucket").distinct(), "bucket", "left_semi").join(
        audits.select("audit_id"), "audit_id", "left_anti")
    staged = materialise(kept.select(*fresh.columns).unionByName(fresh), "findings-staged")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "bucket").parquet(path)


def read_reports(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Stored reports that still read; unreadable old ones are left out."""
    if format != "json":
        return spark.read.format(format).load(path)
    raw = spark.read.text(path)
    return parse_reports(raw, "value")


def parse_reports(raw: DataFrame, column: str) -> DataFrame:
    parsed = F.from_json(
        column, REPORT_DDL + ", _corrupt_record string",
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    rows = raw.select(parsed.alias("r")).where(
        "r._corrupt_record IS NULL AND r.audit_id IS NOT NULL")
    return rows.select("r.audit_id", "r.health_score", "r.health_band", "r.categories", "r.results", "r.snippets", "r.elements")


def leads_export(leads: DataFrame, checkups: DataFrame) -> DataFrame:
    """Rows of the lead list: newest audit first, cells safe for spreadsheets.

    A lead's domains end up in one cell, which is what the export is; the audits of one
    person are few, and a row longer than a spreadsheet cell can only come from misuse.
    """
    own = checkups.where("lead_id IS NOT NULL").groupBy("lead_id").agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(created_at, id, domain)), "
               "(a, b) -> CASE WHEN a.created_at > b.created_at THEN -1 WHEN a.created_at < "
               "b.created_at THEN 1 WHEN a.id > b.id THEN -1 WHEN a.id < b.id THEN 1 ELSE 0 END), "
               "x -> x.domain), ' ')").alias("domains"),
        F.max_by("health_score", F.struct("created_at", "id")).alias("latest"),
    )
    return leads.join(own, leads["id"] == own["lead_id"], "left").select(
        safe_cell(F.col("name")).alias("name"),
        safe_cell(F.col("email")).alias("email"),
        F.when(F.col("consent"), "yes").otherwise("no").alias("consent"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        safe_cell(F.col("domains")).alias("websites"),
        F.coalesce(F.col("latest").cast("string"), F.lit("")).alias("latest_health_score"),
    )


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def lead_sites(leads: DataFrame, checkups: DataFrame) -> DataFrame:
    """The lead list as rows: one per lead and audited website, ranked newest first, with the lead's cells and newest
    score on each; a lead without audits has one row without rank and website."""
    sites = ranking.ranked(
        checkups.where("lead_id IS NOT NULL").select("lead_id", "domain", "health_score", "created_at", "id"),
        ["lead_id"], ["created_at", "id"], descending=True)
    newest = sites.where("rank = 1").select(F.col("lead_id").alias("of"), F.col("health_score").alias("latest"))
    cells = leads.join(newest, leads["id"] == newest["of"], "left").select(
        F.col("id").alias("lead_id"), safe_cell(F.col("name")).alias("name"), safe_cell(F.col("email")).alias("email"),
        F.when(F.col("consent"), "yes").otherwise("no").alias("consent"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"),
        F.coalesce(F.col("latest").cast("string"), F.lit("")).alias("latest_health_score"))
    return cells.join(sites.select("lead_id", "rank", F.col("domain").alias("website")), "lead_id", "left")


CSV_COLUMNS = ["name", "email", "consent", "created_at", "latest_health_score", "websites"]


def write_lead_csv(rows: DataFrame, folder: str) -> DataFrame:
    """The rows of `lead_sites` as CSV, a lead's websites in the last cell of its line; the written pieces in order.

    The rows are dealt out by range of (lead, rank), and each task streams its sorted rows to one piece: the first row of
    a lead writes its cells, every row its website, the last one the line's end. So a cell may span pieces, and no
    task holds a lead. The pieces, one after another in the order of `piece`, are the file; only those listed count.
    """
    last = rows.groupBy("lead_id").agg(F.max("rank").alias("last"))
    known = rows.join(last.withColumnRenamed("lead_id", "of"), F.col("lead_id") == F.col("of"), "left").drop("of")
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')), F.lit('",')) for c in CSV_COLUMNS[:-1]]
    site = F.replace(F.coalesce("website", F.lit("")), F.lit('"'), F.lit('""'))
    starts, ends = F.coalesce(F.col("rank") == 1, F.lit(True)), F.coalesce(F.col("rank") == F.col("last"), F.lit(True))
    bare = F.when(F.col("website").rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), site)).otherwise(site)
    text = F.concat(F.when(starts, F.concat(*quoted, F.lit('"'), bare)).otherwise(F.concat(F.lit(" "), site)),
                    F.when(ends, F.lit('"\r\n')).otherwise(F.lit("")))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = known.select("lead_id", "rank", text.alias("text")).repartitionByRange(
        parts, F.col("lead_id").asc_nulls_first(), F.col("rank").asc_nulls_first()).sortWithinPartitions(
        F.col("lead_id").asc_nulls_first(), F.col("rank").asc_nulls_first()).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        piece = context.partitionId() if context else 0
        system, base = fs.FileSystem.from_uri(folder)
        name, size, target = f"{base.rstrip('/')}/piece-{piece:05d}-{uuid.uuid4().hex}.csv", 0, None
        for batch in batches:
            if target is None:
                system.create_dir(base, recursive=True)
                target = system.open_output_stream(name)
            for part in batch.column("text").to_pylist():
                size += target.write(part.encode())
        if target is not None:
            target.close()
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([name]), pa.array([size], pa.int64())],
                                             names=["piece", "file", "size"])

    return materialise(dealt.mapInArrow(run, "piece int, file string, size bigint"), "csv-pieces")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """One file for each row (name, content), written by the row's task; the paths, as a written table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        for batch in batches:
            paths = []
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                paths.append(f"{base.rstrip('/')}/{name}")
                with system.open_output_stream(paths[-1]) as target:
                    target.write(content)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], names=["path"])

    return materialise(rows.select("name", "content").mapInArrow(run, "path string"), "files-written")
