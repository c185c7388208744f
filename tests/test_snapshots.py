"""Versions of a findings table, ranked exports, and files scanned by their heads."""

import csv
import io

import pytest
from pyspark.sql import functions as F

from crawlscore.operators import treatment
from crawlscore.sources import payloads, sinks
from crawlscore.sources.snapshots import FindingsTable

SCHEMA = "audit_id string, n int"


def rows(df):
    return sorted((r.audit_id, r.n) for r in df.collect())


def test_a_lost_job_leaves_the_old_table_and_a_commit_the_new_one(spark, tmp_path):
    table = FindingsTable(spark, str(tmp_path / "t"), buckets=4)
    first = [(f"a{k}", k) for k in range(30)]
    assert table.replace(spark.createDataFrame(first, SCHEMA)) == 1
    staged = table.stage(spark.createDataFrame([("a3", 100), ("a3", 101), ("new", 7)], SCHEMA))
    again = FindingsTable(spark, str(tmp_path / "t"))  # as a reader after the job was lost
    assert rows(again.read()) == sorted(first)
    (tmp_path / "t" / "versions" / "draft-lost").write_text("{half a manif")
    assert again.versions() == [1] and rows(again.read()) == sorted(first)
    want = sorted([r for r in first if r[0] != "a3"] + [("a3", 100), ("a3", 101), ("new", 7)])
    assert table.commit(staged) == 2
    assert rows(again.read()) == want and rows(again.read(1)) == sorted(first)
    with pytest.raises(Exception, match="exists"):
        table.commit(staged)  # another job has made this version
    assert again.release() == [1] and rows(again.read()) == want
    with pytest.raises(Exception, match="v00000001"):
        again.read(1)


def test_empty_replacements_and_first_writes(spark, tmp_path):
    table = FindingsTable(spark, str(tmp_path / "e"))
    assert table.replace(spark.createDataFrame([], SCHEMA)) == 1 and rows(table.read()) == []
    table.replace(spark.createDataFrame([("x", 1), (None, 2)], SCHEMA))
    table.replace(spark.createDataFrame([], SCHEMA))
    assert sorted(r.n for r in table.read().collect()) == [1, 2]


@pytest.fixture(scope="module")
def leads(spark):
    people = spark.createDataFrame([(1, '=Ann "A"', "a@x", True), (2, "Bob", "b@x", False), (3, None, None, None)],
                                   "id bigint, name string, email string, consent boolean").withColumn("created_at", F.lit("2024-01-05 10:00:00").cast("timestamp"))
    audits = spark.range(5_000).selectExpr(
        "id", "if(id < 4000, 1, if(id < 4010, 2, null)) AS lead_id", "if(id % 100 = 0, concat('=s', id), concat('s', id)) AS domain",
        "CAST(id % 90 AS INT) AS health_score", "timestamp_seconds(1700000000 + (id * 7919) % 5000 DIV 2) AS created_at")
    return people, audits


def test_a_hot_lead_is_written_in_pieces(spark, tmp_path, leads):
    people, audits = leads
    ranked = sinks.lead_sites(people, audits)
    manifest = sinks.write_lead_csv(ranked, (tmp_path / "csv").as_uri()).orderBy("piece").collect()
    assert len(manifest) > 1 and max(m.size for m in manifest) < sum(m.size for m in manifest) * 0.6
    text = "".join(open(m.file, newline="").read() for m in manifest)
    got = {r[0]: r for r in csv.reader(io.StringIO(text))}
    order = {}
    for r in audits.where("lead_id IS NOT NULL").orderBy(F.desc("created_at"), F.desc("id")).collect():
        order.setdefault(r.lead_id, []).append(r)
    for lead, name in ((1, "'=Ann \"A\""), (2, "Bob")):
        cells = " ".join(r.domain for r in order[lead])
        own = got[name]
        assert own[-2] == str(order[lead][0].health_score)
        assert own[-1].replace("'=", "=") == cells
    assert got[""][1:] == ["", "no", "2024-01-05T10:00:00", "", ""]
    old = {r.name: r.websites for r in sinks.leads_export(people, audits).collect()}
    assert old["Bob"].replace("'=", "=") == got["Bob"][-1].replace("'=", "=")


def test_vital_signs_as_rows_equal_the_lists(spark):
    found = spark.range(600).selectExpr(
        "if(id < 400, 'hot', concat('a', id % 3)) AS audit_id", "'seo' AS category", "concat('seo.c', id % 9) AS check_id", "CAST(id % 9 AS INT) AS check_ord",
        "CAST(id AS INT) AS finding_ord", "'x' AS code", "element_at(array('fail', 'warn', 'info', 'pass'), CAST(id * 7 % 4 + 1 AS INT)) AS severity",
        "element_at(array('high', 'medium', 'low'), CAST(id * 5 % 3 + 1 AS INT)) AS impact")
    scores = found.select("audit_id", "category").distinct().selectExpr("*", "0 AS category_ord", "50 AS score")
    lists = {r.audit_id: {"problem": r.problems, "note": r.notes, "healthy": r.healthy} for r in treatment.vital_signs(found, scores).collect()}
    got = {}
    for r in sorted(treatment.vital_sign_rows(found).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.audit_id, {"problem": [], "note": [], "healthy": []})[r.kind].append(r.name)
    assert got == lists


def test_files_are_typed_by_their_heads(spark, tmp_path):
    heads = {"a.img": b"\xff\xd8\xff\xe0", "b.img": b"\x89PNG\r\n\x1a\n", "sub/c.img": b"GIF89a", "d.img": b"", "e.txt": b"\xff\xd8\xff"}
    (tmp_path / "sub").mkdir()
    for name, head in heads.items():
        (tmp_path / name).write_bytes(head + b"\0" * 50 if head else b"")
    got = {r.path.rsplit("/", 1)[1]: (r.type, r.length) for r in payloads.image_files(spark, str(tmp_path), "*.img").collect()}
    assert got == {"a.img": ("image/jpeg", 54), "b.img": ("image/png", 58), "c.img": ("image/gif", 56)}  # Spark scans no empty files
