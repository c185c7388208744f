"""Scores, plans, comparisons and sinks on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from crawlscore.operators import comparison as cp
from crawlscore.operators import history as hs
from crawlscore.operators import scoring as sc
from crawlscore.operators import treatment as tr
from crawlscore.sources import sinks

RESULTS = ("audit_id string, check_id string, category string, check_ord int, weight int, status string, "
           "score double, note string, high_impact_fail boolean")
FINDINGS = ("audit_id string, check_id string, category string, check_ord int, finding_ord int, code string, "
            "severity string, impact string, effort string, message string")


def results(spark, *rows):
    return spark.createDataFrame(
        [("a", f"seo.c{i}", cat, i, w, st, s, n, h) for i, (cat, w, st, s, n, h) in enumerate(rows)], RESULTS)


def scores(df):
    return {r.category: (r.score, r.note) for r in sc.category_scores(df).collect()}


def test_category_score_and_cap(spark):
    got = scores(results(
        spark, ("seo", 8, "ran", 1.0, "", False), ("seo", 2, "ran", 0.5, "", False),
        ("seo", 9, "skipped", None, "No data.", False), ("agentic", 5, "skipped", None, "No probe.", False)))
    assert got["seo"] == (90, "") and got["agentic"] == (None, "No probe.")
    assert got["performance"] == (None, "Not checked.") and len(got) == 5
    assert scores(results(spark, ("seo", 1, "ran", 1.0, "", True)))["seo"] == (89, "")


@pytest.mark.parametrize("values, want", [
    ((40, 80, 100, 60, 20), 62), ((None, 80, 100, 60, 20), 69), ((None,) * 5, None)])
def test_health_score_rebalances(spark, values, want):
    names = ["performance", "seo", "best_practices", "accessibility", "agentic"]
    df = spark.createDataFrame([("a", n, v) for n, v in zip(names, values)],
                               "audit_id string, category string, score int")
    assert sc.health_scores(df).head().health_score == want


def finding(n, severity, impact, effort, audit="a", check=None):
    return (audit, check or f"seo.c{n}", "seo", n, 1, f"k{n}", severity, impact, effort, f"m{n}")


def test_plan_order(spark):
    df = spark.createDataFrame([
        finding(1, "warn", "low", "low"), finding(2, "fail", "high", "high"),
        finding(3, "fail", "medium", "low"), finding(4, "warn", "high", "low"),
        finding(5, "warn", "medium", "medium"), finding(6, "info", "high", "low")], FINDINGS)
    rows = tr.treatment_plan(df).orderBy("plan_ord").collect()
    assert [r.code for r in rows] == ["k4", "k3", "k2", "k5", "k1"]
    assert [r.quick_win for r in rows] == [True, True, False, False, False]
    assert [r.code for r in tr.top_risks(df).orderBy("risk_ord").collect()] == ["k2", "k4", "k3"]


def test_changes(spark):
    df = spark.createDataFrame([
        finding(1, "fail", "high", "low", "old", "seo.title"), finding(2, "warn", "low", "low", "old", "seo.meta"),
        finding(2, "warn", "low", "low", "new", "seo.meta"), finding(3, "warn", "low", "low", "new", "seo.h1"),
        finding(4, "fail", "low", "low", "new", "seo.fresh")], FINDINGS)
    ran = spark.createDataFrame(
        [("old", c) for c in ("seo.title", "seo.meta", "seo.h1")], "audit_id string, check_id string")
    pairs = spark.createDataFrame([("new", "old")], "audit_id string, previous_id string")
    got = {r.check_id: r.change for r in cp.changes(pairs, df, ran).collect()}
    assert got == {"seo.title": "fixed", "seo.meta": "still", "seo.h1": "new", "seo.fresh": "newly_checked"}


@pytest.mark.parametrize("before, after, want", [
    (60, 72, (12, "up", 12)), (72, 60, (-12, "down", 12)), (60, 60, (0, "same", 0)), (None, 60, (None, "same", 0))])
def test_score_change(spark, before, after, want):
    df = spark.createDataFrame([(before, after)], "b int, a int")
    row = df.select(cp.score_change(F.col("b"), F.col("a")).alias("x")).head().x
    assert tuple(row) == want


def test_previous_audit_across_buckets_matches_brute_force(spark):
    rows = [(i, f"u{i % 2 if i % 3 else 0}", "done" if i % 4 else "failed", i * 1700, i % 100) for i in range(400)]
    df = spark.createDataFrame(rows, "id bigint, url string, status string, s bigint, health_score int").withColumn(
        "created_at", F.timestamp_seconds("s"))
    got = {r.id: r.previous_id for r in cp.previous_audits(df).collect()}
    for i, url, _, at, _ in rows:
        earlier = [(a, j) for j, u, st, a, _ in rows if u == url and st == "done" and a < at]
        assert got[i] == (max(earlier)[1] if earlier else None)


def test_rate_limit_matches_brute_force(spark):
    rows = [(i, "v" if i % 5 else "w", "done", i * 311) for i in range(300)]
    df = spark.createDataFrame(rows, "id bigint, ip_hash string, status string, s bigint").withColumns(
        {"created_at": F.timestamp_seconds("s"), "started_at": F.timestamp_seconds("s")})
    got = {r.id: r.in_last_hour for r in hs.over_rate_limit(df, 5).collect()}
    want = {}
    for i, visitor, _, at in rows:
        n = sum(1 for _, v, _, a in rows if v == visitor and at - 3600 <= a < at)
        if n >= 5:
            want[i] = n
    assert got == want


def test_findings_are_replaced_per_audit(spark, tmp_path):
    path = str(tmp_path / "findings")
    first = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "audit_id string, n int")
    sinks.replace_findings(first, path)
    sinks.replace_findings(spark.createDataFrame([("a", 9)], "audit_id string, n int"), path)
    assert sorted((r.audit_id, r.n) for r in spark.read.parquet(path).collect()) == [("a", 9), ("b", 3)]


def test_reports_survive_a_round_trip(spark, tmp_path):
    """The stored findings are enough to compare two reports."""
    kind = ("array<struct<finding_ord:int,code:string,severity:string,impact:string,effort:string,"
            "affected:bigint,message:string>>")

    def stored(day, *severities):
        table = results(spark, ("seo", 8, "ran", 1.0, "", False), ("seo", 2, "ran", 0.5, "", False),
                        ("agentic", 1, "skipped", None, "No.", False))
        found = ", ".join(f"named_struct('finding_ord', {i}, 'code', 'c{i}', 'severity', '{s}', 'impact', 'low', "
                          f"'effort', 'low', 'affected', {i}L, 'message', 'it''s \"{i}\"')" for i, s in enumerate(severities))
        table = table.withColumn("findings", F.expr(f"CASE WHEN check_id = 'seo.c0' THEN array({found}) END").cast(kind))
        categories = sc.category_scores(table)
        path = str(tmp_path / "reports" / day)
        sinks.write_reports(sinks.reports(table, categories, sc.health_scores(categories)), path, day)
        return sinks.read_reports(spark, path)

    [row] = stored("2026-01-01", "fail", "info").collect()
    assert len(row.categories) == 5 and len(row.results) == 3 and row.health_score is not None
    rows = sinks.findings_of(stored("2026-01-02", "fail", "info")).collect()
    assert [(r.check_id, r.category, r.code, r.severity, r.affected, r.message) for r in rows] == [
        ("seo.c0", "seo", "c0", "fail", 0, 'it\'s "0"'), ("seo.c0", "seo", "c1", "info", 1, 'it\'s "1"')]
    worst = cp.problems_by_check(sinks.findings_of(stored("2026-01-03", "info", "warn"))).collect()
    assert [(r.check_id, r.code) for r in worst] == [("seo.c0", "c1")]
