"""What to fix first, and how long it takes.

The findings of one audit are as many as the checks can give, not as many as its pages, so
the ranking windows per audit are small however large the site is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import text as tx
from crawlscore.operators import ranking
from crawlscore.operators.scoring import _case

PROBLEMS = ["fail", "warn"]
IMPACT_RANK = {"high": 0, "medium": 1, "low": 2}
EFFORT_RANK = {"low": 0, "medium": 1, "high": 2}
SEVERITY_RANK = {"fail": 0, "warn": 1, "info": 2}
REPORT_ORDER = ["check_ord", "finding_ord"]


def problems(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("severity").isin(PROBLEMS))


def quick_win() -> Column:
    return F.col("impact").isin("high", "medium") & (F.col("effort") == "low")


def treatment_plan(findings: DataFrame) -> DataFrame:
    """Problems in the order to fix them: quick wins, impact, effort, severity."""
    order = Window.partitionBy("audit_id").orderBy(
        F.when(quick_win(), 0).otherwise(1), _case("impact", IMPACT_RANK),
        _case("effort", EFFORT_RANK), _case("severity", SEVERITY_RANK), *REPORT_ORDER)
    return problems(findings).withColumns({
        "quick_win": quick_win(), "plan_ord": F.row_number().over(order)})


def top_risks(findings: DataFrame, count: int = 3) -> DataFrame:
    """The problems that hurt most: impact, severity, weight of the category."""
    order = Window.partitionBy("audit_id").orderBy(
        _case("impact", IMPACT_RANK), _case("severity", SEVERITY_RANK),
        -_case("category", fv.CATEGORY_WEIGHTS), *REPORT_ORDER)
    return problems(findings).withColumn("risk_ord", F.row_number().over(order)).where(
        F.col("risk_ord") <= count)


def vital_signs(findings: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category: problems in order, notes, healthy points, a headline."""
    problem = F.col("severity").isin(PROBLEMS)
    entry = F.struct(
        _case("severity", SEVERITY_RANK).alias("s"), _case("impact", IMPACT_RANK).alias("i"),
        "check_ord", "finding_ord", F.concat_ws("/", "check_id", "code").alias("name"))
    plain = F.struct(
        "check_ord", "finding_ord", F.concat_ws("/", "check_id", "code").alias("name"))

    def names(condition: Column, value: Column) -> Column:
        listed = F.array_sort(F.collect_list(F.when(condition, value)))
        return F.transform(listed, lambda x: x["name"])

    signs = findings.groupBy("audit_id", "category").agg(
        names(problem, entry).alias("problems"),
        names(F.col("severity") == "info", plain).alias("notes"),
        names(F.col("severity") == "pass", plain).alias("healthy"),
        F.count_if(F.col("severity") == "fail").alias("serious"),
    )
    joined = categories.select("audit_id", "category", "category_ord", "score").join(
        signs, ["audit_id", "category"], "left")
    empty = F.array().cast("array<string>")
    filled = joined.withColumns({
        **{c: F.coalesce(c, empty) for c in ("problems", "notes", "healthy")},
        "serious": F.coalesce("serious", F.lit(0)),
    })
    count, serious = F.size("problems"), F.col("serious")
    issues = F.when(count == 1, "1 issue").otherwise(F.concat(count.cast("string"), F.lit(" issues")))
    headline = (
        F.when(F.col("score").isNull(), fv.HEADLINE_NOT_CHECKED)
        .when(count == 0, fv.HEADLINE_HEALTHY)
        .when(serious > 0, F.concat(
            issues, F.lit(" found; "),
            F.when(serious == 1, "1 needs").otherwise(
                F.concat(serious.cast("string"), F.lit(" need"))), F.lit(" treatment.")))
        .otherwise(F.concat(issues, F.lit(" worth fixing.")))
    )
    return filled.withColumn("headline", headline)


def vital_sign_rows(findings: DataFrame) -> DataFrame:
    """The findings of each category as ranked rows: kind (problem, note or healthy), rank within it, check and code.

    The same order as the lists of `vital_signs`, for categories with more findings than a row should hold.
    """
    problem = F.col("severity").isin(PROBLEMS)
    kind = F.when(problem, "problem").when(F.col("severity") == "info", "note").when(F.col("severity") == "pass", "healthy")
    rows = findings.select(
        "audit_id", "category", kind.alias("kind"), F.when(problem, _case("severity", SEVERITY_RANK)).alias("by_severity"),
        F.when(problem, _case("impact", IMPACT_RANK)).alias("by_impact"), "check_ord", "finding_ord",
        F.concat_ws("/", "check_id", "code").alias("name")).where("kind IS NOT NULL")
    ranked = ranking.ranked(rows, ["audit_id", "category", "kind"], ["by_severity", "by_impact", "check_ord", "finding_ord"])
    return ranked.select("audit_id", "category", "kind", "rank", "name")


def issue_rows(findings: DataFrame) -> DataFrame:
    """Quick wins, other problems, then notes; each with a key stable within its report."""
    plan = treatment_plan(findings).select(
        "audit_id", "check_id", "code", "severity", "quick_win", "category",
        F.when(F.col("quick_win"), 0).otherwise(1).alias("part"),
        F.struct(F.col("plan_ord").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b"),
                 F.lit(0).cast("bigint").alias("c")).alias("place"))
    place = F.struct(
        _case("category", {c: i for i, c in enumerate(fv.CATEGORIES)}).cast("bigint").alias("a"),
        F.col("check_ord").cast("bigint").alias("b"), F.col("finding_ord").cast("bigint").alias("c"))
    notes = findings.where("severity = 'info'").select(
        "audit_id", "check_id", "code", "severity", F.lit(False).alias("quick_win"), "category",
        F.lit(2).alias("part"), place.alias("place"))
    rows = plan.unionByName(notes)
    base = F.translate("check_id", "._", "--")
    numbered = rows.withColumns({
        "issue_ord": F.row_number().over(
            Window.partitionBy("audit_id").orderBy("part", "place")),
        "n": F.row_number().over(
            Window.partitionBy("audit_id", "check_id").orderBy("part", "place")),
    })
    return numbered.select(
        "audit_id", "issue_ord", F.concat(base, F.lit("-"), F.col("n")).alias("key"), "check_id",
        "code", "category", "severity", "quick_win")


def counters(findings: DataFrame) -> DataFrame:
    """Counts for the overview, per audit."""
    return findings.groupBy("audit_id").agg(
        F.count_if(F.col("severity") == "fail").alias("needs_treatment"),
        F.count_if(F.col("severity") == "warn").alias("worth_fixing"),
        F.count_if(F.col("severity") == "pass").alias("healthy"),
        F.count_if(F.col("severity") == "info").alias("notes"),
    )


def issue_totals(findings: DataFrame) -> DataFrame:
    """Issues per category and severity with subtotals and a grand total."""
    return findings.where("severity <> 'pass'").rollup("category", "severity").agg(
        F.count("*").alias("issues"))


def verdicts(counts: DataFrame, health: DataFrame) -> DataFrame:
    """The one sentence to remember about each audit."""
    serious, total = F.col("needs_treatment"), F.col("needs_treatment") + F.col("worth_fixing")
    weighty = F.when(serious == 1, fv.SERIOUS_ONE).otherwise(
        F.concat(serious.cast("string"), F.lit(fv.SERIOUS_MANY)))

    def around(words: tuple[str, str], middle: Column) -> Column:
        return F.concat(F.lit(words[0]), middle, F.lit(words[1]))

    verdict = (
        F.when((F.col("health_band") == "healthy") & (total == 0), fv.VERDICT_EXCELLENT)
        .when(F.col("health_band") == "healthy", fv.VERDICT_GOOD)
        .when(F.col("health_band") == "urgent", around(fv.VERDICT_URGENT, weighty))
        .when(serious > 0, around(fv.VERDICT_WORKS, weighty))
        .otherwise(around(fv.VERDICT_ISSUES, total.cast("string")))
    )
    return health.join(counts, "audit_id", "left").fillna(
        0, ["needs_treatment", "worth_fixing"]).select("audit_id", "health_band", verdict.alias("verdict"))


def recommendations(categories: DataFrame,
                    services: list[tuple[str, list[str]]] = fv.SERVICES) -> DataFrame:
    """The most specific service for each category in need; with three or more also the
    broadest one, unless it is among them already.

    The services are a short fixed list, so they become literals; no table is joined.
    """
    specific = {
        category: min((s for s in services if category in s[1]), key=lambda s: len(s[1]))[0]
        for category in fv.CATEGORIES if any(category in s[1] for s in services)
    }
    broadest = max(services, key=lambda s: len(s[1]))[0]
    needy = categories.where(F.col("score") < fv.HEALTHY_FROM)
    chosen = needy.select(
        "audit_id", "category", "score", _case("category", specific).alias("service")
    ).where("service IS NOT NULL")  # one service per category: five rows
    per_audit = chosen.groupBy("audit_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("service") == broadest).alias("there"))
    extra = per_audit.where("n >= 3 AND NOT there").select(
        "audit_id", F.lit(None).cast("string").alias("category"),
        F.lit(None).cast("int").alias("score"), F.lit(broadest).alias("service"))
    return chosen.unionByName(extra)


def fix_minutes(effort: str = "effort") -> Column:
    return _case(effort, fv.FIX_MINUTES)


def fix_summary(findings: DataFrame) -> DataFrame:
    """Total time of an audit's problems, and the part a developer does."""
    timed = problems(findings).withColumn("minutes", fix_minutes())
    own = F.col("minutes") < 60
    sums = timed.groupBy("audit_id").agg(
        F.sum("minutes").cast("int").alias("total_minutes"),
        F.count_if(own).alias("diy_count"),
        F.coalesce(F.sum(F.when(~own, F.col("minutes"))), F.lit(0)).cast("int")
        .alias("developer_minutes"),
    )
    return sums.withColumns({
        "total": tx.duration(F.col("total_minutes")),
        "developer": tx.duration(F.col("developer_minutes")),
    })


def evidence(shots: DataFrame, count: int | None = None) -> DataFrame:
    """Elements to picture by rank: failures, then warnings, then notes; the first `count` if given.

    `shots` has audit_id, severity, check_ord, finding_ord, shot_ord. Spark's limit inside a
    window group keeps each task to its best rows before the shuffle.
    """
    order = Window.partitionBy("audit_id").orderBy(
        _case("severity", SEVERITY_RANK), "check_ord", "finding_ord", "shot_ord")
    ranked = shots.where("severity <> 'pass'").withColumn("pick", F.row_number().over(order))
    return ranked if count is None else ranked.where(F.col("pick") <= count)


def runner_notes(skipped: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Remarks on a run: why the browser failed, how many pages robots.txt kept out."""
    kept_out = skipped.groupBy("audit_id").agg(F.count("*").alias("n"))
    browser = capabilities.where("capability = 'render' AND NOT available").groupBy(
        "audit_id").agg(F.max("reason").alias("reason"))
    return kept_out.join(browser, "audit_id", "full_outer").select(
        "audit_id",
        F.array_compact(F.array(
            "reason",
            F.when(F.col("n") > 0, F.concat(
                F.lit("robots.txt keeps robots off "), F.col("n").cast("string"),
                F.lit(" page(s), which were left out."))),
        )).alias("notes"),
    )


def digest(findings: DataFrame, count: int = 3) -> DataFrame:
    """The top problem messages of each audit, in order."""
    return top_risks(findings, count).groupBy("audit_id").agg(F.expr(
        "transform(array_sort(collect_list(struct(risk_ord, message))), x -> x.message)")
        .alias("messages"))
