"""Scores: findings to checks, checks to categories, categories to one number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import text as tx


def _case(column: str, values: dict) -> Column:
    expression = None
    for name, value in values.items():
        hit = F.col(column) == name
        expression = F.when(hit, value) if expression is None else expression.when(hit, value)
    return expression


def severity_score(severity: str = "severity") -> Column:
    return _case(severity, fv.SEVERITY_SCORES)


def worst_scores(findings: DataFrame) -> DataFrame:
    """Score of the worst finding per audit and check."""
    return findings.groupBy("audit_id", "check_id").agg(
        F.min(severity_score()).alias("score"))


def final_score(partial: Column, worst: Column) -> Column:
    """A partial score wins over the worst finding; both stay within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(partial, worst, F.lit(1.0))))


def high_impact_fails(findings: DataFrame) -> DataFrame:
    """Audits and categories with a serious high-impact problem."""
    return findings.groupBy("audit_id", "category").agg(
        F.bool_or((F.col("severity") == "fail") & (F.col("impact") == "high")).alias("capped"))


def category_scores(results: DataFrame) -> DataFrame:
    """Five rows per audit, also where nothing ran.

    `results` has one row per audit and check, with a mark for serious high-impact problems.
    Rows of all categories are added row-locally (an array per audit), so no join with a
    dimension is needed.
    """
    ran = (F.col("status") == "ran") & F.col("score").isNotNull()
    per = results.groupBy("audit_id", "category").agg(
        F.sum(F.when(ran, F.col("weight") * F.col("score"))).alias("weighted"),
        F.sum(F.when(ran, F.col("weight"))).alias("weight"),
        F.count_if(ran).alias("checks_run"),
        F.count_if(F.col("status") != "ran").alias("checks_skipped"),
        F.bool_or(ran & F.col("high_impact_fail")).alias("capped"),
        F.min(F.when((F.col("status") != "ran") & (F.col("note") != ""),
                     F.struct("check_ord", "note"))).alias("first_note"),
    )
    per_audit = per.groupBy("audit_id").agg(F.map_from_entries(F.collect_list(F.struct(
        "category", F.struct(*[c for c in per.columns if c not in ("audit_id", "category")]))))
        .alias("by_category"))  # five entries at most
    names = ", ".join(f"'{c}'" for c in fv.CATEGORIES)
    rows = per_audit.selectExpr(
        "audit_id", f"posexplode(array({names})) AS (category_ord, category)", "by_category")
    found = F.try_element_at("by_category", F.col("category"))
    raw = tx.round_half_up(F.lit(100) * found["weighted"] / found["weight"])
    score = F.when(found["capped"], F.least(raw, F.lit(fv.HIGH_IMPACT_FAIL_CAP))).otherwise(raw)
    return rows.select(
        "audit_id", "category", "category_ord", score.alias("score"), tx.band(score).alias("band"),
        F.coalesce(found["checks_run"], F.lit(0)).alias("checks_run"),
        F.coalesce(found["checks_skipped"], F.lit(0)).alias("checks_skipped"),
        F.when(score.isNull(), F.coalesce(found["first_note"]["note"], F.lit(fv.NOTE_NOT_CHECKED)))
        .otherwise("").alias("note"),
    )


def health_scores(categories: DataFrame) -> DataFrame:
    """Weighted mean of the scored categories; weights re-balance when one is missing."""
    weight = _case("category", fv.CATEGORY_WEIGHTS)
    scored = F.col("score").isNotNull()
    health = categories.groupBy("audit_id").agg(
        tx.round_half_up(
            F.sum(F.when(scored, weight * F.col("score"))) / F.sum(F.when(scored, weight))
        ).alias("health_score"))
    return health.withColumn("health_band", tx.band(F.col("health_score")))


def wide_scores(categories: DataFrame) -> DataFrame:
    """One row per audit with a score column per category."""
    return categories.groupBy("audit_id").pivot("category", fv.CATEGORIES).agg(F.first("score"))
