"""Audits compared: with the one before, with a rival, with the whole peer group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscore.operators.scoring import _case
from crawlscore.operators.treatment import SEVERITY_RANK, problems


def last_known(rows: DataFrame, keys: list[str], at: str, value: str, output: str,
               inclusive: bool, bucket_unit: str = "hour") -> DataFrame:
    """The latest non-null `value` at earlier times of the same keys (as-of look-back).

    `rows` has one row per keys and time. A key may own a third of all rows, so no window
    spans a key: rows are windowed per key and time bucket, and what a bucket inherits comes
    from a table with one row per key and bucket, whose length is the history's length in
    buckets, however many rows there are.
    """
    upto = 0 if inclusive else -1
    inner = Window.partitionBy(*keys, "__bucket").orderBy(at).rowsBetween(
        Window.unboundedPreceding, upto)
    placed = rows.withColumn("__bucket", F.date_trunc(bucket_unit, F.col(at)))
    inside = placed.withColumn("__inside", F.last(value, ignorenulls=True).over(inner))
    ends = placed.groupBy(*keys, "__bucket").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.col(at))).alias("__last"))
    outer = Window.partitionBy(*keys).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    before = ends.select(
        *keys, "__bucket", F.last("__last", ignorenulls=True).over(outer).alias("__before"))
    return inside.join(before, [*keys, "__bucket"]).withColumn(
        output, F.coalesce("__inside", "__before")).drop("__bucket", "__inside", "__before")


def previous_audits(checkups: DataFrame) -> DataFrame:
    """Each audit with the nearest earlier finished audit of the same address.

    Equal times are not earlier, so the rows of one instant are brought together first.
    """
    instants = checkups.groupBy("url", "created_at").agg(
        F.max(F.when(F.col("status") == "done", F.struct("id", "health_score"))).alias("done"))
    found = last_known(instants, ["url"], "created_at", "done", "previous", inclusive=False)
    return checkups.join(found.select("url", "created_at", "previous"), ["url", "created_at"]).select(
        "id", "url", "created_at", "status", "health_score",
        F.col("previous.id").alias("previous_id"),
        F.col("previous.health_score").alias("previous_score"),
    )


def problems_by_check(findings: DataFrame) -> DataFrame:
    """The most serious problem of each check; the first one wins ties."""
    rank = F.struct(_case("severity", SEVERITY_RANK), "check_ord", "finding_ord")
    return problems(findings).groupBy("audit_id", "check_id").agg(
        F.min_by(F.struct("severity", "code", "message", "category"), rank).alias("worst")
    ).select("audit_id", "check_id", "worst.severity", "worst.code", "worst.message",
             "worst.category")


def score_change(before: Column, after: Column) -> Column:
    """struct(delta, direction, size); the direction is 'same' when one is not measured."""
    delta = after - before
    sure = F.coalesce(delta, F.lit(0))
    return F.struct(
        delta.alias("delta"),
        F.when(sure > 0, "up").when(sure < 0, "down").otherwise("same").alias("direction"),
        F.abs(sure).alias("size"),
    )


def changes(pairs: DataFrame, findings: DataFrame, results: DataFrame) -> DataFrame:
    """Every problem before and now as fixed, still, new or newly_checked.

    `pairs` has audit_id and previous_id. Rows per audit are as many as there are checks.
    """
    worst = problems_by_check(findings).select("audit_id", "check_id", "severity")
    now = pairs.join(worst, "audit_id").select(
        "audit_id", "previous_id", "check_id", F.col("severity").alias("now_severity"))
    old = pairs.join(
        worst.withColumnRenamed("audit_id", "previous_id"), "previous_id").select(
        "audit_id", "previous_id", "check_id", F.col("severity").alias("old_severity"))
    known = pairs.join(
        results.select(F.col("audit_id").alias("previous_id"), "check_id").distinct(),
        "previous_id").select("audit_id", "check_id", F.lit(True).alias("known"))
    both = now.join(old, ["audit_id", "previous_id", "check_id"], "full_outer")
    label = (
        F.when(F.col("now_severity").isNull(), "fixed")
        .when(F.coalesce("known", F.lit(False)) & F.col("old_severity").isNull(), "new")
        .when(F.col("old_severity").isNotNull(), "still")
        .otherwise("newly_checked")
    )
    return both.join(known, ["audit_id", "check_id"], "left").select(
        "audit_id", "previous_id", "check_id", label.alias("change"),
        F.coalesce("now_severity", "old_severity").alias("severity"))


def leader(ours: Column, theirs: Column) -> Column:
    return F.when(ours.isNull() | theirs.isNull() | (ours == theirs), "tie").when(
        ours > theirs, "ours").otherwise("theirs")


def rival_scores(pairs: DataFrame, categories: DataFrame) -> DataFrame:
    """Category scores side by side. `pairs` has audit_id and rival_id."""
    ours = pairs.join(categories.select("audit_id", "category", F.col("score").alias("ours")),
                      "audit_id")
    theirs = categories.select(
        F.col("audit_id").alias("rival_id"), "category", F.col("score").alias("theirs"))
    return ours.join(theirs, ["rival_id", "category"], "left").select(
        "audit_id", "rival_id", "category", "ours", "theirs",
        leader(F.col("ours"), F.col("theirs")).alias("leader"))


def rival_counts(side_by_side: DataFrame) -> DataFrame:
    return side_by_side.groupBy("audit_id", "rival_id").agg(
        F.count_if(F.col("leader") == "ours").alias("ahead"),
        F.count_if(F.col("leader") == "theirs").alias("behind"))


def solved(pairs: DataFrame, findings: DataFrame, results: DataFrame) -> DataFrame:
    """Checks both sides had, where only one side has a problem: who solved it."""
    worst = problems_by_check(findings).select("audit_id", "check_id", F.lit(True).alias("bad"))
    had = results.select("audit_id", "check_id").distinct().join(
        worst, ["audit_id", "check_id"], "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    ours = pairs.join(had.withColumnRenamed("bad", "our_problem"), "audit_id")
    both = ours.join(
        had.select(F.col("audit_id").alias("rival_id"), "check_id",
                   F.col("bad").alias("their_problem")), ["rival_id", "check_id"])
    return both.where("our_problem <> their_problem").select(
        "audit_id", "rival_id", "check_id",
        F.when(F.col("our_problem"), "they").otherwise("we").alias("solved_by"))


def peer_ranks(categories: DataFrame, group: str = "peer_group") -> DataFrame:
    """Rank, percent rank and quartile of each audit in its group and category.

    Ranks come from the counts per score value: a score has at most 101 values, so a group
    of any size is ranked by windows over at most 101 counted rows, never over its audits.
    """
    scored = categories.where("score IS NOT NULL")
    counts = scored.groupBy(group, "category", "score").agg(F.count("*").alias("n"))
    better = Window.partitionBy(group, "category").orderBy(F.desc("score"))
    worse = Window.partitionBy(group, "category").orderBy("score")
    whole = Window.partitionBy(group, "category")
    ranked = counts.select(
        group, "category", "score",
        (F.sum("n").over(better) - F.col("n") + 1).alias("rank"),
        F.dense_rank().over(better).alias("dense_rank"),
        (F.sum("n").over(worse) - F.col("n")).alias("below"),
        F.sum("n").over(whole).alias("peers"),
    )
    percent = F.when(F.col("peers") > 1, F.col("below") / (F.col("peers") - 1)).otherwise(0.0)
    ranks = ranked.select(
        group, "category", "score", "rank", "dense_rank", "peers",
        percent.alias("percent_rank"),
        F.least(F.lit(4), F.floor(percent * 4).cast("int") + 1).alias("quartile"),
    )
    return scored.join(ranks, [group, "category", "score"])
