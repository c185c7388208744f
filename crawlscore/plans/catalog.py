"""The check catalogue and the small fixed dimension tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.operators.checks import (
    accessibility, agentic, best_practices, performance, seo,
)
from crawlscore.operators.checks.spec import Check

BUILT_IN: list[Check] = [
    check
    for module in (performance, accessibility, best_practices, seo, agentic)
    for check in module.CHECKS
]
_registered: dict[str, Check] = {}


def register(check: Check) -> Check:
    """Add a check of one's own; its id must be new and its category known."""
    check.validate()
    if check.category not in fv.CATEGORIES:
        raise ValueError(f"{check.check_id}: unknown category")
    if check.check_id in catalogue():
        raise ValueError(f"{check.check_id}: the id is taken")
    _registered[check.check_id] = check
    return check


def unregister(check_id: str) -> None:
    _registered.pop(check_id, None)


def catalogue() -> dict[str, Check]:
    """All checks by id, ordered by category and id."""
    every = [*BUILT_IN, *_registered.values()]
    every.sort(key=lambda c: (fv.CATEGORIES.index(c.category), c.check_id))
    return {check.check_id: check for check in every}


def check_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (c.check_id, c.category, c.title, c.weight, sorted(c.requires), i)
        for i, c in enumerate(catalogue().values())
    ]
    return spark.createDataFrame(
        rows, "check_id string, category string, title string, weight int, "
              "requires array<string>, check_ord int",
    )


def category_dim(spark: SparkSession) -> DataFrame:
    rows = [
        (c, fv.CATEGORY_LABELS[c], fv.CATEGORY_WEIGHTS[c], i) for i, c in enumerate(fv.CATEGORIES)
    ]
    return spark.createDataFrame(
        rows, "category string, label string, category_weight int, category_ord int"
    )


def severity_dim(spark: SparkSession) -> DataFrame:
    rows = [(s, v, i) for i, (s, v) in enumerate(
        sorted(fv.SEVERITY_SCORES.items(), key=lambda x: (x[1], x[0] == "pass")))]
    return spark.createDataFrame(rows, "severity string, severity_score double, severity_rank int")


def rank_of(column: str, order: list[str]) -> Column:
    """Position of a level name in a fixed order, as a column."""
    expression = F.when(F.col(column) == order[0], 0)
    for position, name in enumerate(order[1:], start=1):
        expression = expression.when(F.col(column) == name, position)
    return expression
