"""From raw documents to encoded training text: five stages, each written and read again.

Every stage works on all rows its predecessor kept, and all but the last keep the columns of
`documents`. Documents that the classifier or the rules reject go, one document of each group of near copies
stays, the mix repeats or leaves out documents by its rates, and the last stage encodes what is left.

Defined results, for every stage: an empty table gives an empty table with the same columns (the last: its
digests). Columns beyond those of `documents`, whatever their names, are carried through and never read. Reruns
give the same rows. What a stage does with nulls, empty and very long texts, ties and repeated rows stands
at the stage. `labels` may be empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from crawlscore.llm import common, mixing, near_dedup, pieces, quality_classifier, quality_rules


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Good documents by text, source and language, learnt from `labels`.

    A null or empty text is judged by ratios of 0; null sources and languages are groups of their own; without
    labels all rows stay. Repeated rows are judged alike, and all or none of them stay. A posterior equal to the
    threshold stays. Texts are read whole.
    """
    return quality_classifier.keep_good(docs, common.table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within the limits of the rule table.

    A null or empty text has no words and goes; other columns may be null. Rows are judged one by one, so repeated
    rows all stay or all go. A value equal to its limit stays. Texts are read whole, however long.
    """
    return quality_rules.keep_good(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingles at a similarity of 0.8.

    The smallest doc_id of a group stays. Of rows with the same doc_id one stays, that with the smallest digest;
    rows without one all stay. A text of no words is linked with nothing. All shingles of a long text count.
    """
    common.ship_package(spark)
    return near_dedup.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them.

    A null source comes last in order and has a weight of its own; a text of no words adds nothing to its source.
    Repeated rows are drawn alike, by the hash of their id. Sources without words emit no rows.
    """
    return mixing.emitted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each remaining row encoded, decoded and summed up.

    A null text counts as empty: begin and end ids alone, decoded to ''. Copies made by the mix and repeated rows
    give one row each. Texts are encoded whole.
    """
    common.ship_package(spark)
    return pieces.digests(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify),
    ("quality rules", apply_rules),
    ("near duplicates", deduplicate),
    ("mixing", mix),
    ("piece encoding", encode),
]

#: SQL cannot express the last stage; tests/llm/test_pipeline.py compares the stages with brute force or statements, the first with op6.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
