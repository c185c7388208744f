"""Mixing sources to target weights: repetition rates per source, then whole copies plus one by chance.

Sizes are summed per source, targets share a given part of all words by weight, no source being
repeated more than a given number of times; what a full source cannot take is shared anew among the
others. A document is emitted floor(rate) times, and once more when the hash of its id and the seed
falls below the rate's fraction.

Defined results: a null or empty text has size 0 and is emitted by the same rule. A null source is a
source of its own and comes last. Rows with the same id share their decision, so reruns agree. An
empty table gives an empty mix. The own columns of the documents are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.llm import common

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_REPEATS = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    """Runs of characters other than white space: the places where one begins."""
    blank = F.translate(F.coalesce(text, F.lit("")), common.WHITE, " " * len(common.WHITE))
    return F.size(F.array_remove(F.split(blank, " "), F.lit(""))).cast("long")


def _weighted(totals: DataFrame, weights: tuple[float, ...]) -> DataFrame:
    """Sources with their weight, dealt in turn by code point (null last)."""
    ranked = common.numbered(totals, ["source"], "nth")
    deal = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("nth") % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", deal).drop("nth")


def targets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
            most: float = MOST_REPEATS) -> DataFrame:
    """source, source_size, target and rate from (source, source_size).

    Each round shares what full sources leave by weight; a source whose share exceeds its limit is
    full from then on. The driver sees two sums a round, and rounds end when no source is added,
    after as many as there are distinct ratios of size to weight at most (a few in practice).
    """
    sources = common.materialise(_weighted(totals, weights), "sources")
    wanted = share * (sources.agg(F.sum("source_size")).head()[0] or 0)
    level, n_full = 0.0, -1
    while True:
        full = F.col("weight") * level > most * F.col("source_size") if n_full >= 0 else F.lit(False)
        taken, weight, n = sources.agg(
            F.sum(F.when(full, most * F.col("source_size")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))), F.count_if(full)).head()
        if n == n_full or not weight:
            break
        n_full, level = n, (wanted - taken) / weight
    size = F.col("source_size").cast("double")
    target = F.least(most * size, level * F.col("weight")) if weight else most * size
    return sources.select("source", "source_size", target.alias("target")).withColumn(
        "rate", F.when(size > 0, F.col("target") / size).otherwise(0.0))


def chance(key: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from 48 bits of the MD5 of the key and the seed."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(1 << 48)


def mixed(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
          weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS,
          seed: str = SEED) -> DataFrame:
    """`row` (the document's own columns) with size, source_size, target and `copies` to emit.

    The few sums per source are combined before the shuffle, and their table is joined as Spark
    sees fit: broadcast below its size threshold, else by a sort-merge join that splits hot sources.
    """
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.col(f"`{key}`").alias("key"), F.col(f"`{source}`").alias("source"),
                      word_count(F.col(f"`{text}`")).alias("size"))
    totals = own.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = targets(totals, weights, share, most).withColumnRenamed("source", "of")
    whole = F.floor("rate")
    extra = chance(F.col("key"), seed) < F.col("rate") - whole
    return own.join(plan, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "row", "size", "source_size", "target", (whole + extra.cast("long")).alias("copies"))


def emitted(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents' own columns, each row as often as it is taken."""
    return mixed(docs, **options).withColumn(
        "nth", F.explode(F.expr("filter(sequence(1, greatest(copies, 1)), i -> i <= copies)"))).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its size, its source's size and target, and the words taken from it."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixed(docs).select("row.doc_id", "size", "source_size", "target",
                              (F.col("copies") * F.col("size")).alias("taken"))


#: Sources become full in order of size by weight, so the level is the first that fits its successors.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [3.0, 1.0, 2.0][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT)]::DOUBLE AS weight
  FROM s),
o AS (
  SELECT *, coalesce(sum(2.0::DOUBLE * source_size) OVER before, 0) AS taken,
         sum(weight) OVER rest AS left_weight, (SELECT 1.5::DOUBLE * sum(source_size) FROM s) AS wanted
  FROM w
  WINDOW before AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         rest AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (
  SELECT min_by((wanted - taken) / left_weight, source_size / weight) AS level
  FROM o WHERE weight * ((wanted - taken) / left_weight) <= 2.0::DOUBLE * source_size),
t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, level * weight) AS target
  FROM w, l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT)
               + CASE WHEN CAST(('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)) AS BIGINT)
                      / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
