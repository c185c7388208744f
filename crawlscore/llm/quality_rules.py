"""Quality rules: a table of thresholds compiled into one projection, without user functions.

Defined results: a null or empty text has no words and fails the base rules; a null threshold column
never occurs, ratios of a text without words are 0. Repeated rows are judged one by one. Extra
columns are kept and may have any name, since the measures live in one struct.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.llm import common

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: Frequent function words of the four languages, lower case.
STOP_WORDS = (
    "a and are as at be but by for from has have in is it not of on or that the this to was were will with "
    "au aux avec ce ces dans de des du elle en est et il je la le les mais ou par pas pour qui que sa se "
    "son sur un une vous "
    "aber als auch auf aus bei bin bis das dass dem den der des die ein eine er es ich im ist mit nach "
    "nicht sich sie sind und von war wie zu zum "
    "al como con del el esta las lo los mas no para pero por si sin su sus una y"
).split()


@dataclass(frozen=True)
class Rule:
    """A text of at least `from_words` words is rejected when `measure` is beyond its limits."""

    measure: str
    least: float | None = None
    most: float | None = None
    from_words: int = MIN_WORDS


#: Ratios are for one word or one line with a word.
RULES = (
    Rule("symbols_per_word", most=0.25),
    Rule("marks_per_word", most=0.5),
    Rule("duplicate_line_share", most=0.5),
    Rule("mean_word_chars", least=2.0, most=25.0),
    Rule("stop_word_share", least=0.005, from_words=200),
)


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def _measures(df: DataFrame, text: str) -> DataFrame:
    """Adds words, windows and then the struct `m`; three projections, so that arrays are built once."""
    blank = F.translate(F.col(text), common.WHITE, " " * len(common.WHITE))
    df = df.withColumn("w", F.array_remove(F.split(blank, " "), F.lit("")))
    df = df.withColumn("lines", F.filter(
        F.split(F.col(text), "\n"), lambda x: F.length(_without(x, common.WHITE)) > 0))
    windows = F.expr(
        "sort_array(transform(sequence(0, size(w) - 3), "
        "i -> struct(xxhash64(w[i], w[i + 1], w[i + 2]) AS h, i AS p)))")
    df = df.withColumn("s", F.when(F.size("w") >= 3, windows))
    repeated = F.expr(
        "sort_array(transform(filter(s, (x, k) -> (k > 0 AND s[k - 1].h = x.h) OR "
        "(k < size(s) - 1 AND s[k + 1].h = x.h)), x -> x.p))")
    df = df.withColumn("p", repeated)
    covered = F.expr(
        "aggregate(p, named_struct('last', -3, 'n', 0L), "
        "(a, x) -> named_struct('last', x, 'n', a.n + least(3, x - a.last)), a -> a.n)")
    stop = ", ".join(f"'{word}'" for word in dict.fromkeys(STOP_WORDS))
    kept = F.length(_without(F.col(text), common.WHITE))
    counts = F.struct(
        F.size("w").cast("long").alias("n_words"),
        kept.cast("long").alias("word_chars"),
        (F.length(text) - F.length(_without(F.col(text), "#*$%&|<>"))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(_without(F.col(text), "!?"))).cast("long").alias("n_marks"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.expr(f"size(filter(w, x -> x IN ({stop})))").cast("long").alias("n_stop_words"),
    )
    return df.withColumn("m", counts).drop("w", "lines", "s", "p")


def _verdict(m: str, rules: tuple[Rule, ...]) -> tuple[Column, dict[str, Column], Column]:
    """base_failed, the ratios, and whether the table's rules pass."""
    def of(name: str) -> Column:
        return F.col(f"{m}.{name}").cast("double")

    words = F.greatest(of("n_words"), F.lit(1.0))
    ratios = {
        "symbols_per_word": of("n_symbols") / words,
        "marks_per_word": of("n_marks") / words,
        "duplicate_line_share": of("n_dup_lines") / F.greatest(of("n_lines"), F.lit(1.0)),
        "mean_word_chars": of("word_chars") / words,
        "stop_word_share": of("n_stop_words") / words,
    }
    base_failed = (F.col(f"{m}.n_words") < MIN_WORDS) | (
        100 * F.col(f"{m}.n_repeat_words") > MAX_REPEATED_PERCENT * F.col(f"{m}.n_words"))
    passed = F.lit(True)
    for rule in rules:
        bad = F.lit(False)
        if rule.least is not None:
            bad = bad | (ratios[rule.measure] < rule.least)
        if rule.most is not None:
            bad = bad | (ratios[rule.measure] > rule.most)
        passed = passed & ~(bad & (F.col(f"{m}.n_words") >= rule.from_words))
    return base_failed, ratios, passed


def judged(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Two columns: `row`, the document's own columns, and `quality`, its counts, ratios and verdict."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                      F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    measured = _measures(own, "text")
    base_failed, ratios, passed = _verdict("m", rules)
    return measured.select(
        "row",
        F.struct("m.*", *[r.alias(name) for name, r in ratios.items()], base_failed.alias("base_failed"),
                 (~base_failed & passed).alias("kept")).alias("quality"))


def keep_good(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with their own columns.

    The verdict goes through a generator, below which Spark pushes no filter: pushed down, the filter
    would put the word list's expression in place of its column, inside the lambdas that run over it.
    """
    verdict = judged(docs, text, rules).select("row", F.explode(F.array("quality.kept")).alias("kept"))
    return verdict.where("kept").select("row.*")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the counts of the contract, the ratios and the verdict."""
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs).select(
        "row.doc_id", "quality.n_words", "quality.word_chars", "quality.n_symbols", "quality.n_dup_lines",
        "quality.n_repeat_words", "quality.base_failed", "quality.kept")


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
  FROM documents),
tri AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t3
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT r, i FROM tri QUALIFY count(*) OVER (PARTITION BY r, t3) > 1),
rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY r),
m AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
         greatest(len(w), 1) AS x, len(l) AS n_lines,
         length(regexp_replace(t, '[^!?]', '', 'g')) AS marks,
         len(list_filter(w, lambda x: x IN ({", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))}))) AS stops
  FROM d LEFT JOIN rep USING (r)),
v AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols / x <= 0.25 AND marks / x <= 0.5
       AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND word_chars / x BETWEEN 2.0 AND 25.0
       AND (n_words < 200 OR stops / x >= 0.005) AS kept
FROM v
"""
