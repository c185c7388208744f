"""URL filters: host-suffix and path-prefix expressions, joined with the rules on short hashes.

Only DataFrame functions. Each distinct (host, path) is expanded into the expressions that a rule
could have, as deep as the deepest rule; expressions meet rules in an equi-join on the first 32 bits
of their digests; the full digest confirms, and the longest rule wins.

A rule fits its host and all subdomains where the url's path starts with the rule's; an empty path fits all.

Defined results: a url that is null or has no '://' has an empty host and path, which no rule fits.
Repeated rows are judged alike. Of equally long rules that differ the last by code point wins, of equal
ones the verdict 'allow'. Extra columns of the pages are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.llm import common

#: Verdict of a url that no rule fits.
OTHERWISE = "allow"

#: Rules of the query: host, path, verdict.
RULES = (
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(rest, upper, upper.lower()), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit(" "), path), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def _prepared(rules: DataFrame) -> DataFrame:
    """Rules with digest, short digest and rank."""
    one = rules.groupBy("host", "path").agg(F.min("verdict").alias("verdict"))
    digest = _digest(F.col("host"), F.col("path"))
    return one.select(
        F.concat("host", "path").alias("rule"), "verdict", digest.alias("digest"), _short(digest).alias("short"),
        F.length(F.concat("host", "path")).alias("rank"), F.size(F.split("host", r"\.")).alias("labels"),
        F.length("path").alias("letters"))


def _expressions(urls: DataFrame, labels: int, letters: list[int]) -> DataFrame:
    """(host, path) with one row for each host suffix and path prefix that a rule could name.

    Suffixes have at most as many labels as any rule has, and prefixes the lengths of the rules' paths; nothing
    else can match.
    """
    suffixes = F.expr(
        f"transform(sequence(1, least({labels}, size(split(host, '[.]')))), k -> substring_index(host, '.', -k))")
    lengths = ", ".join(map(str, letters))
    prefixes = F.expr(f"transform(filter(array({lengths}), k -> k <= length(path)), k -> left(path, k))")
    return (urls.where("host <> ''").withColumn("suffix", F.explode(suffixes))
            .withColumn("prefix", F.explode(prefixes)))


def judged(pages: DataFrame, rules: DataFrame, url: str = "url", otherwise: str = OTHERWISE) -> DataFrame:
    """`row` (the page's own columns), host, path, the winning rule or null, and the verdict.

    Join hints are left out: Spark broadcasts the rules or the matched urls only below its own size
    threshold, and splits hot urls in a sort-merge join.
    """
    prepared = common.materialise(_prepared(rules), "url-rules")
    deepest = prepared.agg(F.max("labels"), F.sort_array(F.collect_set("letters"))).head()  # at most a longest path's length
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("row"),
                       host_of(F.col(f"`{url}`")).alias("host"), path_of(F.col(f"`{url}`")).alias("path"))
    urls = own.select("host", "path").distinct()
    asked = _expressions(urls, deepest[0], deepest[1]) if deepest[0] else urls.where("false").selectExpr(
        "*", "host AS suffix", "path AS prefix")
    digest = _digest(F.col("suffix"), F.col("prefix"))
    asked = asked.select("host", "path", digest.alias("asked"), _short(digest).alias("short"))
    hits = asked.join(prepared.select("short", "digest", "rule", "rank", "verdict"), "short").where("asked = digest")
    best = hits.groupBy("host", "path").agg(
        F.max(F.struct("rank", F.col("rule"), "verdict")).alias("best"))
    return own.join(best, ["host", "path"], "left").select(
        "row", "host", "path", F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(otherwise)).alias("verdict"))


def op7_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page with host, path, winning rule and verdict."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url")
    return judged(pages, rule_table(spark)).select("row.page_id", "host", "path", "rule", "verdict")


ORACLE = """
WITH p AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(h, f, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
                      ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
best AS (
  SELECT host, path, max_by(h || f, length(h || f)) AS rule, max_by(v, length(h || f)) AS v
  FROM (SELECT DISTINCT host, path FROM p), r
  WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, f)
  GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict
FROM p LEFT JOIN best USING (host, path)
"""
