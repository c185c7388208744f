"""robots.txt decisions for many addresses: rules as rows, met by an equi-join on path prefixes.

The rules of an agent's group become rows (audit_id, path, allow, order). An address is expanded to the prefixes of its
path whose lengths occur among its site's rules, so that "starts with" is an equality; of the rules met, the
first in the file decides. No rule array travels with the addresses, and a site with many rules costs as many
prefixes an address as its rules have different lengths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlscore.functions import robots


def rule_rows(files: DataFrame, agent: str, groups: str = "robots_groups") -> DataFrame:
    """(audit_id, path, allow, rule_ord) of the group that binds the agent; of equal paths the first.

    `files` has one row per site with its rule groups. A rule for '*' fits every path.
    """
    rules = files.where(f"{groups} IS NOT NULL").selectExpr(
        "audit_id", f"posexplode({robots.group_of(groups, agent)}.rules) AS (rule_ord, r)")
    path = F.when(F.col("r.path") == "*", "").otherwise(F.col("r.path"))
    return rules.groupBy("audit_id", path.alias("path")).agg(
        F.min("rule_ord").alias("rule_ord"), F.min_by("r.allow", "rule_ord").alias("allow"))


def judged(rows: DataFrame, url: str, files: DataFrame, agent: str, into: str = "allowed") -> DataFrame:
    """`rows` (with audit_id) and whether robots.txt of the site lets the agent visit `url`.

    Sites without rules, and addresses that no rule fits, are open. Hot sites are left to adaptive splitting: the site's
    lengths and rules are the small sides of both joins.
    """
    rules = rule_rows(files, agent)
    lengths = rules.select("audit_id", F.length("path").alias("__length")).distinct()
    asked = rows.select("audit_id", F.col(url).alias("__url")).distinct().withColumn(
        "__target", F.expr(robots.target("__url")))
    prefixes = asked.join(lengths, "audit_id").where("__length <= length(__target)").withColumn(
        "path", F.expr("left(__target, __length)"))
    hits = prefixes.select("audit_id", "__url", "path").join(rules, ["audit_id", "path"])
    verdicts = hits.groupBy("audit_id", "__url").agg(F.min_by("allow", "rule_ord").alias(into)).withColumnsRenamed(
        {"audit_id": "__site", "__url": "__asked"})
    met = rows.join(verdicts, (F.col("audit_id") == F.col("__site")) & (F.col(url) == F.col("__asked")), "left")
    return met.withColumn(into, F.coalesce(into, F.lit(True))).drop("__site", "__asked")
