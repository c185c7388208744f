"""Side data of a site, each reduced to one row per audit.

Every function takes raw input rows and returns `audit_id` plus the columns the check rules
read. Reductions are plain aggregates, so Spark combines them before the shuffle and a site
with a third of all rows costs its tasks a handful of partial rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import robots, text as tx, urls

SITE_DEAL = 16  # parts that the addresses of a site are dealt to
INTERNAL_BROKEN = "(status_code = 0 OR status_code >= 400)"
SURELY_BROKEN = "(status_code IN (0, 404, 410) OR status_code BETWEEN 500 AND 599)"
VERIFIED = f"(status_code BETWEEN 200 AND 399 OR {SURELY_BROKEN})"


def robots_table(files: DataFrame) -> DataFrame:
    """robots.txt of each site: does it exist, its Sitemap lines, its rule groups."""
    exists = robots.file_exists_sql("status_code", "content_type", "text")
    return files.selectExpr(
        "audit_id", "url AS robots_url", f"{exists} AS robots_exists",
        f"CASE WHEN {exists} THEN {robots.sitemaps_sql('text')} "
        "ELSE CAST(array() AS ARRAY<STRING>) END AS robots_sitemaps",
        f"CASE WHEN {exists} THEN {robots.groups_sql('text')} END AS robots_groups",
    )


def render_table(renders: DataFrame) -> DataFrame:
    """What the browser measured on the homepage."""
    errors = "array_distinct(console_errors)"
    outdated = F.size(F.filter(
        F.map_entries("libraries"), lambda e: tx.is_outdated(e["key"], e["value"])))
    return renders.select(
        "audit_id", "text_length", F.expr(f"size({errors})").alias("error_count"),
        F.array_join(F.expr(errors), "; ").alias("error_examples"),
        outdated.alias("outdated_libraries"),
    )


def script_errors(renders: DataFrame) -> DataFrame:
    """All distinct script errors of a site, one row each."""
    return renders.select("audit_id", F.explode("console_errors").alias("error")).distinct()


def cookies_table(cookies: DataFrame) -> DataFrame:
    distinct = cookies.where("third_party").select("audit_id", "domain").distinct()
    return distinct.groupBy("audit_id").agg(F.count("*").alias("third_party_domains"))


def device_table(views: DataFrame) -> DataFrame:
    """Phone and tablet measurements side by side."""
    fields = [c for c in views.columns if c not in ("audit_id", "name")]
    return views.groupBy("audit_id").agg(*[
        F.max(F.when(F.col("name") == name, F.struct(*fields))).alias(name)
        for name in ("mobile", "tablet")
    ])


def agents_table(probes: DataFrame) -> DataFrame:
    fields = ["status_code", "text_length", "challenge"]
    return probes.groupBy("audit_id").agg(*[
        F.max(F.when(F.col("agent") == name, F.struct(*fields))).alias(name)
        for name in ("ai", "browser")
    ])


def speed_table(tests: DataFrame) -> DataFrame:
    fields = [c for c in tests.columns if c not in ("audit_id", "strategy")]
    return tests.groupBy("audit_id").agg(*[
        F.max(F.when(F.col("strategy") == name, F.struct(*fields))).alias(name)
        for name in ("mobile", "desktop")
    ])


def axe_table(rules: DataFrame) -> DataFrame:
    """Scanner outcome; rows are unique per site and rule, so the list is as long as the
    scanner's own rule book at most."""
    penalty = F.coalesce(
        *[F.when(F.col("impact") == name, value) for name, value in fv.AXE_PENALTY.items()],
        F.lit(0.3),
    )
    rank = F.coalesce(
        *[F.when(F.col("impact") == name, i) for i, name in enumerate(fv.AXE_PENALTY)], F.lit(9)
    )
    own = (
        rules.where(~F.col("id").isin(fv.AXE_COVERED_ELSEWHERE))
        .groupBy("audit_id", "id")
        .agg(F.min("impact").alias("impact"), F.max("nodes").alias("nodes"),
             F.bool_and("passed").alias("passed"))
    )
    found = F.struct(rank.alias("rank"), "id", "impact", "nodes")
    return own.groupBy("audit_id").agg(
        F.count("*").alias("axe_rules"),
        F.coalesce(F.sum(F.when(~F.col("passed"), penalty)), F.lit(0.0)).alias("axe_penalty"),
        F.array_sort(F.collect_list(F.when(~F.col("passed"), found))).alias("axe_found"),
    )


def security_table(facts: DataFrame, as_of: str) -> DataFrame:
    """Security facts with whole days left, floored like calendar code does."""
    def days(column: str) -> Column:
        return F.floor(
            (F.unix_timestamp(column) - F.unix_timestamp(F.lit(as_of).cast("timestamp")))
            / 86400
        ).cast("int")

    return facts.withColumns({
        "cert_days": days("cert_expires"), "domain_days": days("domain_expires"),
    })


def link_status_table(statuses: DataFrame) -> DataFrame:
    """Counts of checked, verified and broken addresses per kind."""
    def of(kind: str, test: str = "true") -> Column:
        return F.expr(f"count_if(kind = '{kind}' AND {test})")

    return statuses.groupBy("audit_id").agg(
        of("internal").alias("internal_total"),
        of("internal", INTERNAL_BROKEN).alias("internal_broken"),
        of("external", VERIFIED).alias("external_verified"),
        of("external", SURELY_BROKEN).alias("external_broken"),
        of("image").alias("image_total"),
        of("image", SURELY_BROKEN).alias("image_broken"),
    )


def title_groups(docs: DataFrame) -> DataFrame:
    """How many pages of a site share their title with another page.

    Two aggregations instead of a window over equal titles: a template title on a third of
    all pages collapses to one counted row per task before it is shuffled.
    """
    from crawlscore.operators.checks.features import FEATURES

    titles = docs.selectExpr("audit_id", f"lower(trim({FEATURES['title']})) AS title")
    counted = titles.where("title <> ''").groupBy("audit_id", "title").count()
    return counted.where("count > 1").groupBy("audit_id").agg(F.sum("count").alias("titles_shared"))


def h1_groups(docs: DataFrame, homes: DataFrame) -> DataFrame:
    """Pages whose main heading is also the main heading of another place in the site.

    `homes` has the homepages' headings as crawled (`raw`) and as rendered (`seen`). They are
    added with weights -1 and +1, which swaps one for the other without joining all pages.
    A text counts as shared when it occurs twice, also twice on one page.
    """
    columns = ["audit_id", "page_key", "explode(h1s) AS h1", "faulty", "{w} AS w", "{s} AS seen"]

    def exploded(df: DataFrame, weight: int, seen: str) -> DataFrame:
        texts = df.selectExpr(*[c.format(w=weight, s=seen) for c in columns])
        return texts.where("h1 <> ''").withColumn("h1", F.lower("h1"))

    swap = homes.where("seen_h1s IS NOT NULL")
    rows = exploded(docs, 1, "false").unionByName(
        exploded(swap.selectExpr("audit_id", "page_key", "raw_h1s AS h1s", "raw_faulty AS faulty"),
                 -1, "false")
    ).unionByName(
        exploded(swap.selectExpr("audit_id", "page_key", "seen_h1s AS h1s", "seen_faulty AS faulty"),
                 1, "true")
    )
    per_page = rows.groupBy("audit_id", "h1", "page_key").agg(
        F.sum("w").alias("n"), F.bool_or("faulty").alias("faulty"),
        F.bool_or(F.when(F.col("seen"), F.col("faulty"))).alias("seen_faulty"),
    ).where("n > 0")
    shared = per_page.groupBy("audit_id", "h1").agg(F.sum("n").alias("total")).where("total > 1")
    marked = per_page.join(shared.drop("total"), ["audit_id", "h1"], "left_semi")
    pages = marked.groupBy("audit_id", "page_key").agg(
        F.coalesce(F.bool_or("seen_faulty"), F.bool_or("faulty")).alias("faulty"))
    return pages.groupBy("audit_id").agg(
        F.count_if(~F.col("faulty")).alias("h1_shared_only"),
        F.min("page_key").alias("h1_first_key"), F.lit(True).alias("h1_home_shared"),
    )


def links(docs: DataFrame) -> DataFrame:
    """Absolute web links of each page in page order, one row per link."""
    hrefs = docs.selectExpr(
        "audit_id", "page_key", "final_url",
        "posexplode(filter(elements, e -> e.tag = 'a' AND map_contains_key(e.attrs, 'href'))) "
        "AS (link_ord, element)",
    )
    return hrefs.select(
        "audit_id", "page_key", "final_url", "link_ord",
        urls.absolute(F.col("final_url"), F.coalesce(F.col("element.attrs")["href"], F.lit("")))
        .alias("link"),
    ).where("link IS NOT NULL")


def address_quality(docs: DataFrame, homes: DataFrame) -> DataFrame:
    """Distinct addresses of each site's own pages and links, and how many break the rules.

    Distinct first, so the join with the one homepage row per site meets each address once. The
    addresses of a site are dealt out by their hash, so that a hot site is joined by many tasks and
    counted before it meets in one.
    """
    found = docs.select("audit_id", F.col("final_url").alias("address"), F.lit(True).alias("own"))
    linked = links(docs).select(
        "audit_id", urls.without_fragment(F.col("link")).alias("address"), F.lit(False).alias("own"))
    distinct = found.unionByName(linked).groupBy("audit_id", "address").agg(
        F.bool_or("own").alias("own"))
    deal = F.pmod(F.xxhash64("address"), F.lit(SITE_DEAL))
    copies = homes.select("audit_id", "home_url", F.explode(F.expr(f"sequence(0L, {SITE_DEAL - 1}L)")).alias("deal"))
    joined = distinct.withColumn("deal", deal).join(copies, ["audit_id", "deal"])
    home, address = F.col("home_url"), F.col("address")
    own = F.col("own") | urls.same_origin(address, home) | urls.same_origin(
        F.regexp_replace(address, "^http:", "https:"), home)
    judged = joined.where(own).select(
        "audit_id",
        (F.size(urls.url_problems(address, home.startswith("https://"))) > 0).alias("bad"),
        (F.size(urls.url_notes(address)) > 0).alias("noted"),
    )
    return judged.groupBy("audit_id").agg(
        F.count("*").alias("addresses"), F.count_if("bad").alias("addresses_bad"),
        F.count_if("noted").alias("addresses_noted"),
    )
