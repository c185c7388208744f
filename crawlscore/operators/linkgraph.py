"""Which pages to crawl, which links to probe, and where broken ones stand.

One site may hold a third of all links. Duplicates therefore collapse in aggregates before
they are ranked. Nothing is cut by default; a caller's "first N" is a window limit, of which Spark
keeps N rows per site and task before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import robots, urls
from crawlscore.operators import robots_access
from crawlscore.plans.side_tables import links


def _first(df: DataFrame, count: int | None, *order) -> DataFrame:
    if count is None:
        return df
    window = Window.partitionBy("audit_id").orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(window)).where(
        F.col("__rank") <= count).drop("__rank")


def page_links(docs: DataFrame) -> DataFrame:
    return links(docs)


def candidates(sitemap: DataFrame, home_links: DataFrame) -> DataFrame:
    """Addresses to consider: the sitemap's first, then the homepage's links, in order.

    `sitemap` has audit_id, loc_ord, loc; `home_links` has audit_id, link_ord, link.
    """
    listed = sitemap.select(
        "audit_id", F.lit(0).alias("source"), F.col("loc_ord").cast("bigint").alias("ord"),
        F.col("loc").alias("raw"))
    linked = home_links.select(
        "audit_id", F.lit(1).alias("source"), F.col("link_ord").cast("bigint").alias("ord"),
        F.col("link").alias("raw"))
    return listed.unionByName(linked)


def _with_site(df: DataFrame, sites: DataFrame) -> DataFrame:
    return df.join(sites.select("audit_id", "home_url"), "audit_id")


def choose_pages(found: DataFrame, sites: DataFrame, agent: str = "*",
                 limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(wanted, skipped): the pages robots.txt allows, or the first `limit` of them, and those it
    forbids (before the last wanted one, where the limit is reached).

    `sites` has audit_id, home_url and robots_groups (null when there is no robots.txt).
    """
    normal = found.withColumn("page", urls.normalize_url(F.col("raw"))).where("page IS NOT NULL")
    unique = normal.groupBy("audit_id", "page").agg(F.min(F.struct("source", "ord")).alias("at"))
    own = _with_site(unique, sites).where(
        urls.same_origin(F.col("page"), F.col("home_url"))
        & (F.col("page") != urls.normalize_url(F.col("home_url")))
        & urls.is_page_address(F.col("page")))
    judged = robots_access.judged(own.select("audit_id", "page", "at"), "page", sites, agent)
    wanted = _first(judged.where("allowed"), limit, "at")
    if limit is None:
        return wanted.select("audit_id", "page", "at"), judged.where("NOT allowed").select("audit_id", "page", "at")
    last = wanted.groupBy("audit_id").agg(
        F.count("*").alias("n"), F.max("at").alias("last"))
    skipped = judged.where("NOT allowed").join(last, "audit_id", "left").where(
        (F.coalesce("n", F.lit(0)) < limit) | (F.col("at") < F.col("last")))
    return wanted.select("audit_id", "page", "at"), skipped.select("audit_id", "page", "at")


def discover(found: DataFrame, sites: DataFrame, limit: int | None = None) -> DataFrame:
    """Every distinct page address of a site with the first place it was found (`at`)."""
    normal = found.withColumn(
        "page", urls.normalize_url(urls.without_fragment(F.col("raw")))).where(
        F.col("page").isNotNull() & urls.is_page_address(F.col("page")))
    unique = normal.groupBy("audit_id", "page").agg(F.min(F.struct("source", "ord")).alias("at"))
    own = _with_site(unique, sites).where(urls.same_origin(F.col("page"), F.col("home_url")))
    return _first(own.select("audit_id", "page", "at"), limit, "at")


def link_edges(docs: DataFrame) -> DataFrame:
    """Distinct (link, page) edges with the first place each link stands."""
    cut = links(docs).withColumn("link", urls.without_fragment(F.col("link")))
    return cut.groupBy("audit_id", "link", "page_key", "final_url").agg(
        F.min("link_ord").alias("link_ord"))


def internal_edges(docs: DataFrame, sites: DataFrame, agent: str = "*") -> DataFrame:
    """Edges within a site that robots.txt lets us follow."""
    edges = _with_site(link_edges(docs), sites).where(urls.same_origin(F.col("link"), F.col("home_url"))).select(
        "audit_id", "link", "page_key", "final_url", "link_ord")
    return robots_access.judged(edges, "link", sites, agent).where("allowed").drop("allowed")


def _first_places(edges: DataFrame) -> DataFrame:
    return edges.groupBy("audit_id", "link").agg(
        F.min(F.struct("page_key", "link_ord")).alias("at"), F.count("*").alias("on_pages"))


def links_to_verify(edges: DataFrame, pages: DataFrame,
                    limit: int | None = None) -> DataFrame:
    """Internal links not crawled yet."""
    crawled = pages.select("audit_id", F.explode(F.array("final_url", "url")).alias("link")).distinct()
    open_links = _first_places(edges).join(crawled, ["audit_id", "link"], "left_anti")
    return _first(open_links, limit, "at")


def link_statuses(pages: DataFrame, probed: DataFrame, errors: DataFrame) -> DataFrame:
    """One status per internal address: crawled, then probed, then crawl errors override."""
    code = F.when(F.col("error").rlike(r"^(HTTP )?\d+$"),
                  F.regexp_extract("error", r"(\d+)$", 1).cast("int")).otherwise(0)
    rows = (
        pages.select("audit_id", F.col("final_url").alias("url"), "status_code",
                     F.lit(0).alias("priority"))
        .unionByName(probed.select("audit_id", "url", "status_code", F.lit(1).alias("priority")))
        .unionByName(errors.select("audit_id", "url", code.alias("status_code"),
                                   F.lit(2).alias("priority")))
    )
    return rows.groupBy("audit_id", "url").agg(
        F.max_by("status_code", F.struct("priority", "status_code")).alias("status_code"))


def external_links(docs: DataFrame, sites: DataFrame) -> DataFrame:
    """Links to other websites with the first place each stands; `walled` ones answer robots
    misleadingly and are not probed."""
    places = _first_places(link_edges(docs))
    joined = _with_site(places, sites)
    away = ~urls.same_site(urls.domain(F.col("link")), urls.domain(F.col("home_url")))
    walled = urls.site_domain(urls.domain(F.col("link"))).isin(fv.WALLED_SITES)
    return joined.where(away).select("audit_id", "link", "at", "on_pages", walled.alias("walled"))


def external_to_check(external: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(external.where("NOT walled"), limit, "at")


def image_edges(docs: DataFrame) -> DataFrame:
    """Distinct (picture, page) edges."""
    tags = docs.selectExpr(
        "audit_id", "page_key", "final_url",
        "posexplode(filter(elements, e -> e.tag = 'img')) AS (image_ord, element)")
    sources = tags.select(
        "audit_id", "page_key", "final_url", "image_ord",
        urls.absolute(F.col("final_url"), F.coalesce(F.col("element.attrs")["src"], F.lit("")))
        .alias("link")).where("link IS NOT NULL")
    return sources.groupBy("audit_id", "link", "page_key", "final_url").agg(
        F.min("image_ord").alias("link_ord"))


def images_to_check(edges: DataFrame, limit: int | None = None) -> DataFrame:
    return _first(_first_places(edges), limit, "at")


def broken_pages(statuses: DataFrame, edges: DataFrame, broken: str) -> DataFrame:
    """All pages on which a broken address stands, one row per address and page."""
    bad = statuses.where(broken).select("audit_id", F.col("url").alias("link"))
    return edges.join(bad, ["audit_id", "link"], "left_semi").select(
        "audit_id", "link", "page_key", "final_url")


def broken_breakdown(statuses: DataFrame, edges: DataFrame, broken: str,
                     pages_shown: int | None = None, listed: int | None = None) -> DataFrame:
    """Broken addresses with their answer and every page they stand on: one row per address and page, or one
    without a page where none is known.

    With `pages_shown` one row per address, whose `pages` names that many pages and `more_pages` counts the others;
    the window limit keeps as few before the shuffle.
    """
    bad = statuses.where(broken).select("audit_id", F.col("url").alias("link"), "status_code")
    bad = _first(bad, listed, "link")
    answer = F.when(F.col("status_code") == 0, "can't be reached").otherwise(
        F.concat(F.lit("error "), F.col("status_code").cast("string")))
    bad = bad.select("audit_id", "link", answer.alias("answer"))
    hits = broken_pages(statuses, edges, broken)
    if pages_shown is None:
        return bad.join(hits, ["audit_id", "link"], "left")
    counts = hits.groupBy("audit_id", "link").agg(F.count("*").alias("on_pages"))
    order = Window.partitionBy("audit_id", "link").orderBy("page_key")
    few = hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= pages_shown)
    shown = few.groupBy("audit_id", "link").agg(F.expr(
        "transform(array_sort(collect_list(struct(n, final_url))), x -> x.final_url)")
        .alias("shown_pages"))
    rows = bad.join(counts, ["audit_id", "link"], "left").join(shown, ["audit_id", "link"], "left")
    pages = F.coalesce("on_pages", F.lit(0))
    return rows.select(
        "audit_id", "link", "answer", pages.alias("on_pages"),
        F.coalesce(F.array_join("shown_pages", " "), F.lit("")).alias("pages"),
        F.greatest(pages - pages_shown, F.lit(0)).alias("more_pages"))


def first_culprits(statuses: DataFrame, docs: DataFrame, broken: str, tag: str = "a",
                   attribute: str = "href", limit: int | None = None) -> DataFrame:
    """The first element pointing at each broken address."""
    bad = statuses.where(broken).select("audit_id", F.col("url").alias("link"))
    spots = docs.selectExpr(
        "audit_id", "page_key", "final_url",
        f"posexplode(filter(elements, e -> e.tag = '{tag}' AND map_contains_key(e.attrs, "
        f"'{attribute}'))) AS (spot, element)")
    aimed = spots.select(
        "audit_id", "page_key", "final_url", "spot", "element.path",
        urls.without_fragment(urls.absolute(
            F.col("final_url"), F.coalesce(F.col("element.attrs")[attribute], F.lit(""))))
        .alias("link"))
    hits = aimed.join(bad, ["audit_id", "link"], "left_semi")
    first = hits.groupBy("audit_id", "link").agg(
        F.min_by(F.struct("final_url", "path"), F.struct("page_key", "spot")).alias("e"))
    return _first(first.select("audit_id", "link", "e.final_url", "e.path"), limit, "link")


def blocked_agents(robots_files: DataFrame, sites: DataFrame, agents: dict[str, str]) -> DataFrame:
    """Which of a fixed list of agents robots.txt keeps off each homepage."""
    parsed = robots_files.selectExpr(
        "audit_id",
        f"CASE WHEN {robots.file_exists_sql('status_code', 'content_type', 'text')} THEN "
        f"{robots.groups_sql('text')} END AS robots_groups")
    decisions = ", ".join(
        f"CASE WHEN NOT {robots.allows('robots_groups', name, 'home_url')} THEN "
        f"named_struct('agent', '{name}', 'kind', '{kind}') END" for name, kind in agents.items())
    joined = parsed.where("robots_groups IS NOT NULL").join(
        sites.select("audit_id", "home_url"), "audit_id")
    return joined.selectExpr("audit_id", f"inline(array_compact(array({decisions})))")


def page_listing(discovered: DataFrame, pages: DataFrame) -> DataFrame:
    """All pages found, with whether each was checked; checked ones come first."""
    checked = pages.select("audit_id", F.col("final_url").alias("page"), F.lit(True).alias("checked"))
    return discovered.join(checked.distinct(), ["audit_id", "page"], "left").withColumn(
        "checked", F.coalesce("checked", F.lit(False)))


def capability_gate(capabilities: DataFrame, checks: list[tuple[str, list[str]]]) -> DataFrame:
    """Checks that cannot run, with the first capability they lack and the reason.

    `checks` is the fixed catalogue as (check_id, requires); it meets each audit as one array
    literal, so nothing is joined.
    """
    entries = ", ".join(
        f"named_struct('check_id', '{check_id}', 'requires', CAST(array("
        + ", ".join(f"'{r}'" for r in requires) + ") AS ARRAY<STRING>))"
        for check_id, requires in checks)
    rows = capabilities.selectExpr("audit_id", "caps", "reasons", f"inline(array({entries}))")
    lacking = F.array_sort(F.array_except("requires", "caps"))
    return rows.withColumn("lacking", lacking).where(F.size("lacking") > 0).select(
        "audit_id", "check_id", F.get("lacking", F.lit(0)).alias("missing"),
        F.try_element_at("reasons", F.get("lacking", F.lit(0))).alias("reason"))
