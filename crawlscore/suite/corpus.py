"""The given tables as audit inputs, and the registry of queries."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.operators import linkgraph as lg
from crawlscore.plans.audit import AuditInputs, check_results
from crawlscore.session import materialise, ship_package
from crawlscore.sources import derived as dv
from crawlscore.sources import pages as pg
from crawlscore.sources import payloads as pl
from crawlscore.functions import robots

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
AS_OF = "2024-02-01 00:00:00"
_corpora: dict[tuple[str, str], "Corpus"] = {}


class Corpus:
    """Tables of one data folder.

    Documents are extracted once and written to the shared folder; every query then reads
    the columns it needs from there. The one row per site that carries the homepage is
    written too, since most side tables come from it.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")
        #: The given tables are few files, so texts are dealt out before they are parsed.
        self.parts = 2 * spark.sparkContext.defaultParallelism

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def _sites_view(self) -> str:
        view = "sites_" + re.sub(r"\W", "_", self.sf_dir)
        materialise(dv.derived(self.spark, self.sf_dir, "sites"), "sites").createOrReplaceTempView(view)
        return view

    def derived(self, name: str) -> DataFrame:
        if name == "sites":
            return self.spark.table(self._sites_view)
        if dv.PREREQUISITES.get(name, ["sites"]) == ["sites"]:
            sql = re.sub(r"FROM sites\b", f"FROM {self._sites_view}", dv.DERIVED[name])
            return self.spark.sql(sql)
        return dv.derived(self.spark, self.sf_dir, name)

    @cached_property
    def pages(self) -> DataFrame:
        return dv.page_table(self.spark, self.sf_dir)

    @cached_property
    def docs(self) -> DataFrame:
        return materialise(pg.page_docs(self.pages, self.parts), "page-docs")

    @cached_property
    def render_docs(self) -> DataFrame:
        return materialise(pg.render_docs(self.derived("renders"), self.parts), "render-docs")

    @cached_property
    def renders(self) -> DataFrame:
        return self.derived("renders").selectExpr(
            "audit_id", "text_length",
            "filter(split(console_errors, '[|]'), e -> e <> '') AS console_errors",
            "CASE WHEN jquery_version <> '' THEN map('jQuery', jquery_version) "
            "ELSE CAST(map() AS MAP<STRING, STRING>) END AS libraries")

    @cached_property
    def device_views(self) -> DataFrame:
        return self.derived("device_views").withColumn(
            "first_screen_links",
            F.expr("filter(split(first_screen, '[|](?=[A-Z])'), l -> l <> '')")).drop("first_screen")

    @cached_property
    def homes(self) -> DataFrame:
        """Homepage address and robots rules of each site."""
        sites = self.derived("sites").select("audit_id", "home_url")
        rules = self.derived("robots_files").selectExpr(
            "audit_id",
            f"CASE WHEN {robots.file_exists_sql('status_code', 'content_type', 'text')} THEN "
            f"{robots.groups_sql('text')} END AS robots_groups")
        return sites.join(rules, "audit_id", "left")

    @cached_property
    def url_status(self) -> DataFrame:
        """Answers of the addresses that would be probed; the answer comes from the address."""
        internal = lg.internal_edges(self.docs, self.homes)
        probed = with_status(lg.links_to_verify(internal, self.docs))
        none = self.spark.createDataFrame([], "audit_id string, url string, error string")
        own = lg.link_statuses(self.docs, probed, none)
        away = with_status(lg.external_to_check(lg.external_links(self.docs, self.homes)))
        images = with_status(lg.images_to_check(lg.image_edges(self.docs)))
        parts = [(own, "internal"), (away, "external"), (images, "image")]
        rows = [
            df.select("audit_id", F.lit(kind).alias("kind"), "url", "status_code")
            for df, kind in parts
        ]
        return rows[0].unionByName(rows[1]).unionByName(rows[2])

    @cached_property
    def inputs(self) -> AuditInputs:
        return AuditInputs(
            docs=self.docs, render_docs=self.render_docs, renders=self.renders,
            robots_files=self.derived("robots_files"),
            sitemaps=pl.sitemap_totals(pl.sitemap_visits(
                pl.sitemap_starts(self.derived("robots_files"), self.derived("sites")),
                self.derived("sitemap_files"))),
            site_probe=self.derived("site_probe"), agent_probe=self.derived("agent_probe"),
            url_status=self.url_status, cookies=self.derived("cookies"),
            device_views=self.device_views, axe_rules=self.derived("axe_rules"),
            speed_tests=pl.speed_tests(self.derived("psi_raw")),
            security_facts=self.derived("security_facts"), as_of=AS_OF,
        )

    @cached_property
    def results(self) -> DataFrame:
        """All checks of all sites, written once for the report queries."""
        return materialise(check_results(self.inputs, stage=True), "check-results")


STATUS_OF = (
    "CASE instr('0123456789abcdef', substr(md5({u}), 1, 1)) - 1 WHEN 0 THEN 404 WHEN 1 THEN 0 "
    "WHEN 2 THEN 500 WHEN 3 THEN 403 WHEN 4 THEN 301 ELSE 200 END"
)


def with_status(links: DataFrame) -> DataFrame:
    return links.selectExpr("audit_id", "link AS url", f"{STATUS_OF.format(u='link')} AS status_code")


def corpus(spark: SparkSession, sf_dir: str) -> Corpus:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _corpora:
        ship_package(spark)
        _corpora[key] = Corpus(spark, sf_dir)
    return _corpora[key]


def query(name: str, oracle: str | None = None):
    """Register `fn(corpus) -> DataFrame` under an operator's id."""

    def add(fn: Callable[[Corpus], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"two queries named {name}")
        QUERIES[name] = lambda spark, sf_dir: fn(corpus(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = re.sub(r"\b([a-z]) -> ", r"lambda \1: ", oracle)
        return fn

    return add
