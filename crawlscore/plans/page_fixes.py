"""Ready-made fixes page by page, as rows: what a page lacks, and the block that mends it.

A row is a page of a finding: audit_id, check_id, page_key, final_url, problems (array), block. Pages stay rows however
many a site has; `first_fixes` takes the first few of each site and check. Every block is computed on the page's own
row; only the outlines need other pages, and those come as one short list per page.

Nulls and missing tags count as empty and leave "REPLACE:" places in the blocks. Pages without a problem have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import text as tx
from crawlscore.functions import urls
from crawlscore.functions.blocks import head_block, outline_text, preview_block
from crawlscore.operators import structured
from crawlscore.operators.checks.features import FEATURES, layered
from crawlscore.plans import element_evidence as ee
from crawlscore.plans.audit import AuditInputs
from crawlscore.plans.catalog import catalogue

COLUMNS = ["audit_id", "check_id", "page_key", "final_url", "problems", "block"]


def _rows(df: DataFrame, check: str, problems: str | Column, block: str | Column) -> DataFrame:
    def column(x: str | Column) -> Column:
        return F.expr(x) if isinstance(x, str) else x

    return df.select("audit_id", F.lit(check).alias("check_id"), "page_key", "final_url",
                     column(problems).alias("problems"), column(block).alias("block"))


def previews(inputs: AuditInputs) -> DataFrame:
    """A full set of preview tags for each page whose own is incomplete, with what it has kept."""
    pages = layered(inputs.docs, FEATURES, {
        "title", "description", "og_title", "og_description", "preview_image", "og_url", "og_type", "og_site_name",
        "twitter_card", "preview_problems", "kind_elsewhere"}).where("size(preview_problems) > 0")
    site = structured.site_facts(inputs.docs).select("audit_id", F.col("name").alias("site_name"))
    homes = inputs.docs.groupBy("audit_id").agg(F.min("page_key").alias("home_key"))
    pages = pages.join(site, "audit_id").join(homes, "audit_id")
    image = F.when(F.col("preview_image") != "", urls.absolute(F.col("final_url"), F.col("preview_image")))
    pages = pages.withColumn("image_url", F.coalesce(image, F.lit("")))
    return _rows(pages, "seo.social_tags", "preview_problems",
                 preview_block("site_name", "page_key <> home_key AND kind_elsewhere = 'article'"))


def heads(inputs: AuditInputs) -> DataFrame:
    """A complete head for each page that lacks an essential tag."""
    pages = layered(inputs.docs, FEATURES, {"title", "description", "canonicals", "lang", "robots_meta", "core_tags_missing"})
    lacking = "concat(core_tags_missing, if(lang = '', array('lang'), CAST(array() AS ARRAY<STRING>)))"
    return _rows(pages.where(f"size({lacking}) > 0"), "seo.meta_tags", lacking, head_block())


def outlines(inputs: AuditInputs) -> DataFrame:
    """The outline of each page with confusing headings, the problems marked.

    Serious ones are empty, late and repeated main headings; the rest are notes. A homepage counts as the browser saw it.
    """
    wanted = {"outline", "h1s", "empty_heading", "h1_not_first", "heading_notes"}
    keep = ["audit_id", "page_key", "final_url", *sorted(wanted)]
    seen = ee.seen_homes(inputs)
    pages = ee.swap(layered(inputs.docs, FEATURES, wanted).select(*keep),
                    None if seen is None else layered(seen, FEATURES, wanted).select(*keep), seen)
    h1s = pages.select("audit_id", "page_key", F.explode("h1s").alias("h1")).withColumn("h1", F.lower("h1"))
    repeated = h1s.join(ee.shared_h1s(inputs, seen), ["audit_id", "h1"]).groupBy("audit_id", "page_key").agg(
        F.sort_array(F.collect_set("h1")).alias("shared"))
    pages = pages.join(repeated, ["audit_id", "page_key"], "left").withColumn("shared", F.coalesce("shared", F.array().cast("array<string>")))
    problems = ("array_compact(array(CASE WHEN empty_heading THEN 'empty' END, CASE WHEN h1_not_first THEN 'late' END, "
                "CASE WHEN size(shared) > 0 THEN 'repeated' END, CASE WHEN heading_notes THEN 'notes' END))")
    return _rows(pages.where(f"size({problems}) > 0"), "seo.heading_structure", problems, outline_text("outline", "shared"))


def pictures(inputs: AuditInputs) -> DataFrame:
    """The pictures of each page that need a better description or name: address, description, what to mend."""
    features = {**FEATURES, "image_verdicts": catalogue()["seo.image_seo"].features["image_verdicts"]}
    wanted = {"judged_images", "image_verdicts"}
    keep = ["audit_id", "page_key", "final_url", *sorted(wanted)]
    seen = ee.seen_homes(inputs)
    pages = ee.swap(layered(inputs.docs, features, wanted).select(*keep),
                    None if seen is None else layered(seen, features, wanted).select(*keep), seen)
    flawed = F.filter(F.arrays_zip("judged_images", "image_verdicts"), lambda z: z["image_verdicts"]["bad"] | z["image_verdicts"]["note"])
    pages = pages.withColumn("flawed", flawed).where("size(flawed) > 0")

    def mend(z: Column) -> Column:
        alt = z["judged_images"]["alt"]
        long = tx.strip(F.coalesce(alt, F.lit("")))
        named = urls.file_stem(z["judged_images"]["src"]).rlike(fv.CAMERA_NAME)
        return F.array_compact(F.array(
            F.nullif(tx.alt_problem(alt), F.lit("")),
            F.when(F.length(long) > fv.ALT_MAX, F.lit(f"description over {fv.ALT_MAX} characters")),
            F.when(named, F.lit("file name tells nothing"))))

    def line(z: Column) -> Column:
        alt = z["judged_images"]["alt"]
        shown = F.when(alt.isNull(), "(none)").otherwise(F.concat(F.lit('"'), tx.strip(alt), F.lit('"')))
        return F.concat(z["judged_images"]["src"], F.lit("\n    alt: "), shown, F.lit("\n    mend: "), F.array_join(mend(z), "; "))

    return _rows(pages, "seo.image_seo", F.array_distinct(F.flatten(F.transform("flawed", mend))),
                 F.array_join(F.transform("flawed", line), "\n\n"))


BUILDERS = {"seo.social_tags": previews, "seo.meta_tags": heads, "seo.heading_structure": outlines, "seo.image_seo": pictures}


def page_fixes(inputs: AuditInputs, findings: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """The blocks of all pages of the sites and checks that have a finding."""
    chosen = [BUILDERS[c] for c in BUILDERS if checks is None or c in checks]
    if not chosen:
        raise ValueError("none of these checks has blocks by page")
    rows = chosen[0](inputs)
    for build in chosen[1:]:
        rows = rows.unionByName(build(inputs))
    reported = findings.where("severity <> 'pass'").select("audit_id", "check_id").distinct()
    return rows.join(reported, ["audit_id", "check_id"], "left_semi").select(*COLUMNS)


def first_fixes(fixes: DataFrame, count: int) -> DataFrame:
    """The first `count` pages of each site and check; Spark keeps each task's best before the shuffle."""
    order = Window.partitionBy("audit_id", "check_id").orderBy("page_key")
    return fixes.withColumn("fix_ord", F.row_number().over(order)).where(F.col("fix_ord") <= count)
