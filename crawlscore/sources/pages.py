"""The crawled pages: derived columns, filter, extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import elements as el
from crawlscore.functions import text as tx
from crawlscore.sources import html

HTML_TYPES = ["text/html", "application/xhtml+xml"]
DOCTYPE = r"(?is)^\x{FEFF}*\s*(<!--.*?-->\s*)*<!doctype html"


def content_type(headers: Column) -> Column:
    return F.trim(F.lower(F.split_part(
        F.coalesce(headers["content-type"], F.lit("")), F.lit(";"), F.lit(1))))


def scan_pages(pages: DataFrame) -> DataFrame:
    """Pages with their content type, HTML flag and success flag."""
    kind = content_type(F.col("headers"))
    return pages.withColumns({
        "content_type": kind,
        "is_html": kind.isin(HTML_TYPES),
        "ok": F.col("status_code").between(200, 299),
    })


def html_pages(pages: DataFrame) -> DataFrame:
    return scan_pages(pages).where("is_html")


def _derived_document_columns(docs: DataFrame) -> DataFrame:
    docs = docs.withColumn("visible_phones", tx.phones_in(F.col("visible_text")))
    sources = docs.withColumn("__scripts", F.expr(el.script_sources("elements")))
    return sources.withColumn(
        "script_libraries",
        F.flatten(F.transform("__scripts", lambda src: tx.detected_libraries(src))),
    ).drop("__scripts")


def spread(df: DataFrame, parts: int | None) -> DataFrame:
    """Rows dealt out to `parts` partitions, or left where they are.

    A parse is far dearer than a shuffle of the text it reads, so a table of a few large files
    should not keep the cluster idle.
    """
    return df if parts is None else df.repartition(parts)


def page_docs(pages: DataFrame, parts: int | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per HTML page: keys, headers, the columns to `keep`, and everything its document says.

    The doctype and encoding tests read the raw text inside the JVM, before the text is
    handed to the parser; the text itself is not carried on.
    """
    head = F.lower(F.substring("text", 1, 1024))
    prepared = html_pages(pages).select(
        "audit_id", "page_key", "url", "final_url", "status_code", "headers", *keep,
        F.col("text").rlike(DOCTYPE).alias("has_doctype"),
        (
            head.contains("<meta charset")
            | (head.contains("http-equiv") & head.contains("charset="))
        ).alias("charset_in_head"),
        "text",
    )
    return _derived_document_columns(html.extract(spread(prepared, parts)))


def render_docs(renders: DataFrame, parts: int | None = None) -> DataFrame:
    """The documents a browser saw, extracted like crawled ones: one homepage per site."""
    prepared = renders.select(
        "audit_id", F.col("url").alias("final_url"),
        F.create_map().cast("map<string,string>").alias("headers"),
        F.lit(True).alias("has_doctype"), F.lit(True).alias("charset_in_head"),
        F.col("html").alias("text"),
    )
    return _derived_document_columns(html.extract(spread(prepared, parts)))


# --- bot-protection pages ------------------------------------------------------------------------


def checkpoint_provider(status: Column, headers: Column, text: Column, short_page: int | None) -> Column:
    """Name of the firewall that answered instead of the site, '' if unknown, null if none.

    Markers count anywhere in the text. The caller says which answers may be checkpoints at all: besides refusals
    those shorter than `short_page` characters (the audit's rule is `fv.SHORT_PAGE`), or all of them with None.
    """
    head = F.lower(text)
    refused = status.isin(403, 429, 503)
    suspicious = F.lit(True) if short_page is None else refused | (F.length(text) < short_page)
    phrase = F.lit(False)
    for words in fv.CHECKPOINT_PHRASES:
        phrase = phrase | head.contains(words)
    vercel = F.lower(F.coalesce(headers["x-vercel-mitigated"], F.lit("")))
    cloudflare = F.lower(F.coalesce(headers["cf-mitigated"], F.lit("")))
    return (
        F.when(vercel.isin("challenge", "deny"), "Vercel")
        .when(cloudflare == "challenge", "Cloudflare")
        .when(head.contains("vercel security checkpoint"), "Vercel")
        .when(~suspicious, F.lit(None))
        .when(head.contains("cf-chl") | head.contains("challenge-platform"), "Cloudflare")
        .when(head.contains("sgcaptcha"), "SiteGround")
        .when(head.contains("imunify"), "Imunify360")
        .when(phrase | (refused & head.contains("captcha")), "")
    )
