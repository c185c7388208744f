"""Bringing one's own checks, page logic and collectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.plans.audit import AuditInputs, capabilities
from crawlscore.plans.catalog import catalogue, register, unregister

__all__ = ["catalogue", "outline", "page_logic", "register", "register_page_logic", "unregister", "with_collector"]


def with_collector(inputs: AuditInputs, name: str, table: DataFrame) -> AuditInputs:
    """Inputs plus a table of one's own (one row per audit) and the capability of its name."""
    own = table.selectExpr(
        "audit_id", f"'{name}' AS capability", "true AS available",
        "CAST(NULL AS STRING) AS reason").distinct()
    known = capabilities(inputs).select(
        "audit_id", F.explode("caps").alias("capability"), F.lit(True).alias("available"),
        F.lit(None).cast("string").alias("reason"))
    return replace(
        inputs, capabilities=known.unionByName(own), extra={**inputs.extra, name: table})


def page_logic(logic: Callable[[str], Iterator[str]], key: str = "bigint"):
    """A table function over batches of pages: (page, part) rows from a table of page keys and HTML, in this order.

    Arrow batches come in and tables go out, in the partitions the pages are in. A page without HTML, or one that
    `logic` finds nothing in, gives no row; the key may be null.
    """

    @F.arrow_udtf(returnType=f"page {key}, part string")
    class Parts:
        def eval(self, batch: pa.RecordBatch) -> Iterator[pa.Table]:
            keys, parts = [], []
            pages = batch.column(0)
            for page, text in zip(pages.to_pylist(), batch.column(1).to_pylist()):
                found = list(logic(text)) if text else []
                keys += [page] * len(found)
                parts += found
            yield pa.table({"page": pa.array(keys, pages.type), "part": pa.array(parts, pa.string())})

    return Parts


def register_page_logic(spark: SparkSession, name: str, logic: Callable[[str], Iterator[str]], key: str = "bigint") -> None:
    """Makes `logic` callable in SQL as `name(TABLE(SELECT page, html ...))`; Spark has no LATERAL for Arrow functions yet."""
    spark.udtf.register(name, page_logic(logic, key))


class _Outline(HTMLParser):
    """The large parts of a page that a reader can see, each with its nesting."""

    LARGE = ("nav", "footer", "article", "main", "aside")

    def __init__(self):
        super().__init__()
        self.open: list[str] = []
        self.found: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.LARGE:
            self.open.append(tag)
            self.found.append(" > ".join(self.open))

    def handle_endtag(self, tag):
        if tag in self.open:
            while self.open.pop() != tag:
                pass


def outline(text: str) -> Iterator[str]:
    """An example that needs a parser's state: the large parts of a page with those around them."""
    parser = _Outline()
    parser.feed(text)
    return iter(parser.found)
