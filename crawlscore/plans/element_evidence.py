"""Elements that findings are about, as rows: where each stands, and what to call it.

A row is one element of one finding: audit_id, check_id, code, lead, page_key, final_url, place, shot. Elements of a
finding are ordered by (lead, page_key, place); `lead` is the broken address where there is one, else ''. The homepage
counts as the browser saw it, where it did. Only flagged elements leave their page's row, so nothing wide is
shuffled, and no list is built per site or finding unless a caller asks for the first few (`with_shots`).

Nulls: an element without the attribute a rule reads counts as having an empty one. Sites without a finding have no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlscore.functions import elements as el
from crawlscore.functions import urls
from crawlscore.operators.checks.features import FEATURES, WORD, layered
from crawlscore.plans.audit import AuditInputs
from crawlscore.plans.catalog import catalogue
from crawlscore.plans.side_tables import INTERNAL_BROKEN, SURELY_BROKEN

KEY = ["audit_id", "check_id", "code"]
COLUMNS = [*KEY, "lead", "page_key", "final_url", "place", "shot"]
_SOURCE = f"trim(coalesce(nullif({el.attr('src')}, ''), {el.strip(el.attr('data-src'))}))"
_LEVEL = "CAST(right({}.tag, 1) AS INT)"
_EMPTY_H1_FIRST = "get(outline, i).text = '' OR (e.tag = 'h1' AND i > 0 AND get(outline, 0).level <> 1)"

LISTS = {
    "several_h1s": "size(h1s) > 1",  # as the server sent it; the browser's page carries the answer along
    "heading_elements": el.tagged("elements", "h1", "h2", "h3", "h4", "h5", "h6"),
    "image_elements": el.tagged("elements", "img"),
    "judged_elements": f"filter(image_elements, e -> {_SOURCE} <> '' AND NOT startswith({_SOURCE}, 'data:'))",
}
#: (check, code) -> the flagged elements of a page as the browser left it
SEEN = {
    ("seo.single_h1", "several"): "filter(heading_elements, e -> several_h1s AND e.tag = 'h1')",
    ("seo.image_seo", "bad_alt"): "filter(judged_elements, (e, i) -> get(image_verdicts, i).bad)",
    ("seo.image_seo", "notes"):
        "filter(judged_elements, (e, i) -> NOT get(image_verdicts, i).bad AND get(image_verdicts, i).note)",
    ("accessibility.image_alt", "missing"): f"filter(image_elements, e -> NOT {el.has_attr('alt')})",
    ("accessibility.heading_order", "skipped"):
        f"filter(heading_elements, (e, i) -> i > 0 AND {_LEVEL.format('e')} > get(outline, i - 1).level + 1)",
    ("accessibility.form_labels", "unlabelled"): el.unlabelled_fields("elements"),
    ("accessibility.accessible_names", "nameless"):
        f"concat({el.nameless_controls('elements')}, filter({el.push_inputs('elements')}, "
        f"e -> {el.strip(el.attr('value'))} = ''))",
    ("performance.image_dimensions", "unsized"):
        f"filter(image_elements, e -> NOT startswith({el.attr('src')}, 'data:') AND "
        f"({el.attr('width')} = '' OR {el.attr('height')} = ''))",
}
_MIXED = ("filter(elements, e -> is_https AND e.tag IN ('img', 'iframe', 'video', 'audio') AND "
          f"startswith({el.attr('src')}, 'http://'))")
#: the same for pages as the server sent them
SENT = {("best_practices.mixed_content", code): _MIXED for code in ("active", "passive")}
#: check -> kind of address, when it is broken, and the element that points at it
POINTING = {
    "seo.broken_links": ("internal", INTERNAL_BROKEN, "a", "href"),
    "seo.broken_external_links": ("external", SURELY_BROKEN, "a", "href"),
    "seo.broken_images": ("image", SURELY_BROKEN, "img", "src"),
}
OUTLINE_CHECK = ("seo.heading_structure", "serious")


def _flagged(pages: DataFrame, lists: dict[tuple[str, str], str], outline: bool, **columns) -> DataFrame:
    """One row per flagged element; `h1` is set where it counts only if other pages have the same main heading."""
    features = {**FEATURES, **LISTS, "image_verdicts": catalogue()["seo.image_seo"].features["image_verdicts"]}
    entries = [
        f"transform({sql}, (e, i) -> named_struct('check_id', '{check}', 'code', '{code}', 'place', i, 'h1', CAST(NULL AS STRING), "
        f"'shot', {el.shot('e', 'final_url')}))" for (check, code), sql in lists.items()]
    wanted = {w for sql in lists.values() for w in WORD.findall(sql)} | ({"outline", "heading_elements"} if outline else set())
    if outline:
        check, code = OUTLINE_CHECK
        entries.append(
            "filter(transform(heading_elements, (e, i) -> CASE WHEN " + _EMPTY_H1_FIRST + " OR e.tag = 'h1' THEN named_struct("
            f"'check_id', '{check}', 'code', '{code}', 'place', i, 'h1', "
            f"CASE WHEN NOT ({_EMPTY_H1_FIRST}) THEN lower(get(outline, i).text) END, 'shot', {el.shot('e', 'final_url')}) END), "
            "s -> s IS NOT NULL)")
    wide = layered(pages, features, wanted)
    rows = wide.selectExpr("audit_id", "page_key", "final_url", f"inline(concat({', '.join(entries)}))")
    return rows.withColumns({"lead": F.lit(""), **columns})


def shared_h1s(inputs: AuditInputs, seen: DataFrame | None) -> DataFrame:
    """(audit_id, h1): main headings that occur twice in a site; a homepage counts as seen instead of as sent."""
    def texts(df: DataFrame, h1s: str, weight: int) -> DataFrame:
        return df.selectExpr("audit_id", f"explode({h1s}) AS h1", f"{weight} AS n").where("h1 <> ''").withColumn("h1", F.lower("h1"))

    rows = texts(layered(inputs.docs, FEATURES, {"h1s"}), "h1s", 1)
    if seen is not None:
        rows = rows.unionByName(texts(seen, "sent_h1s", -1)).unionByName(texts(layered(seen, FEATURES, {"h1s"}), "h1s", 1))
    return rows.groupBy("audit_id", "h1").agg(F.sum("n").alias("n")).where("n > 1").drop("n")


def seen_homes(inputs: AuditInputs) -> DataFrame | None:
    """Homepages as the browser left them, with the key they have among the pages and the main headings as sent."""
    if inputs.render_docs is None:
        return None
    homes = layered(inputs.docs, FEATURES, {"h1s"}).groupBy("audit_id").agg(
        F.min("page_key").alias("page_key"), F.min_by("final_url", "page_key").alias("sent_url"), F.min_by("h1s", "page_key").alias("sent_h1s"))
    pages = inputs.render_docs.drop("page_key").join(homes, "audit_id")
    return pages.withColumn("final_url", F.col("sent_url")).withColumn("several_h1s", F.expr("size(sent_h1s) > 1"))


def swap(rows: DataFrame, seen_rows: DataFrame | None, seen: DataFrame | None) -> DataFrame:
    """Rows of the homepage as sent give way to those of the homepage as seen."""
    if seen is None:
        return rows
    return rows.join(seen.select("audit_id", "page_key").distinct(), ["audit_id", "page_key"], "left_anti").unionByName(seen_rows)


def _pointing(inputs: AuditInputs, seen: DataFrame | None, check: str) -> DataFrame:
    """The first element in page order that points at each broken address; `lead` is the address."""
    kind, broken, tag, attribute = POINTING[check]
    bad = inputs.url_status.where(f"kind = '{kind}' AND {broken}").select("audit_id", F.col("url").alias("lead")).distinct()

    def aimed(pages: DataFrame) -> DataFrame:
        spots = pages.selectExpr(
            "audit_id", "page_key", "final_url", f"posexplode(filter(elements, e -> e.tag = '{tag}' AND {el.has_attr(attribute)})) AS (place, e)")
        value = urls.without_fragment(urls.absolute(F.col("final_url"), F.coalesce(F.col("e.attrs")[attribute], F.lit(""))))
        return spots.withColumn("lead", value).selectExpr(
            "audit_id", "page_key", "final_url", "place", "lead", f"{el.shot('e', 'final_url')} AS shot").where("lead IS NOT NULL")

    hits = swap(aimed(inputs.docs), None if seen is None else aimed(seen), seen).join(bad, ["audit_id", "lead"], "left_semi")
    first = hits.groupBy("audit_id", "lead").agg(
        F.min_by(F.struct("page_key", "final_url", "place", "shot"), F.struct("page_key", "place")).alias("s"))
    return first.select("audit_id", F.lit(check).alias("check_id"), F.lit("broken").alias("code"), "lead", "s.*").select(*COLUMNS)


def finding_elements(inputs: AuditInputs, findings: DataFrame, checks: list[str] | None = None) -> DataFrame:
    """Every element that a finding of `findings` is about; `checks` limits which checks are looked at."""
    def chosen(check: str) -> bool:
        return checks is None or check in checks

    seen = seen_homes(inputs)
    lists = {k: v for k, v in SEEN.items() if chosen(k[0])}
    outline = chosen(OUTLINE_CHECK[0])
    parts = []
    if lists or outline:
        rows = swap(_flagged(inputs.docs, lists, outline), None if seen is None else _flagged(seen, lists, outline), seen)
        if outline:
            # rows that depend on no other page are spread by page, not gathered under one empty key
            shared = shared_h1s(inputs, seen).withColumnRenamed("h1", "text").withColumn("is_shared", F.lit(True))
            rows = rows.withColumn("text", F.coalesce("h1", F.concat(F.lit("\0"), F.col("page_key.id").cast("string"))))
            rows = rows.join(shared, ["audit_id", "text"], "left").where("h1 IS NULL OR is_shared")
        parts.append(rows.select(*COLUMNS))
    sent = {k: v for k, v in SENT.items() if chosen(k[0])}
    if sent:
        parts.append(_flagged(inputs.docs, sent, False).select(*COLUMNS))
    if inputs.url_status is not None:
        parts += [_pointing(inputs, seen, check) for check in POINTING if chosen(check)]
    if not parts:
        raise ValueError("none of these checks names elements")
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    reported = findings.where("severity <> 'pass'").select(*KEY).distinct()
    return rows.join(reported, KEY, "left_semi").select(*COLUMNS)


def ranked_for_evidence(elements: DataFrame, findings: DataFrame) -> DataFrame:
    """Elements with their finding's severity and place in the report, as `treatment.evidence` reads them."""
    of = findings.where("severity <> 'pass'").select(*KEY, "severity", "check_ord", "finding_ord")
    return elements.join(of, KEY).withColumn("shot_ord", F.struct("lead", "page_key", "place"))


def with_shots(findings: DataFrame, elements: DataFrame, count: int) -> DataFrame:
    """Findings with `shots`, their first `count` elements (empty without any).

    Spark keeps each task's best `count` rows of a finding before the shuffle, so a finding of any size fits.
    """
    order = Window.partitionBy(*KEY).orderBy("lead", "page_key", "place")
    few = elements.withColumn("shot_ord", F.row_number().over(order)).where(F.col("shot_ord") <= count)
    lists = few.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("shot_ord", "shot"))).alias("s")).select(
        *KEY, F.col("s.shot").alias("shots"))
    empty = F.array().cast(lists.schema["shots"].dataType)
    return findings.join(lists, KEY, "left").withColumn("shots", F.coalesce("shots", empty))
