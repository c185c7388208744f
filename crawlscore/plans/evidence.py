"""What findings rest on, as rows beside the one row per site: pages with their values, and ready-made fixes.

Each kind of evidence is one aggregation over (audit, key) of the page table; nothing is collected into a list
per site.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv
from crawlscore.functions import text as tx
from crawlscore.operators.checks.features import FEATURES, layered
from crawlscore.plans.audit import AuditInputs

NO_NUMBER = "8801XXXXXXXXX"


def outdated_libraries(inputs: AuditInputs) -> DataFrame:
    """(audit_id, library, version, safe_version, final_url): each page that loads a library below its safe version.

    What the browser found counts for the homepage, also under other file names.
    """
    safe = F.create_map(*[F.lit(x) for name, _, version, _ in fv.LIBRARIES for x in (name, version)])
    loaded = inputs.docs.select("audit_id", "final_url", F.explode("script_libraries").alias("l")).where("l.outdated").select(
        "audit_id", F.col("l.library").alias("library"), F.col("l.version").alias("version"), "final_url")
    if inputs.renders is not None:
        homes = inputs.docs.groupBy("audit_id").agg(F.min_by("final_url", "page_key").alias("final_url"))
        seen = inputs.renders.select("audit_id", F.explode("libraries").alias("library", "version")).where(
            tx.is_outdated(F.col("library"), F.col("version")))
        loaded = loaded.unionByName(seen.join(homes, "audit_id").select("audit_id", "library", "version", "final_url"))
    return loaded.distinct().withColumn("safe_version", safe[F.col("library")])


def library_list(inputs: AuditInputs) -> DataFrame:
    """Outdated libraries of a site by name and version, with the number of pages and why the version matters."""
    notes = F.create_map(*[F.lit(x) for name, _, _, note in fv.LIBRARIES for x in (name, note)])
    return outdated_libraries(inputs).groupBy("audit_id", "library", "version", "safe_version").agg(
        F.count("*").alias("pages")).withColumn("note", notes[F.col("library")])


def description_lengths(inputs: AuditInputs) -> DataFrame:
    """Pages whose search description has the wrong length: the length, and by how much it is too long (or, negative,
    too short)."""
    pages = layered(inputs.docs, FEATURES, {"description"}).select(
        "audit_id", "page_key", "final_url", "description", F.length("description").cast("bigint").alias("length"))
    off = F.when(F.col("length") > fv.DESCRIPTION_MAX, F.col("length") - fv.DESCRIPTION_MAX).when(
        (F.col("length") > 0) & (F.col("length") < fv.DESCRIPTION_MIN), F.col("length") - fv.DESCRIPTION_MIN)
    return pages.withColumn("off_by", off).where("off_by IS NOT NULL")


def best_answer_pages(inputs: AuditInputs) -> DataFrame:
    """The page of each site with the most questions answered, the first of several, and whether they are enough to quote.

    The homepage counts as the browser saw it, where it did. A site without any question has no row.
    """
    pages = layered(inputs.docs, FEATURES, {"quotable"}).select("audit_id", "page_key", "final_url", "quotable")
    if inputs.render_docs is not None:
        homes = inputs.docs.groupBy("audit_id").agg(F.min("page_key").alias("home_key"))
        seen = layered(inputs.render_docs, FEATURES, {"quotable"}).groupBy("audit_id").agg(
            F.max("quotable").alias("seen")).join(homes, "audit_id")
        pages = pages.join(seen, "audit_id", "left").withColumn(
            "quotable", F.when(F.col("page_key") == F.col("home_key"), F.coalesce("seen", "quotable")).otherwise(F.col("quotable")))
    first = F.struct((-F.col("quotable")).alias("less"), F.col("page_key"))
    best = pages.where("quotable > 0").groupBy("audit_id").agg(
        F.min_by("final_url", first).alias("final_url"), F.max("quotable").cast("bigint").alias("answers"))
    return best.withColumn("enough", F.col("answers") >= fv.QUESTIONS_NEEDED)


def _own_numbers(inputs: AuditInputs) -> DataFrame:
    """Each site's own phone number in digits, from its homepage's call links, else from its text; null without one."""
    wanted = {"tel_links", "phones"}
    number = F.coalesce(F.get("tel_links", F.lit(0)), F.get("phones", F.lit(0)))
    homes = layered(inputs.docs, FEATURES, wanted).groupBy("audit_id").agg(
        F.min_by(F.struct(tx.digits(number).alias("number")), "page_key").alias("crawled"))
    if inputs.render_docs is None:
        return homes.select("audit_id", F.col("crawled.number").alias("number"))
    seen = layered(inputs.render_docs, FEATURES, wanted).groupBy("audit_id").agg(
        F.max(F.struct(tx.digits(number).alias("number"))).alias("seen"))
    return homes.join(seen, "audit_id", "left").select(
        "audit_id", F.when(F.col("seen").isNotNull(), F.col("seen.number")).otherwise(F.col("crawled.number")).alias("number"))


def _unlinked_numbers(inputs: AuditInputs) -> DataFrame:
    """The first number that each homepage shows without a link to call it, as the browser saw the page where it did."""
    wanted = {"tel_links", "phones"}
    same = tx.same_number

    def first(df: DataFrame) -> DataFrame:
        alone = F.filter("phones", lambda p: ~F.exists("tel_links", lambda t: same(tx.digits(p), tx.digits(t))))
        return layered(df, FEATURES, wanted).withColumn("phone", F.get(alone, F.lit(0)))

    homes = first(inputs.docs).groupBy("audit_id").agg(F.min_by(F.struct("phone"), "page_key").alias("sent"))
    if inputs.render_docs is not None:
        seen = first(inputs.render_docs).groupBy("audit_id").agg(F.max(F.struct("phone")).alias("seen"))
        homes = homes.join(seen, "audit_id", "left").withColumn("sent", F.coalesce("seen", "sent"))
    return homes.select("audit_id", "sent.phone").where("phone IS NOT NULL")


def _snippet(check_id: str, order: int, title, code, note) -> Column:
    return F.struct(F.lit(check_id).alias("check_id"), F.lit(order).alias("snippet_ord"),
                    *[(v if not isinstance(v, str) else F.lit(v)).alias(k) for k, v in (("title", title), ("code", code), ("note", note))])


def snippets(findings: DataFrame, inputs: AuditInputs) -> DataFrame:
    """(audit_id, check_id, snippet_ord, title, code, note): fixes to paste for the findings at hand.

    A chat link with the site's own number, a link that dials a number shown as plain text, the mail records that a domain lacks,
    a security.txt, and frames for questions and for a customer's words. Blocks by page are in `page_fixes`.
    Only a site with the finding gets its fix; facts that are unknown leave placeholders.
    """
    reported = findings.where(F.col("severity") != "pass").select("audit_id", "check_id").distinct()
    own = _own_numbers(inputs)
    known = F.col("number").isNotNull() & (F.col("number") != "")
    chat = own.select("audit_id", _snippet(
        "seo.whatsapp_chat", 1, "A WhatsApp chat link",
        F.concat(F.lit('<a href="https://wa.me/'), F.when(known, F.col("number")).otherwise(NO_NUMBER),
                 F.lit('?text=Hi%2C%20I%20have%20a%20question">Chat on WhatsApp</a>')),
        F.when(known, "Check the number: it must include the country code.").otherwise(
            "Put your number, with the country code, in place of the X's.")).alias("s"))
    answers = own.select("audit_id", _snippet(
        "agentic.answer_ready", 1, "Questions and answers",
        "<section>\n  <h2>Frequently asked questions</h2>\n  <details>\n    <summary>REPLACE: a question?</summary>\n"
        "    <p>REPLACE: a short answer.</p>\n  </details>\n</section>", "One block for each question that customers ask.").alias("s"))
    quote = own.select("audit_id", _snippet(
        "best_practices.social_proof", 1, "A customer's words",
        "<figure>\n  <blockquote>REPLACE: what the customer said.</blockquote>\n  <figcaption>REPLACE: name and business</figcaption>\n</figure>",
        "Style it as you like; three short ones say more than a long one.").alias("s"))
    dial = F.when(F.col("phone").startswith("+"), F.concat(F.lit("+"), F.ltrim(tx.digits(F.col("phone")), F.lit("0")))).otherwise(tx.digits(F.col("phone")))
    call = _unlinked_numbers(inputs).select("audit_id", _snippet(
        "seo.click_to_call", 1, "A link that dials", F.concat(F.lit('<a href="tel:'), dial, F.lit('">'), "phone", F.lit("</a>")),
        "It looks the same; phones dial when it is tapped.").alias("s"))
    parts = [chat, answers, quote, call]
    if inputs.security_facts is not None:
        facts = inputs.security_facts
        year = F.year(F.lit(inputs.as_of).cast("timestamp")) + 1
        parts.append(facts.select("audit_id", _snippet(
            "best_practices.security_txt", 1, "/.well-known/security.txt", F.concat(
                F.lit("Contact: mailto:security@"), "domain", F.lit("\nExpires: "), year.cast("string"), F.lit("-12-31T23:59:59Z")),
            "Use an address that somebody reads, and renew the date in time.").alias("s")))
        if "has_mx" not in facts.columns:
            facts = facts.withColumn("has_mx", F.lit(None).cast("boolean"))
        lacks_spf = F.coalesce("spf", F.lit("")) == ""
        dmarc = F.lower(F.replace(F.coalesce("dmarc", F.lit("")), F.lit(" "), F.lit("")))
        receives = F.coalesce("has_mx", F.lit(False))
        spf = _snippet(
            "best_practices.email_spoofing", 1, F.concat(F.lit("SPF: a TXT record on "), "domain"),
            F.when(receives, "v=spf1 include:_spf.google.com ~all").otherwise("v=spf1 -all"),
            F.when(receives, "An example: use the line that your mail provider gives you.").otherwise(
                "The domain receives no mail, so nobody may send in its name."))
        policy = _snippet(
            "best_practices.email_spoofing", 2, F.concat(F.lit("DMARC: a TXT record on _dmarc."), "domain"),
            F.concat(F.lit("v=DMARC1; p=quarantine; rua=mailto:dmarc@"), "domain"),
            "Mail that fails SPF goes to spam; use p=reject once your own mail passes.")
        fixes = F.array_compact(F.array(F.when(lacks_spf, spf), F.when((dmarc == "") | dmarc.contains("p=none"), policy)))
        parts.append(facts.select("audit_id", F.explode(fixes).alias("s")))
    rows = reduce(DataFrame.unionByName, parts).select("audit_id", "s.*").distinct()
    return rows.join(reported, ["audit_id", "check_id"], "left_semi")


def with_snippets(findings: DataFrame, inputs: AuditInputs) -> DataFrame:
    """Findings with a `snippets` array (empty without one); a finding has two at most."""
    rows = snippets(findings, inputs).groupBy("audit_id", "check_id").agg(
        F.sort_array(F.collect_list(F.struct("snippet_ord", "title", "code", "note"))).alias("snippets"))
    empty = F.array().cast(rows.schema["snippets"].dataType)
    joined = findings.join(rows, ["audit_id", "check_id"], "left")
    return joined.withColumn("snippets", F.when(F.col("severity") == "pass", empty).otherwise(F.coalesce("snippets", empty)))
