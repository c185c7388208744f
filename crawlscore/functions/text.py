"""Text, number and wording functions on columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from crawlscore import fixed_values as fv


def _lookup(mapping: dict[str, object], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, key)


def strip(text: Column) -> Column:
    """Without white space at both ends (trim alone only drops blanks)."""
    return F.btrim(text, F.lit(" \t\n\r\f\v"))


# --- images and phones -----------------------------------------------------------------------


def alt_problem(alt: Column) -> Column:
    """What is wrong with an alt text ('' is nothing); null means the attribute is absent."""
    text = strip(alt)
    generic = F.regexp_replace(F.lower(text), r"^[ .]+|[ .]+$", "").isin(fv.GENERIC_ALT)
    return (
        F.when(alt.isNull(), fv.ALT_NONE)
        .when(text == "", "")
        .when(generic, F.concat(F.lit('alt text "'), text, F.lit('" says nothing')))
        .when(text.rlike(fv.IMAGE_FILE) | text.rlike(fv.CAMERA_NAME), fv.ALT_FILE_NAME)
        .otherwise("")
    )


def digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def same_number(a: Column, b: Column) -> Column:
    return (F.length(a) >= 9) & (F.length(b) >= 9) & (F.right(a, F.lit(9)) == F.right(b, F.lit(9)))


def phones_in(text: Column) -> Column:
    """Phone numbers as written, first spelling of each number, in order of appearance."""
    found = F.transform(F.regexp_extract_all(text, F.lit(fv.PHONE), F.lit(0)), strip)

    def plausible(raw: Column) -> Column:
        number = digits(raw)
        return (
            F.length(number).between(9, 15)
            & (raw.rlike(r"^[+0(]") | raw.contains(" ") | raw.contains("-"))
            & ~number.rlike(r"^(19|20)\d{6,}$")
        )

    def add(kept: Column, raw: Column) -> Column:
        known = F.exists(kept, lambda old: same_number(digits(old), digits(raw)))
        return F.when(known, kept).otherwise(F.concat(kept, F.array(raw)))

    return F.aggregate(
        F.filter(found, plausible), F.array().cast("array<string>"), add
    )


def has_email(text: Column) -> Column:
    return text.rlike(fv.EMAIL_SIGN)


def copyright_years(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(fv.COPYRIGHT_YEAR), F.lit(1)), lambda y: y.cast("int")
    )


# --- script libraries --------------------------------------------------------------------------


def version_tuple(text: Column) -> Column:
    """'3.10.1' as an array of numbers; arrays compare from the left like versions do."""
    parts = F.filter(F.split(text, r"\."), lambda part: part.rlike(r"^\d+$"))
    return F.transform(parts, lambda part: part.cast("int"))


def library_version(src: Column, library: str) -> Column:
    """The version of one library named in a script address, by the first pattern that hits."""
    patterns = next(p for name, p, _, _ in fv.LIBRARIES if name == library)
    return F.coalesce(
        *[F.nullif(F.regexp_extract(src, pattern, 1), F.lit("")) for pattern in patterns]
    )


def detected_libraries(src: Column) -> Column:
    """Array of (library, version, outdated) found in a lower-cased script address."""
    found = []
    for name, _, safe_from, _ in fv.LIBRARIES:
        version = library_version(src, name)
        found.append(
            F.when(
                version.isNotNull(),
                F.struct(
                    F.lit(name).alias("library"), version.alias("version"),
                    is_outdated(F.lit(name), version).alias("outdated"),
                ),
            )
        )
    return F.array_compact(F.array(*found))


def is_outdated(library: Column, version: Column) -> Column:
    """Below the first safe version; false for libraries without a known one."""
    safe = _lookup({name: safe_from for name, _, safe_from, _ in fv.LIBRARIES}, library)
    return F.coalesce(version_tuple(version) < version_tuple(safe), F.lit(False))


# --- numbers, scores and words -----------------------------------------------------------------


def round_half_up(value: Column) -> Column:
    return F.floor(value + F.lit(0.5)).cast("int")


def duration(minutes: Column) -> Column:
    """Minutes in plain words; halves go to the even number."""
    hours = F.bround(minutes / 60.0, 0).cast("int")
    days = F.bround(minutes / float(fv.WORKDAY_MINUTES), 0).cast("int")

    def counted(number: Column, unit: str) -> Column:
        return F.when(number == 1, f"about 1 {unit}").otherwise(
            F.concat(F.lit("about "), number.cast("string"), F.lit(f" {unit}s"))
        )

    return (
        F.when(minutes < 60, F.concat(F.lit("about "), minutes.cast("string"), F.lit(" minutes")))
        .when(minutes < fv.WORKDAY_MINUTES * 1.5, counted(hours, "hour"))
        .otherwise(counted(days, "day"))
    )


def on_pages(count: Column, total: Column, has: str | Column, have: str | Column) -> Column:
    """The opening of a sentence about how many pages are affected."""
    has = F.lit(has) if isinstance(has, str) else has
    have = F.lit(have) if isinstance(have, str) else have
    return (
        F.when(total == 1, F.concat(F.lit("Your homepage "), has))
        .when(count == total, F.concat(F.lit("All "), total, F.lit(" pages we checked "), have))
        .otherwise(
            F.concat(
                count, F.lit(" of the "), total, F.lit(" pages we checked "),
                F.when(count == 1, has).otherwise(have),
            )
        )
    )


def share_score(total: Column, fails: Column, warns: Column | None = None) -> Column:
    """Partial credit: 1 when nothing has the problem, 0 when everything fails."""
    warns = F.lit(0) if warns is None else warns
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - (fails + F.lit(0.5) * warns) / total)
    )


def band(score: Column) -> Column:
    """urgent / attention / healthy; null when there is no score."""
    return (
        F.when(score < fv.URGENT_BELOW, "urgent")
        .when(score < fv.HEALTHY_FROM, "attention")
        .when(score.isNotNull(), "healthy")
    )


def band_label(score: Column) -> Column:
    return F.coalesce(_lookup(fv.BAND_LABELS, band(score)), F.lit("Not checked"))


def severity_label(severity: Column) -> Column:
    return F.coalesce(_lookup(fv.SEVERITY_LABELS, severity), severity)


def severity_band(severity: Column) -> Column:
    return F.coalesce(_lookup(fv.SEVERITY_BANDS, severity), F.lit("none"))


# --- scanner explanations ------------------------------------------------------------------------


def contrast_facts(note: Column) -> Column:
    """Ratio, colours and expected ratio of a colour-contrast explanation; null if none."""
    colour = "#(?:[0-9a-fA-F]{3}){1,2}"
    pattern = (
        rf"contrast of ([0-9.]+) \(foreground color: ({colour}), "
        rf"background color: ({colour}).*?Expected contrast ratio of ([0-9.]+:1)"
    )
    names = ["ratio", "fg", "bg", "expected"]
    return F.when(
        note.rlike(pattern),
        F.struct(*[F.regexp_extract(note, pattern, i).alias(n) for i, n in enumerate(names, 1)]),
    )


def problem_text(summary: Column) -> Column:
    """A scanner explanation on one line, without its 'Fix ...' headings."""
    lines = F.transform(F.split(summary, r"\r\n|\r|\n"), strip)
    kept = F.filter(lines, lambda line: (line != "") & ~F.lower(line).startswith("fix "))
    return F.array_join(kept, " ")


# --- lists, escaping, slugs ---------------------------------------------------------------------


def first_items(items: Column, count: int = 5) -> Column:
    return F.slice(items, 1, count)


def remaining(items: Column, count: int = 5) -> Column:
    return F.greatest(F.size(items) - count, F.lit(0))


def html_escape(text: Column, quote: bool = True) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")]
    if quote:
        pairs += [('"', "&quot;"), ("'", "&#x27;")]
    for plain, escaped in pairs:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def safe_cell(text: Column) -> Column:
    """A CSV cell that a spreadsheet will not read as a formula."""
    value = F.coalesce(text, F.lit(""))
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def humanize(slug: Column) -> Column:
    words = F.trim(F.regexp_replace(slug, "[-_]+", " "))
    text = F.concat(F.upper(F.left(words, F.lit(1))), F.lower(F.substr(words, F.lit(2))))
    return F.when(text == "", slug).otherwise(text)


def _last_split(title: Column, separator: str) -> tuple[Column, Column]:
    pieces = F.split(title, separator.replace("|", r"\|"))
    tail = F.element_at(pieces, -1)
    head = F.substring(title, F.lit(1), F.length(title) - F.length(tail) - len(separator))
    return head, tail


def site_name_from_title(title: Column) -> Column:
    """What stands after the last separator of a title, or the whole title."""
    result = F.trim(title)
    for separator in reversed(fv.TITLE_SEPARATORS):
        _, tail = _last_split(title, separator)
        result = F.when(title.contains(separator), F.trim(tail)).otherwise(result)
    return result


def title_without_site(title: Column, site_name: Column) -> Column:
    """A title without its trailing site name."""
    result = title
    for separator in reversed(fv.TITLE_SEPARATORS):
        head, tail = _last_split(title, separator)
        ends = title.contains(separator) & F.lower(tail).contains(F.lower(site_name))
        result = F.when(ends & (site_name != ""), head).otherwise(result)
    return F.trim(result)


# --- visitor hash ------------------------------------------------------------------------------


def hash_ip(ip: Column, salt: str) -> Column:
    """HMAC-SHA256 of an address, from two SHA-256 calls over padded keys."""
    key = salt.encode()
    if len(key) > 64:
        raise ValueError("the salt must be at most 64 bytes")
    key = key.ljust(64, b"\0")
    inner = bytes(b ^ 0x36 for b in key)
    outer = bytes(b ^ 0x5C for b in key)
    first = F.sha2(F.concat(F.lit(inner), F.encode(ip, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(outer), F.unhex(first)), 256)
