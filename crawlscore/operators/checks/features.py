"""Page features: what the checks read from one page.

Every entry is SQL over the page's own row (document columns or other features). The same
features are computed for crawled documents and for rendered ones. Only the features some
selected check needs are computed.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from crawlscore import fixed_values as fv
from crawlscore.functions import elements as el
from crawlscore.functions import jsonld as jl


def header(name: str) -> str:
    return f"trim(coalesce(headers['{name}'], ''))"


ELEMENT_FEATURES = {
    "title": el.title("elements"),
    "description": el.meta("elements", "name", "description"),
    "viewport": el.meta("elements", "name", "viewport"),
    "canonicals": el.canonical_hrefs("elements"),
    "robots_meta": el.meta("elements", "name", "robots"),
    "googlebot_meta": el.meta("elements", "name", "googlebot"),
    "referrer_meta": el.meta("elements", "name", "referrer"),
    "csp_meta": el.meta("elements", "http-equiv", "content-security-policy"),
    "refresh_meta": el.meta("elements", "http-equiv", "refresh"),
    "content_type_meta": el.meta("elements", "http-equiv", "content-type"),
    "author": el.meta("elements", "name", "author"),
    "og_title": el.meta("elements", "property", "og:title"),
    "og_description": el.meta("elements", "property", "og:description"),
    "og_image": el.meta("elements", "property", "og:image"),
    "og_url": el.meta("elements", "property", "og:url"),
    "og_type": el.meta("elements", "property", "og:type"),
    "og_site_name": el.meta("elements", "property", "og:site_name"),
    "twitter_card": el.meta("elements", "name", "twitter:card"),
    "twitter_image": el.meta("elements", "name", "twitter:image"),
    "published": el.meta("elements", "property", "article:published_time"),
    "modified": el.meta("elements", "property", "article:modified_time"),
    "first_time": el.first_time("elements"),
    "price": el.meta("elements", "property", "product:price:amount"),
    "currency": el.meta("elements", "property", "product:price:currency"),
    "charset_tag": f"exists(elements, e -> e.tag = 'meta' AND {el.has_attr('charset')})",
    "lang": el.html_lang("elements"),
    "outline": el.headings("elements"),
    "images": el.images("elements"),
    "controls_total": f"size({el.controls('elements')})",
    "controls_nameless": f"size({el.nameless_controls('elements')})",
    "push_inputs": f"size({el.push_inputs('elements')})",
    "push_inputs_nameless": (
        f"size(filter({el.push_inputs('elements')}, e -> {el.strip(el.attr('value'))} = ''))"
    ),
    "fields_total": f"size({el.form_fields('elements')})",
    "fields_unlabelled": f"size({el.unlabelled_fields('elements')})",
    "tel_links": el.link_targets("elements", "tel:"),
    "mail_links": el.link_targets("elements", "mailto:"),
    "has_whatsapp": el.has_link_to("elements", fv.WHATSAPP_SIGNS),
    "has_map": el.has_link_to("elements", fv.MAP_SIGNS),
    "has_privacy_link": el.link_matches("elements", fv.PRIVACY),
    "has_about_link": el.link_matches("elements", fv.ABOUT_LINK),
    "has_contact_form": el.contact_form("elements"),
    "profiles": el.social_profiles("elements"),
    "questions": el.question_pairs("elements"),
    "json_blocks": el.json_ld_blocks("elements"),
    "scripts": el.script_sources("elements"),
    "active_mixed": el.mixed_content("elements", active=True),
    "passive_mixed": el.mixed_content("elements", active=False),
    "blocking_scripts": f"size({el.blocking_head_scripts('elements')})",
    "has_main": el.landmark("elements", "main", "main"),
    "has_nav": el.landmark("elements", "nav", "navigation"),
    "has_header": el.landmark("elements", "header", "banner"),
    "has_footer": el.landmark("elements", "footer", "contentinfo"),
    "icon": (
        "coalesce(get(array_compact(array("
        f"nullif(get(transform({el.links_with_rel('elements', 'apple-touch-icon')}, e -> {el.attr('href')}), 0), ''), "
        f"nullif(get(transform({el.links_with_rel('elements', 'icon')}, e -> {el.attr('href')}), 0), ''))), 0), '')"
    ),
    "first_phone": el.link_value("elements", "tel:"),
    "first_mail": el.link_value("elements", "mailto:"),
}

# built on element features
DEPENDENT_FEATURES = {
    "h1s": "transform(filter(outline, h -> h.level = 1), h -> h.text)",
    "h1_count": "size(h1s)",
    "empty_heading": "exists(outline, h -> h.text = '')",
    "h1_not_first": "size(h1s) > 0 AND get(outline, 0).level <> 1",
    "level_skipped": el.skips_level("outline"),
    "heading_notes": (
        "size(outline) > 0 AND (size(h1s) <> 1 OR level_skipped OR "
        f"exists(h1s, t -> length(t) > {fv.H1_MAX}) OR "
        f"(body_words >= {fv.LONG_PAGE_WORDS} AND NOT exists(outline, h -> h.level = 2)))"
    ),
    "real_images": "filter(images, i -> NOT startswith(i.raw_src, 'data:'))",
    "judged_images": (
        "filter(transform(images, i -> struct(coalesce(nullif(i.raw_src, ''), i.data_src) AS src,"
        " i.alt AS alt, i.has_alt AS has_alt)), i -> trim(i.src) <> '' AND NOT "
        "startswith(trim(i.src), 'data:'))"
    ),
    "phones": "visible_phones",
    "has_email": f"visible_text RLIKE {el.regex(fv.EMAIL_SIGN)}",
    "copyright_years": (
        f"transform(regexp_extract_all(visible_text, {el.regex(fv.COPYRIGHT_YEAR)}, 1), "
        "y -> CAST(y AS INT))"
    ),
    "social_proof_words": f"visible_text RLIKE {el.regex(fv.SOCIAL_PROOF)}",
    "json_items": jl.json_items("json_blocks"),
    "json_broken": jl.has_broken_block("json_blocks"),
    "json_types": jl.first_level_types("json_blocks"),
    "quotable": (
        "greatest(size(questions), CASE WHEN exists(json_items, i -> "
        f"array_contains(i.types, 'FAQPage')) THEN {fv.QUESTIONS_NEEDED} ELSE 0 END)"
    ),
    "review_items": (
        f"exists(json_items, i -> arrays_overlap(i.types, array({el.quoted(fv.REVIEW_TYPES)})) "
        "OR arrays_overlap(i.present, array('aggregateRating', 'review')))"
    ),
}

PAGE_FEATURES = {
    "is_https": "startswith(final_url, 'https://')",
    "noindex": (
        "contains(lower(coalesce(robots_meta, '')), 'noindex') OR "
        "contains(lower(coalesce(googlebot_meta, '')), 'noindex') OR "
        "contains(lower(coalesce(headers['x-robots-tag'], '')), 'noindex')"
    ),
    "charset_declared": (
        "charset_in_head OR contains(lower(coalesce(headers['content-type'], '')), 'charset=')"
    ),
    "preview_image": "coalesce(nullif(og_image, ''), twitter_image, '')",
    "preview_problems": (
        "array_compact(array("
        "CASE WHEN coalesce(og_title, '') = '' THEN 'og:title' END, "
        "CASE WHEN coalesce(og_description, '') = '' THEN 'og:description' END, "
        "CASE WHEN preview_image = '' THEN 'og:image' END, "
        "CASE WHEN coalesce(twitter_card, '') = '' THEN 'twitter:card' END, "
        "CASE WHEN preview_image <> '' AND NOT preview_image RLIKE '^https?://' "
        "THEN 'og:image is not a full address' END))"
    ),
    "core_tags_missing": (
        "array_compact(array("
        "CASE WHEN title = '' THEN 'title' END, "
        "CASE WHEN coalesce(description, '') = '' THEN 'description' END, "
        "CASE WHEN coalesce(viewport, '') = '' THEN 'viewport' END, "
        "CASE WHEN NOT (charset_tag OR contains(lower(coalesce(content_type_meta, '')), "
        "'charset')) THEN 'charset' END, "
        "CASE WHEN size(canonicals) = 0 THEN 'canonical' END))"
    ),
    "hsts": header("strict-transport-security"),
    "csp": header("content-security-policy"),
    "csp_report_only": header("content-security-policy-report-only"),
    "nosniff": header("x-content-type-options"),
    "frame_options": header("x-frame-options"),
    "referrer_header": header("referrer-policy"),
    "segments": (
        "filter(split(lower(regexp_extract(final_url, r\"^[^:]*://[^/?#]*([^?#]*)\", 1)), '/'), "
        "s -> s <> '')"
    ),
    "libraries": "script_libraries",
    "outdated_scripts": "exists(script_libraries, l -> l.outdated)",
    "kind_elsewhere": jl.page_kind(
        "segments", "false", "lower(coalesce(og_type, ''))", "coalesce(price, '')",
        "size(questions)",
    ),
    "schema_elsewhere": jl.schema_status(
        "json_broken", f"({jl.page_schema('json_items', 'kind_elsewhere')})"
    ),
    "schema_as_home": jl.schema_status(
        "json_broken", f"({jl.page_schema('json_items', chr(39) + 'home' + chr(39))})"
    ),
}


FEATURES = {**ELEMENT_FEATURES, **DEPENDENT_FEATURES, **PAGE_FEATURES}
WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def layered(df: DataFrame, expressions: dict[str, str], wanted: set[str]) -> DataFrame:
    """`df` plus the wanted expressions and what they build on, layer by layer.

    Each layer is a plain projection over the previous one, so an expensive expression is
    computed once and read by name, and the unused ones are never planned.
    """
    base = set(df.columns)
    needs: dict[str, set[str]] = {}

    def visit(name: str) -> None:
        if name in base or name in needs:
            return
        used = {w for w in WORD.findall(expressions[name]) if w in expressions and w != name}
        needs[name] = used - base
        for word in needs[name]:
            visit(word)

    for name in sorted(wanted & set(expressions)):
        visit(name)
    done: set[str] = set()
    while len(done) < len(needs):
        layer = sorted(n for n, used in needs.items() if n not in done and used <= done)
        df = df.selectExpr("*", *[f"{expressions[n]} AS {n}" for n in layer])
        done.update(layer)
    return df
