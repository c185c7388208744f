"""Reading the extracted `elements` array with higher-order functions.

Each function takes the SQL name of an elements column and gives a SQL expression, so the
same rule serves the crawled document and the browser-rendered one. Nothing here explodes
or shuffles: every expression is local to its page row.
"""

from __future__ import annotations

from crawlscore import fixed_values as fv

BLANKS = r"' \t\n\r\u000C'"


def strip(text: str) -> str:
    return f"trim(BOTH {BLANKS} FROM {text})"


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "\\'") + "'" for w in words)


def regex(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    if '"' in pattern:
        raise ValueError("patterns with double quotes need another spelling")
    return f'r"{pattern}"'


def tagged(els: str, *tags: str) -> str:
    return f"filter({els}, e -> e.tag IN ({quoted(list(tags))}))"


def attr(name: str, element: str = "e") -> str:
    return f"coalesce({element}.attrs['{name}'], '')"


def has_attr(name: str, element: str = "e") -> str:
    return f"map_contains_key({element}.attrs, '{name}')"


def meta(els: str, attribute: str, value: str) -> str:
    """Content of the first matching meta element; null when there is none."""
    test = f"e.tag = 'meta' AND lower({strip(attr(attribute))}) = '{value.lower()}'"
    return f"get(transform(filter({els}, e -> {test}), e -> {strip(attr('content'))}), 0)"


def title(els: str) -> str:
    return f"coalesce(get(transform({tagged(els, 'title')}, e -> e.text), 0), '')"


def first_time(els: str) -> str:
    """The date of the first time element that has one; null when there is none."""
    return f"get(transform(filter({els}, e -> e.tag = 'time' AND {has_attr('datetime')}), e -> {attr('datetime')}), 0)"


def links_with_rel(els: str, rel: str) -> str:
    test = f"array_contains(split(lower({attr('rel')}), '\\\\s+'), '{rel}')"
    return f"filter({els}, e -> e.tag = 'link' AND {test})"


def canonical_hrefs(els: str) -> str:
    return f"transform({links_with_rel(els, 'canonical')}, e -> {strip(attr('href'))})"


def html_lang(els: str) -> str:
    return f"coalesce(get(transform({tagged(els, 'html')}, e -> {strip(attr('lang'))}), 0), '')"


def headings(els: str) -> str:
    """The outline: level and text of every heading; a picture's alt text counts."""
    text = "CASE WHEN e.text <> '' THEN e.text ELSE array_join(filter(split(coalesce(" \
           "e.heading_alt, ''), '\\\\s+'), w -> w <> ''), ' ') END"
    return (
        f"transform({tagged(els, 'h1', 'h2', 'h3', 'h4', 'h5', 'h6')}, "
        f"e -> named_struct('level', CAST(right(e.tag, 1) AS INT), 'text', {text}))"
    )


def skips_level(outline: str) -> str:
    return (
        f"exists(sequence(1, greatest(size({outline}) - 1, 1)), i -> "
        f"coalesce(get({outline}, i).level > get({outline}, i - 1).level + 1, false))"
    )


def images(els: str) -> str:
    fields = ", ".join([
        f"'src', {strip(attr('src'))}", f"'raw_src', {attr('src')}",
        f"'data_src', {strip(attr('data-src'))}",
        "'alt', e.attrs['alt']", f"'has_alt', {has_attr('alt')}",
        f"'sized', {attr('width')} <> '' AND {attr('height')} <> ''",
        f"'lazy', {attr('loading')} = 'lazy'", "'path', e.path",
    ])
    return f"transform({tagged(els, 'img')}, e -> named_struct({fields}))"


def accessible_name(element: str = "e") -> str:
    """What a screen reader would announce for a link or button."""
    return (
        f"coalesce(nullif({strip(attr('aria-label', element))}, ''), "
        f"nullif({strip(attr('title', element))}, ''), "
        f"CASE WHEN {strip(attr('aria-labelledby', element))} <> '' THEN 'labelled' END, "
        f"nullif({element}.text, ''), {element}.inner_alt, '')"
    )


def controls(els: str) -> str:
    """Links with an address, and buttons."""
    return (
        f"filter({els}, e -> e.tag = 'button' OR (e.tag = 'a' AND {has_attr('href')}))"
    )


def nameless_controls(els: str) -> str:
    return f"filter({controls(els)}, e -> {accessible_name()} = '')"


def push_inputs(els: str) -> str:
    return f"filter({els}, e -> e.tag = 'input' AND e.attrs['type'] IN ('submit', 'button'))"


def form_fields(els: str) -> str:
    kind = "lower(coalesce(nullif(e.attrs['type'], ''), 'text'))"
    return (
        f"filter({els}, e -> e.tag IN ('input', 'select', 'textarea') "
        f"AND {kind} NOT IN ({quoted(fv.NOT_LABELLED_INPUTS)}))"
    )


def unlabelled_fields(els: str) -> str:
    targets = (
        f"transform(filter({els}, e -> e.tag = 'label' AND {has_attr('for')}), "
        f"e -> {strip(attr('for'))})"
    )
    ident = strip(attr("id", "f"))
    named = " OR ".join(
        f"{strip(attr(a, 'f'))} <> ''" for a in ("aria-label", "aria-labelledby", "title")
    )
    return (
        f"filter({form_fields(els)}, f -> NOT (f.in_label OR {named} OR "
        f"({ident} <> '' AND array_contains({targets}, {ident}))))"
    )


def link_targets(els: str, prefix: str) -> str:
    """What follows a scheme such as tel: in the addresses of links."""
    return (
        f"transform(filter({els}, e -> e.tag = 'a' AND "
        f"startswith(lower({attr('href')}), '{prefix}')), "
        f"e -> substring({attr('href')}, {len(prefix) + 1}))"
    )


def has_link_to(els: str, signs: list[str]) -> str:
    target = f"lower(coalesce(nullif({attr('href')}, ''), {attr('src')}))"
    test = " OR ".join(f"contains({target}, '{sign}')" for sign in signs)
    return (
        f"exists({els}, e -> ((e.tag = 'a' AND {has_attr('href')}) OR "
        f"(e.tag = 'iframe' AND {has_attr('src')})) AND ({test}))"
    )


def link_matches(els: str, pattern: str) -> str:
    """Some link whose text or address matches."""
    return (
        f"exists({els}, e -> e.tag = 'a' AND {has_attr('href')} AND "
        f"concat(e.text, ' ', {attr('href')}) RLIKE {regex(pattern)})"
    )


def link_value(els: str, scheme: str) -> str:
    """The first usable value of a link scheme, without what follows a question mark."""
    value = strip(f"substring_index(substring({attr('href')}, {len(scheme) + 1}), '?', 1)")
    return (
        f"coalesce(get(filter(transform(filter({els}, e -> e.tag = 'a' AND "
        f"startswith({attr('href')}, '{scheme}')), e -> {value}), v -> v <> ''), 0), '')"
    )


def social_profiles(els: str) -> str:
    """Distinct links to social networks, in order."""
    host = "lower(regexp_extract(h, r\"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)\", 1))"
    hosts = "|".join(h.replace(".", "\\.") for h in fv.SOCIAL_HOSTS)
    hrefs = f"transform({tagged(els, 'a')}, e -> {strip(attr('href'))})"
    return (
        f"array_distinct(filter({hrefs}, h -> {host} RLIKE "
        + regex(rf"^(.*\.)?({hosts})$") + "))"
    )


def question_pairs(els: str) -> str:
    """Questions with the answer that follows them."""
    return (
        f"transform(filter({els}, e -> e.question IS NOT NULL), "
        "e -> named_struct('question', e.question, 'answer', e.answer))"
    )


def json_ld_blocks(els: str) -> str:
    return (
        f"transform(filter({els}, e -> e.tag = 'script' AND "
        "e.attrs['type'] = 'application/ld+json'), e -> coalesce(e.text, ''))"
    )


def script_sources(els: str) -> str:
    return (
        f"transform(filter({els}, e -> e.tag = 'script' AND {has_attr('src')}), "
        f"e -> lower({attr('src')}))"
    )


def mixed_content(els: str, active: bool) -> str:
    """Does a page load active (scripts, styles, frames) or passive files over http?"""
    insecure = "startswith(coalesce(e.attrs['{}'], ''), 'http://')"
    if active:
        return (
            f"exists({els}, e -> (e.tag IN ('script', 'iframe', 'embed') AND "
            f"{insecure.format('src')}) OR (e.tag = 'object' AND {insecure.format('data')}) OR "
            f"(e.tag = 'link' AND contains(lower({attr('rel')}), 'stylesheet') AND "
            f"{insecure.format('href')}))"
        )
    return (
        f"exists({els}, e -> e.tag IN ('img', 'source', 'video', 'audio') AND "
        f"{insecure.format('src')})"
    )


def blocking_head_scripts(els: str) -> str:
    return (
        f"filter({els}, e -> e.tag = 'script' AND e.in_head AND {has_attr('src')} AND NOT "
        f"{has_attr('async')} AND NOT {has_attr('defer')} AND lower({attr('type')}) <> 'module')"
    )


def landmark(els: str, tag: str, role: str) -> str:
    return f"exists({els}, e -> e.tag = '{tag}' OR e.attrs['role'] = '{role}')"


def contact_form(els: str) -> str:
    """A form that asks for an address, a number or words."""
    asks = "e.tag = 'textarea' OR (e.tag = 'input' AND e.attrs['type'] IN ('email', 'tel', 'text'))"
    return f"exists({els}, e -> e.form >= 0 AND ({asks}))"


def described(element: str = "e") -> str:
    """A short readable name of an element."""
    key = (
        f"CASE WHEN {element}.tag IN ('img', 'iframe', 'video', 'audio') THEN 'src' "
        f"WHEN {element}.tag = 'a' THEN 'href' "
        f"WHEN {element}.tag IN ('input', 'select', 'textarea') THEN 'name' END"
    )
    value = strip(f"coalesce({element}.attrs[{key}], '')")
    name = f"left(substring_index({value}, '/', -1), 50)"
    text = f"left(array_join(filter(split(coalesce({element}.text, ''), '\\\\s+'), w -> w <> ''), ' '), 50)"
    return (
        f"CASE WHEN {element}.tag IN ('img', 'iframe', 'video', 'audio') AND {value} <> '' THEN "
        f"concat('<', {element}.tag, ' src=\"', coalesce(nullif({name}, ''), left({value}, 50)), '\">') "
        f"WHEN {text} <> '' THEN concat('<', {element}.tag, '> \"', {text}, '\"') "
        f"WHEN {value} <> '' THEN concat('<', {element}.tag, ' ', {key}, '=\"', left({value}, 50), '\">') "
        f"ELSE concat('<', {element}.tag, '>') END"
    )


def shot(element: str, page_url: str) -> str:
    """Where an element is: page, CSS path, identifying tag, attribute and words, label."""
    key = (
        f"CASE WHEN {element}.tag IN ('img', 'iframe', 'video', 'audio') THEN 'src' "
        f"WHEN {element}.tag = 'a' THEN 'href' "
        f"WHEN {element}.tag IN ('input', 'select', 'textarea') THEN 'name' END"
    )
    value = f"coalesce({element}.attrs[{key}], '')"
    words = f"left(array_join(filter(split(coalesce({element}.text, ''), '\\\\s+'), w -> w <> ''), ' '), 40)"
    return (
        f"named_struct('page', {page_url}, 'selector', {element}.path, "
        f"'match_tag', CASE WHEN {value} <> '' THEN {element}.tag ELSE '' END, "
        f"'match_attr', CASE WHEN {value} <> '' THEN {key} ELSE '' END, 'match_value', {value}, "
        f"'match_text', {words}, 'label', {described(element)})"
    )


def shots(matches: str, page_url: str, limit: int | None = None) -> str:
    few = matches if limit is None else f"slice({matches}, 1, {limit})"
    return f"transform({few}, e -> {shot('e', page_url)})"
