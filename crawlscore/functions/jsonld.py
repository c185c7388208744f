"""Structured data (JSON-LD) on VARIANT columns.

`json_items` turns the script blocks of a page into plain item structs: type names, the
properties that carry a value, and the nested faults. Everything after that works on those
arrays, so the JSON is read once per page.
"""

from __future__ import annotations

from crawlscore import fixed_values as fv
from crawlscore.functions.elements import quoted

EMPTY_VALUES = "'null', '\"\"', '[]', '{}'"


def let(value: str, name: str, body: str) -> str:
    """SQL of `body` with `name` bound to a value that is computed once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _is_array(v: str) -> str:
    return f"startswith(schema_of_variant({v}), 'ARRAY')"


def _is_object(v: str) -> str:
    return f"startswith(schema_of_variant({v}), 'OBJECT')"


def _get(v: str, key: str) -> str:
    return f"try_variant_get({v}, \"$['{key}']\", 'variant')"


def _as_list(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NULL THEN CAST(array() AS ARRAY<VARIANT>) WHEN {_is_array(v)} THEN "
        f"CAST({v} AS ARRAY<VARIANT>) ELSE array({v}) END"
    )


def _list_only(v: str) -> str:
    return (
        f"CASE WHEN {v} IS NOT NULL AND {_is_array(v)} THEN CAST({v} AS ARRAY<VARIANT>) "
        "ELSE CAST(array() AS ARRAY<VARIANT>) END"
    )


def _has(v: str, key: str) -> str:
    value = _get(v, key)
    return f"coalesce(to_json({value}) NOT IN ({EMPTY_VALUES}), false)"


def types_of(v: str) -> str:
    """The type names of an item, which may be one name or a list."""
    kind = _get(v, "@type")
    return (
        f"CASE WHEN coalesce(to_json({kind}) IN ({EMPTY_VALUES}), true) THEN "
        f"CAST(array() AS ARRAY<STRING>) ELSE transform({_as_list(kind)}, "
        "t -> coalesce(try_variant_get(t, '$', 'string'), to_json(t))) END"
    )


def present_properties(v: str) -> str:
    """Names of the properties that carry a value."""
    return (
        f"map_keys(map_filter(CAST({v} AS MAP<STRING, VARIANT>), "
        f"(k, x) -> coalesce(to_json(x) NOT IN ({EMPTY_VALUES}), false)))"
    )


def nested_faults(v: str) -> str:
    """Faults inside offers, author and mainEntity, each with the family it counts for."""
    offers, author, main = _get(v, "offers"), _get(v, "author"), _get(v, "mainEntity")
    answer = _get("q", "acceptedAnswer")
    bad_question = (
        f"NOT coalesce({_is_object('q')} AND {_has('q', 'name')} AND {_is_object(answer)} "
        f"AND {_has(answer, 'text')}, false)"
    )
    return (
        "array_compact(array("
        f"CASE WHEN coalesce({_is_object(offers)}, false) AND NOT {_has(offers, 'price')} THEN "
        "named_struct('family', 'Product', 'fault', 'offers.price') END, "
        f"CASE WHEN coalesce({_is_object(offers)}, false) AND NOT {_has(offers, 'priceCurrency')}"
        " THEN named_struct('family', 'Product', 'fault', 'offers.priceCurrency') END, "
        f"CASE WHEN coalesce({_is_object(author)}, false) AND NOT {_has(author, 'name')} THEN "
        "named_struct('family', 'Article', 'fault', 'author.name') END, "
        f"CASE WHEN exists({_list_only(main)}, q -> {bad_question}) THEN "
        "named_struct('family', 'FAQPage', 'fault', "
        "'mainEntity (each Question needs a name and an acceptedAnswer.text)') END))"
    )


def block_entries(parsed: str) -> str:
    """All objects of one parsed block: the top level, then what its @graph lists hold, level by level.

    A block is followed as deep as it says "@graph", so no level is out of reach.
    """
    def below(level: str) -> str:
        return f"flatten(transform({level}, g -> {_list_only(_get('g', '@graph'))}))"

    deeper = let(below("a.level"), "next", "named_struct('level', next, 'found', concat(a.found, next))")
    found = (
        f"aggregate(sequence(1, coalesce(regexp_count(to_json(whole), '\"@graph\"'), 0)), "
        f"named_struct('level', top, 'found', top), (a, i) -> {deeper}, a -> a.found)"
    )
    objects = f"filter({found}, v -> {_is_object('v')})"
    return let(parsed, "whole", let(_as_list("whole"), "top", objects))


def json_items(blocks: str) -> str:
    """Item structs (types, present, faults, json) of all blocks of a page, in page order."""
    entries = f"flatten(transform({blocks}, b -> {block_entries('try_parse_json(b)')}))"
    item = (
        f"named_struct('types', {types_of('v')}, 'present', {present_properties('v')}, "
        f"'faults', {nested_faults('v')}, 'json', to_json(v))"
    )
    return f"filter(transform({entries}, v -> {item}), i -> size(i.types) > 0)"


def has_broken_block(blocks: str) -> str:
    return f"exists({blocks}, b -> try_parse_json(b) IS NULL)"


def first_level_types(blocks: str) -> str:
    """Types one level deep: list members, or @graph members, or the object itself."""
    graph = _get("p", "@graph")
    members = (
        f"CASE WHEN {_is_array('p')} THEN CAST(p AS ARRAY<VARIANT>) "
        f"WHEN {graph} IS NOT NULL THEN {_list_only(graph)} ELSE array(p) END"
    )
    return (
        f"flatten(transform({blocks}, b -> coalesce(get(transform(filter(array(try_parse_json(b)), "
        f"x -> x IS NOT NULL), p -> flatten(transform(filter({members}, m -> {_is_object('m')}), "
        f"m -> {types_of('m')}))), 0), CAST(array() AS ARRAY<STRING>))))"
    )


def family(schema_type: str) -> str:
    """The rule set a type falls under; null when none does."""
    return (
        f"CASE WHEN {schema_type} IN ({quoted(list(fv.SCHEMA_RULES))}) THEN {schema_type} "
        f"WHEN {schema_type} IN ({quoted(fv.LOCAL_BUSINESS_TYPES)}) THEN 'LocalBusiness' "
        f"WHEN {schema_type} IN ({quoted(fv.OTHER_ORGANIZATION_TYPES)}) THEN 'Organization' "
        f"WHEN {schema_type} IN ({quoted(fv.ARTICLE_TYPES)}) THEN 'Article' "
        f"WHEN {schema_type} IN ({quoted(fv.PRODUCT_TYPES)}) THEN 'Product' "
        f"WHEN {schema_type} IN ({quoted(fv.WEBPAGE_TYPES)}) THEN 'WebPage' END"
    )


def _rule_list(position: int, key: str) -> str:
    arms = " ".join(
        f"WHEN '{name}' THEN CAST(array({quoted(rule[position])}) AS ARRAY<STRING>)"
        for name, rule in fv.SCHEMA_RULES.items()
    )
    return f"CASE {key} {arms} ELSE CAST(array() AS ARRAY<STRING>) END"


def missing_properties(item: str) -> str:
    """struct(required, recommended) an item lacks, nested musts included."""
    lacking = f"filter({{}}, n -> NOT array_contains({item}.present, n))"
    no_offer_needed = (
        "array_contains(families, 'Product') AND "
        f"arrays_overlap({item}.present, array('review', 'aggregateRating'))"
    )
    phone_given = (
        f"array_contains(families, 'Organization') AND array_contains({item}.present, 'telephone')"
    )
    faults = (
        f"transform(filter({item}.faults, f -> array_contains(families, f.family)), f -> f.fault)"
    )
    none = "CAST(array() AS ARRAY<STRING>)"
    judged = (
        f"named_struct('required', concat(filter({lacking.format(_rule_list(0, 'rule'))}, "
        f"n -> n <> 'offers' OR NOT coalesce({no_offer_needed}, false)), {faults}), "
        f"'recommended', filter({lacking.format(_rule_list(1, 'rule'))}, "
        f"n -> n <> 'contactPoint' OR NOT coalesce({phone_given}, false)))"
    )
    ruled = (
        f"CASE WHEN rule IS NULL THEN named_struct('required', {none}, 'recommended', {none}) "
        f"ELSE {judged} END"
    )
    return let(
        f"transform({item}.types, t -> {family('t')})", "families",
        let("get(array_compact(families), 0)", "rule", ruled))


def page_kind(segments: str, is_home: str, og_type: str, price: str, questions: str) -> str:
    """home, article, product, faq, contact, about, service, listing or page."""
    first, last = f"get({segments}, 0)", f"get({segments}, size({segments}) - 1)"
    deep = f"size({segments}) >= 2"
    sections = fv.BLOG_SECTIONS + fv.PRODUCT_SECTIONS + fv.SERVICE_SECTIONS
    return (
        f"CASE WHEN size({segments}) = 0 OR {is_home} THEN 'home' "
        f"WHEN {og_type} = 'article' OR ({first} IN ({quoted(fv.BLOG_SECTIONS)}) AND {deep}) "
        "THEN 'article' "
        f"WHEN {og_type} = 'product' OR {price} <> '' OR "
        f"({first} IN ({quoted(fv.PRODUCT_SECTIONS)}) AND {deep}) THEN 'product' "
        f"WHEN {last} IN ({quoted(fv.FAQ_WORDS)}) OR {questions} >= 3 THEN 'faq' "
        f"WHEN arrays_overlap({segments}, array({quoted(fv.CONTACT_WORDS)})) THEN 'contact' "
        f"WHEN arrays_overlap({segments}, array({quoted(fv.ABOUT_WORDS)})) THEN 'about' "
        f"WHEN {first} IN ({quoted(fv.SERVICE_SECTIONS)}) AND {deep} THEN 'service' "
        f"WHEN {first} IN ({quoted(sections)}) THEN 'listing' ELSE 'page' END"
    )


def page_schema(items: str, kind: str) -> str:
    """For each type a page of this kind should carry: label, state and what it lacks."""
    labels = "CASE {} {} END".format(
        kind,
        " ".join(
            f"WHEN '{k}' THEN array({quoted(v)})" for k, v in fv.EXPECTED_LABELS.items()
        ),
    )
    accepted = "CASE l {} END".format(
        " ".join(f"WHEN '{k}' THEN array({quoted(v)})" for k, v in fv.ACCEPTED_TYPES.items())
    )
    match = f"get(filter({items}, i -> arrays_overlap(i.types, {accepted})), 0)"
    part = f"named_struct('label', l, 'item', own, 'lacks', {missing_properties('own')})"
    return f"transform({labels}, l -> {let(match, 'own', part)})"


def schema_status(broken: str, parts: str) -> str:
    return f"CASE WHEN {broken} THEN 'broken' ELSE " + let(parts, "parts_found", (
        "CASE WHEN exists(parts_found, p -> p.item IS NULL) THEN 'missing' "
        "WHEN exists(parts_found, p -> size(p.lacks.required) > 0) THEN 'incomplete' "
        "WHEN exists(parts_found, p -> size(p.lacks.recommended) > 0) THEN 'could be richer' "
        "ELSE 'good' END")) + " END"
