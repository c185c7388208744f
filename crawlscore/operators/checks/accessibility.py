"""Accessibility checks."""

from crawlscore import fixed_values as fv
from crawlscore.functions import elements as el
from crawlscore.operators.checks.spec import Check, Rule, share, some

CHECKS = [
    Check(
        "accessibility.image_alt", 8, "Image descriptions",
        why="Screen readers announce pictures by their alt text.",
        fix="Give every picture an alt text, empty only for decoration.",
        features={"alts_missing": "size(filter(images, i -> NOT i.has_alt))"},
        facts={
            "alt_images": "sum(size(dom_images))",
            "alt_missing_total": "sum(dom_alts_missing)",
            "alt_missing_pages": "count_if(dom_alts_missing > 0)",
        },
        na="alt_images = 0", partial=share("alt_images", "alt_missing_total"),
        rules=(
            Rule("missing", "fail", "alt_missing_total > 0", "high",
                 "CASE WHEN alt_missing_total > 10 THEN 'medium' ELSE 'low' END",
                 affected="alt_missing_pages", pages="dom_alts_missing > 0",
                 message=some("alt_missing_total", "alt_images", "pictures have no alt text.")),
        ),
    ),
    Check(
        "accessibility.html_lang", 5, "Page language",
        why="Screen readers pick the voice by the page language.",
        fix="Name the language in the html tag.",
        rules=(
            Rule("missing", "fail", "home.dom_lang = ''",
                 message="'The homepage names no language.'"),
            Rule("invalid", "warn",
                 f"home.dom_lang <> '' AND NOT home.dom_lang RLIKE {el.regex(fv.LANG_CODE)}", "low",
                 message="'The language code is not valid.'"),
        ),
    ),
    Check(
        "accessibility.heading_order", 3, "Heading order",
        why="Screen reader users move along the heading levels.",
        fix="Do not skip heading levels.",
        facts={
            "ordered_pages": "count_if(size(dom_outline) > 0)",
            "order_skipped": "count_if(dom_level_skipped)",
        },
        na="ordered_pages = 0", partial=share("ordered_pages", "0", "order_skipped"),
        rules=(
            Rule("skipped", "warn", "order_skipped > 0", "low", affected="order_skipped",
                 pages="dom_level_skipped",
                 message=some("order_skipped", "pages", "pages skip heading levels.")),
        ),
    ),
    Check(
        "accessibility.form_labels", 8, "Form labels",
        why="A field without a label cannot be filled in by ear.",
        fix="Give every field a visible label.",
        facts={
            "fields": "sum(dom_fields_total)",
            "fields_bad": "sum(dom_fields_unlabelled)",
            "fields_bad_pages": "count_if(dom_fields_unlabelled > 0)",
        },
        na="fields = 0", partial=share("fields", "fields_bad"),
        rules=(
            Rule("unlabelled", "fail", "fields_bad > 0", "high", affected="fields_bad_pages",
                 pages="dom_fields_unlabelled > 0",
                 message=some("fields_bad", "fields", "form fields have no label.")),
        ),
    ),
    Check(
        "accessibility.accessible_names", 6, "Link and button names",
        why="Nameless links are announced as just link.",
        fix="Give icon links and buttons a text or an aria-label.",
        facts={
            "named_total": "sum(dom_controls_total + dom_push_inputs)",
            "named_bad": "sum(dom_controls_nameless + dom_push_inputs_nameless)",
            "named_bad_pages": "count_if(dom_controls_nameless + dom_push_inputs_nameless > 0)",
        },
        na="named_total = 0", partial=share("named_total", "0", "named_bad"),
        rules=(
            Rule("nameless", "warn", "named_bad > 0", affected="named_bad_pages",
                 pages="dom_controls_nameless + dom_push_inputs_nameless > 0",
                 message="concat(named_bad, ' links or buttons have no name.')"),
        ),
    ),
    Check(
        "accessibility.axe_scan", 10, "Automated scan",
        why="A scanner finds faults the other checks do not cover.",
        fix="Repair the elements each rule names.",
        tables=("axe",), requires=("render",), na="coalesce(axe.axe_rules, 0) = 0",
        partial="greatest(0.0D, (axe.axe_rules - axe.axe_penalty) / axe.axe_rules)",
        rules=(),
        # one finding per violated scanner rule, the most serious first
        findings=(
            "transform(axe.axe_found, (v, i) -> named_struct('finding_ord', i + 1, "
            "'code', v.id, 'severity', CASE WHEN v.impact IN ('critical', 'serious') THEN 'fail' "
            "WHEN v.impact = 'moderate' THEN 'warn' ELSE 'info' END, "
            "'impact', CASE WHEN v.impact IN ('critical', 'serious') THEN 'high' ELSE 'low' END, "
            "'effort', CASE WHEN v.nodes > 5 THEN 'medium' ELSE 'low' END, "
            "'affected', CAST(1 AS BIGINT), "
            "'message', concat('Rule ', v.id, ' fails on ', v.nodes, ' elements.')))"
        ),
    ),
]
