"""Best-practice checks: security, standards, phones, trust."""

from crawlscore import fixed_values as fv
from crawlscore.functions import elements as el
from crawlscore.operators.checks.spec import Check, Rule, share, some

_MIXED_PAGES = "count_if(is_https AND ({}))"
_PHONE = "device_views.mobile"
_TABLET = "device_views.tablet"
_ZOOMED = "{v}.layout_width > {v}.width + 2"
_FITS = "{v}.scroll_width <= {v}.layout_width + 2"
_SMALL_SHARE = f"({_PHONE}.small_text_chars / nullif({_PHONE}.text_chars, 0))"
_PHONE_ZOOMED = _ZOOMED.format(v=_PHONE)
_HREF_SIGNS = " OR ".join(
    f"contains(lower(substring(l, instr(l, ' | ') + 3)), '{s}')" for s in fv.ACTION_LINK_SIGNS
)
_REFERRERS = (
    "filter(transform(split(lower(coalesce(nullif(home.referrer_header, ''), "
    "home.referrer_meta, '')), ','), p -> trim(p)), p -> p <> '')"
)


def _size_rules(view: str, name: str) -> tuple[Rule, Rule]:
    severity, impact = ("fail", "high") if name == "phone" else ("warn", "medium")
    zoomed = f"coalesce({_ZOOMED.format(v=view)}, false)"
    return (
        Rule(f"{name}_zoomed", severity, zoomed, impact, "medium",
             message=f"'On a {name} the desktop page is shown shrunk.'"),
        Rule(f"{name}_sideways", severity,
             f"coalesce(NOT ({_ZOOMED.format(v=view)}) AND NOT ({_FITS.format(v=view)}), false)",
             impact, "medium", message=f"'On a {name} the page is wider than the screen.'"),
    )


CHECKS = [
    Check(
        "best_practices.https", 10, "Secure connection",
        why="Without HTTPS browsers call a site not secure.",
        fix="Install a certificate and send every http address to https.",
        rules=(
            Rule("insecure", "fail", "NOT home.is_https", "high", "medium",
                 message="'The site is served without encryption.'"),
        ),
    ),
    Check(
        "best_practices.http_redirect", 6, "http leads to https",
        why="Typed and old addresses should land on the secure site.",
        fix="Redirect http permanently to https.",
        tables=("site_probe",), requires=("probes",), na="NOT home.is_https",
        rules=(
            Rule("silent", "info", "site_probe.http_final_url IS NULL", "low", affected="0",
                 message="'The site does not answer on http.'"),
            Rule("stays", "warn",
                 "coalesce(NOT startswith(site_probe.http_final_url, 'https://'), false)",
                 message="'Visitors who type http stay there.'"),
        ),
    ),
    Check(
        "best_practices.mixed_content", 7, "Mixed content",
        why="Files loaded over http weaken a secure page.",
        fix="Load every file over https.",
        facts={
            "secure_pages": "count_if(is_https)",
            "mixed_active": _MIXED_PAGES.format("active_mixed"),
            "mixed_passive": _MIXED_PAGES.format("passive_mixed"),
            "mixed_any": _MIXED_PAGES.format("active_mixed OR passive_mixed"),
        },
        na="secure_pages = 0",
        rules=(
            Rule("active", "fail", "mixed_active > 0", "high", affected="mixed_any",
                 pages="is_https AND (active_mixed OR passive_mixed)",
                 message=some("mixed_active", "secure_pages", "pages load code over http.")),
            Rule("passive", "warn", "mixed_active = 0 AND mixed_passive > 0",
                 affected="mixed_passive", pages="is_https AND passive_mixed",
                 message=some("mixed_passive", "secure_pages", "pages load media over http.")),
        ),
    ),
    Check(
        "best_practices.hsts", 4, "Always-secure setting",
        why="HSTS makes browsers use the secure site at once.",
        fix="Send Strict-Transport-Security with a max-age of a year.",
        na="NOT home.is_https",
        facts={"hsts_age": "try_cast(regexp_extract(home.hsts, "
                           "r'(?i)max-age\\s*=\\s*\"?(\\d+)', 1) AS BIGINT)"},
        rules=(
            Rule("missing", "warn", "home.hsts = ''",
                 message="'Browsers are not told to stay on https.'"),
            Rule("short", "warn",
                 f"home.hsts <> '' AND coalesce(hsts_age, 0) < {fv.HSTS_MIN_SECONDS}", "low",
                 message="'The always-secure setting ends too soon.'"),
        ),
    ),
    Check(
        "best_practices.csp", 3, "Content security policy",
        why="A policy stops injected scripts from running.",
        fix="Send a Content-Security-Policy, first in report-only mode.",
        facts={"has_csp": "home.csp <> '' OR coalesce(home.csp_meta, '') <> ''"},
        rules=(
            Rule("test_mode", "info", "NOT has_csp AND home.csp_report_only <> ''", "low",
                 affected="0", message="'The policy only reports so far.'"),
            Rule("missing", "warn", "NOT has_csp AND home.csp_report_only = ''", "medium",
                 "medium", message="'There is no content security policy.'"),
        ),
    ),
    Check(
        "best_practices.nosniff", 2, "File type protection",
        why="Guessing file types lets uploads run as scripts.",
        fix="Send X-Content-Type-Options: nosniff.",
        rules=(
            Rule("missing", "warn", "lower(home.nosniff) <> 'nosniff'", "low",
                 message="'Browsers may guess file types.'"),
        ),
    ),
    Check(
        "best_practices.frame_protection", 3, "Frame protection",
        why="Framed pages can trick visitors into clicking.",
        fix="Send X-Frame-Options: SAMEORIGIN or frame-ancestors.",
        rules=(
            Rule("missing", "warn",
                 "upper(home.frame_options) NOT IN ('DENY', 'SAMEORIGIN') AND NOT "
                 "contains(lower(home.csp), 'frame-ancestors')",
                 message="'Other sites may put these pages into a frame.'"),
        ),
    ),
    Check(
        "best_practices.referrer_policy", 2, "Referrer privacy",
        why="Full addresses can carry private details to other sites.",
        fix="Send Referrer-Policy: strict-origin-when-cross-origin.",
        facts={"referrers": _REFERRERS},
        rules=(
            Rule("unsafe", "warn",
                 f"size(referrers) = 0 OR arrays_overlap(referrers, array({el.quoted(fv.UNSAFE_REFERRER)}))",
                 "low", message="'The referrer policy is missing or too open.'"),
        ),
    ),
    Check(
        "best_practices.outdated_libraries", 5, "Outdated libraries",
        why="Old library versions have known holes.",
        fix="Update the libraries and test forms and menus.",
        tables=("render",),
        facts={
            "outdated_pages": "count_if(outdated_scripts)",
            "outdated_rendered": "coalesce(render.outdated_libraries > 0, false)",
        },
        rules=(
            Rule("outdated", "fail", "outdated_pages > 0 OR outdated_rendered", "medium", "medium",
                 affected="outdated_pages + if(outdated_rendered AND NOT home.outdated_scripts, 1, 0)",
                 pages="outdated_scripts",
                 message="'The site uses libraries with known flaws.'"),
        ),
    ),
    Check(
        "best_practices.doctype", 2, "Doctype",
        why="Without a doctype browsers fall back to old layout rules.",
        fix="Begin every page with the HTML doctype.",
        facts={"doctype_missing": "count_if(NOT has_doctype)"},
        rules=(
            Rule("missing", "warn", "doctype_missing > 0", "low", affected="doctype_missing",
                 pages="NOT has_doctype",
                 message=some("doctype_missing", "pages", "pages have no doctype.")),
        ),
    ),
    Check(
        "best_practices.charset", 2, "Character encoding",
        why="A declared encoding shows every letter right.",
        fix="Declare utf-8 first thing in the head.",
        facts={"charset_missing": "count_if(NOT charset_declared)"},
        rules=(
            Rule("missing", "warn", "charset_missing > 0", "low", affected="charset_missing",
                 pages="NOT charset_declared",
                 message=some("charset_missing", "pages", "pages declare no encoding.")),
        ),
    ),
    Check(
        "best_practices.viewport", 7, "Phone setup",
        why="Without a viewport phones show a tiny desktop page.",
        fix="Add a viewport of the device's width.",
        rules=(
            Rule("missing", "fail", "home.viewport IS NULL", "high",
                 message="'The homepage is not set up for phones.'"),
            Rule("fixed", "warn",
                 "coalesce(NOT contains(lower(replace(home.viewport, ' ', '')), "
                 "'width=device-width'), false)",
                 message="'The homepage does not adapt to the screen.'"),
        ),
    ),
    Check(
        "best_practices.console_errors", 4, "Script errors",
        why="Script errors mean something on the page is broken.",
        fix="Repair or remove the scripts that fail.",
        tables=("render",), requires=("render",),
        rules=(
            Rule("errors", "warn", "render.error_count > 0", "medium", "medium",
                 message="concat(render.error_count, ' script errors: ', "
                         "render.error_examples)"),
        ),
    ),
    Check(
        "best_practices.third_party_cookies", 3, "Cookies of others",
        why="Cookies of other companies need consent first.",
        fix="Load trackers only after consent.",
        tables=("cookies",), requires=("render",),
        rules=(
            Rule("cookies", "warn", "coalesce(cookies.third_party_domains, 0) > 0", "medium",
                 "medium", message="concat(cookies.third_party_domains, "
                                   "' other companies set cookies.')"),
        ),
    ),
    Check(
        "best_practices.certificate_expiry", 6, "Certificate valid",
        why="An expired certificate turns almost every visitor away.",
        fix="Renew the certificate and let it renew itself.",
        tables=("security",), requires=("security",),
        na="NOT home.is_https OR (coalesce(security.cert_error, '') = '' AND "
           "security.cert_days IS NULL)",
        rules=(
            Rule("invalid", "fail", "coalesce(security.cert_error, '') <> ''", "high", "medium",
                 message="concat('The certificate is not valid: ', security.cert_error, '.')"),
            Rule("ends_now", "fail",
                 "coalesce(security.cert_error, '') = '' AND security.cert_days <= 7", "high",
                 message="concat('The certificate ends in ', security.cert_days, ' days.')"),
            Rule("ends_soon", "warn",
                 "coalesce(security.cert_error, '') = '' AND security.cert_days BETWEEN 8 AND 20",
                 "high", message="concat('The certificate ends in ', security.cert_days, "
                                 "' days.')"),
        ),
    ),
    Check(
        "best_practices.domain_expiry", 3, "Domain renewed",
        why="A lost domain takes site and mail with it.",
        fix="Renew the domain and turn on automatic renewal.",
        tables=("security",), requires=("security",),
        rules=(
            Rule("unknown", "info", "security.domain_days IS NULL", "low", affected="0",
                 message="'The renewal date is not published.'"),
            Rule("ends_now", "fail", "security.domain_days <= 7", "high",
                 message="concat('The domain ends in ', security.domain_days, ' days.')"),
            Rule("ends_soon", "warn", "security.domain_days BETWEEN 8 AND 30", "high",
                 message="concat('The domain ends in ', security.domain_days, ' days.')"),
        ),
    ),
    Check(
        "best_practices.email_spoofing", 5, "Protection from forged mail",
        why="Without SPF and DMARC anyone can write in your name.",
        fix="Publish SPF and DMARC records in DNS.",
        tables=("security",), requires=("security",),
        na="NOT coalesce(security.dns_checked, false)",
        facts={
            "mail_missing": "array_compact(array(CASE WHEN coalesce(security.spf, '') = '' THEN "
                            "'SPF' END, CASE WHEN coalesce(security.dmarc, '') = '' THEN 'DMARC' "
                            "END))",
            "dmarc_weak": "contains(lower(replace(coalesce(security.dmarc, ''), ' ', '')), 'p=none')",
        },
        rules=(
            Rule("missing", "warn", "size(mail_missing) > 0",
                 message="concat('There is no ', array_join(mail_missing, ' and no '), "
                         "' record.')"),
            Rule("only_reports", "info", "size(mail_missing) = 0 AND dmarc_weak",
                 message="'The DMARC record only reports.'"),
        ),
    ),
    Check(
        "best_practices.exposed_files", 8, "Private files",
        why="These files hold source code and passwords.",
        fix="Block the paths and change every secret in them.",
        tables=("security",), requires=("security",),
        na="NOT coalesce(security.files_checked, false)",
        facts={
            "exposed": "array_compact(array(CASE WHEN security.env_exposed THEN '/.env' END, "
                       "CASE WHEN security.git_exposed THEN '/.git/' END))",
        },
        rules=(
            Rule("exposed", "fail", "size(exposed) > 0", "high", "medium",
                 message="concat('Anyone can read ', array_join(exposed, ' and '), '.')"),
        ),
    ),
    Check(
        "best_practices.security_txt", 1, "Security contact",
        why="security.txt tells finders of holes whom to warn.",
        fix="Publish /.well-known/security.txt with a contact.",
        tables=("security",), requires=("security",), na="security.security_txt IS NULL",
        rules=(
            Rule("missing", "info", "NOT security.security_txt", "low", affected="0",
                 message="'There is no security.txt.'"),
        ),
    ),
    Check(
        "best_practices.mobile_layout", 7, "Fits small screens",
        why="Sideways scrolling drives phone visitors away.",
        fix="Let the layout follow the screen width.",
        tables=("device_views",), requires=("render",),
        na=f"{_PHONE} IS NULL AND {_TABLET} IS NULL",
        rules=_size_rules(_PHONE, "phone") + _size_rules(_TABLET, "tablet"),
    ),
    Check(
        "best_practices.tap_targets", 4, "Easy to tap",
        why="Small targets are hard to hit with a thumb.",
        fix="Make links and buttons at least 24 by 24 pixels.",
        tables=("device_views",), requires=("render",),
        na=f"coalesce({_PHONE}.tap_targets, 0) = 0",
        partial=f"CASE WHEN NOT ({_PHONE_ZOOMED}) THEN "
                + share(f"{_PHONE}.tap_targets", "0", f"{_PHONE}.small_tap_targets") + " END",
        rules=(
            Rule("zoomed", "warn", _PHONE_ZOOMED,
                 message="'Everything is shrunk, so all targets are small.'"),
            Rule("small", f"CASE WHEN {_PHONE}.small_tap_targets >= 3 OR {_PHONE}.small_tap_targets"
                          f" / {_PHONE}.tap_targets >= 0.1D THEN 'warn' ELSE 'info' END",
                 f"NOT ({_PHONE_ZOOMED}) AND {_PHONE}.small_tap_targets > 0",
                 f"CASE WHEN {_PHONE}.small_tap_targets >= 3 OR {_PHONE}.small_tap_targets / "
                 f"{_PHONE}.tap_targets >= 0.1D THEN 'medium' ELSE 'low' END",
                 message=some(f"{_PHONE}.small_tap_targets", f"{_PHONE}.tap_targets",
                              "targets are too small.")),
        ),
    ),
    Check(
        "best_practices.mobile_text_size", 4, "Readable text",
        why="Tiny text on a phone goes unread.",
        fix="Use at least 12 pixels, better 16.",
        tables=("device_views",), requires=("render",),
        na=f"coalesce({_PHONE}.text_chars, 0) = 0",
        partial=f"CASE WHEN NOT ({_PHONE_ZOOMED}) THEN greatest(0.0D, 1.0D - {_SMALL_SHARE}) END",
        rules=(
            Rule("zoomed", "warn", _PHONE_ZOOMED, message="'All text is shown shrunk.'"),
            Rule("much_small", "warn", f"NOT ({_PHONE_ZOOMED}) AND {_SMALL_SHARE} >= 0.25D",
                 message="'Much of the text is too small.'"),
            Rule("some_small", "info",
                 f"NOT ({_PHONE_ZOOMED}) AND {_SMALL_SHARE} >= 0.05D AND {_SMALL_SHARE} < 0.25D",
                 "low", message="'Some of the text is too small.'"),
        ),
    ),
    Check(
        "best_practices.call_to_action", 4, "A next step on phones",
        why="Visitors without a next step leave.",
        fix="Show one clear button on the first screen.",
        tables=("device_views",), requires=("render",), na=f"{_PHONE} IS NULL",
        rules=(
            Rule("none", "warn",
                 f"NOT exists({_PHONE}.first_screen_links, l -> substring_index(l, ' | ', 1) RLIKE "
                 f"{el.regex(fv.ACTION_WORDS)} OR (contains(l, ' | ') AND ({_HREF_SIGNS})))",
                 "high", message="'The first screen offers no next step.'"),
        ),
    ),
    Check(
        "best_practices.privacy_policy", 3, "Privacy policy",
        why="Visitors asked for details want to know what happens to them.",
        fix="Link to a privacy policy from every page.",
        facts={
            "form_pages": "count_if(dom_has_contact_form)",
        },
        rules=(
            Rule("forms", "warn", "NOT home.dom_has_privacy_link AND form_pages > 0",
                 affected="form_pages",
                 message="'Forms ask for details, but there is no privacy policy.'"),
            Rule("none", "info", "NOT home.dom_has_privacy_link AND form_pages = 0", "low",
                 affected="0", message="'There is no privacy policy link.'"),
        ),
    ),
    Check(
        "best_practices.social_proof", 2, "Reviews",
        why="People trust what other customers say.",
        fix="Show a few reviews on the homepage.",
        rules=(
            Rule("none", "info", "NOT (home.dom_review_items OR home.dom_social_proof_words)",
                 affected="0", message="'The homepage shows no reviews.'"),
        ),
    ),
]
