"""Search visibility checks."""

from crawlscore import fixed_values as fv
from crawlscore.functions import robots
from crawlscore.operators.checks.spec import Check, Rule, share, some

_DESCRIBED = f"length(description) BETWEEN {fv.DESCRIPTION_MIN} AND {fv.DESCRIPTION_MAX}"
_NO_DESCRIPTION = "coalesce(description, '') = ''"
_BAD_LENGTH = f"description <> '' AND NOT ({_DESCRIBED})"
_LACKING = "('missing', 'incomplete')"

CHECKS = [
    Check(
        "seo.title", 8, "Page titles",
        why="The title is what people click in search results.",
        fix="Give every page its own title of 10 to 60 characters.",
        facts={
            "titles_missing": "count_if(title = '')",
            "titles_long": f"count_if(length(title) > {fv.TITLE_MAX})",
            "titles_short": f"count_if(title <> '' AND length(title) < {fv.TITLE_MIN})",
        },
        partial=share("pages", "titles_missing", "titles_long + titles_short"),
        rules=(
            Rule("missing", "fail", "titles_missing > 0", "high", affected="titles_missing",
                 pages="title = ''",
                 message=some("titles_missing", "pages", "pages have no title.")),
            Rule("long", "warn", "titles_long > 0", "low", affected="titles_long",
                 pages=f"length(title) > {fv.TITLE_MAX}",
                 message=some("titles_long", "pages", "pages have a title over 60 characters.")),
            Rule("short", "warn", "titles_short > 0", affected="titles_short",
                 pages=f"title <> '' AND length(title) < {fv.TITLE_MIN}",
                 message=some("titles_short", "pages", "pages have a title too short to tell.")),
        ),
    ),
    Check(
        "seo.meta_description", 6, "Search descriptions",
        why="The description is the text under the title in search results.",
        fix="Describe every page in 50 to 160 characters.",
        facts={
            "descriptions_missing": f"count_if({_NO_DESCRIPTION})",
            "descriptions_bad": f"count_if({_BAD_LENGTH})",
        },
        partial=share("pages", "0", "descriptions_missing * 2 + descriptions_bad"),
        rules=(
            Rule("missing", "warn", "descriptions_missing > 0", affected="descriptions_missing",
                 pages=_NO_DESCRIPTION,
                 message=some("descriptions_missing", "pages", "pages have no description.")),
            Rule("length", "warn", "descriptions_bad > 0", "low", affected="descriptions_bad",
                 pages=_BAD_LENGTH,
                 message=some("descriptions_bad", "pages", "descriptions have the wrong length.")),
        ),
    ),
    Check(
        "seo.single_h1", 5, "Main heading",
        why="One main heading tells what a page is about.",
        fix="Keep exactly one h1 on every page.",
        facts={
            "h1_none": "count_if(h1_count = 0)",
            "h1_several": "count_if(h1_count > 1)",
        },
        partial=share("pages", "0", "h1_none + h1_several"),
        rules=(
            Rule("none", "warn", "h1_none > 0", affected="h1_none", pages="h1_count = 0",
                 message=some("h1_none", "pages", "pages have no main heading.")),
            Rule("several", "warn", "h1_several > 0", "low", affected="h1_several",
                 pages="h1_count > 1",
                 message=some("h1_several", "pages", "pages have several main headings.")),
        ),
    ),
    Check(
        "seo.canonical", 3, "Preferred address",
        why="A canonical address keeps rankings from splitting between copies.",
        fix="Name the full address of the homepage once, in a canonical link.",
        rules=(
            Rule("none", "warn", "size(home.canonicals) = 0", "low",
                 message="'The homepage names no preferred address.'"),
            Rule("several", "warn", "size(array_distinct(home.canonicals)) > 1",
                 message="'The homepage names several preferred addresses.'"),
            Rule("relative", "warn",
                 "size(array_distinct(home.canonicals)) = 1 AND NOT "
                 "get(home.canonicals, 0) RLIKE '^https?://'", "low",
                 message="'The preferred address of the homepage is incomplete.'"),
            Rule("elsewhere", "fail",
                 "size(array_distinct(home.canonicals)) = 1 AND get(home.canonicals, 0) RLIKE "
                 "'^https?://' AND lower(regexp_extract(get(home.canonicals, 0), "
                 "r\"^https?://(?:[^/?#]*@)?([^/?#:]*)\", 1)) <> lower(regexp_extract("
                 "home_url, r\"^https?://(?:[^/?#]*@)?([^/?#:]*)\", 1))", "high",
                 message="'The homepage calls a page on another website the real one.'"),
        ),
    ),
    Check(
        "seo.robots_txt", 5, "robots.txt",
        why="robots.txt tells search engines what they may visit.",
        fix="Publish a robots.txt that lets search engines in.",
        tables=("robots",),
        facts={"google_allowed": robots.allows("robots.robots_groups", "Googlebot", "home_url")},
        rules=(
            Rule("missing", "warn", "NOT coalesce(robots.robots_exists, false)", "low",
                 message="'There is no robots.txt.'"),
            Rule("blocks_google", "fail",
                 "coalesce(robots.robots_exists, false) AND NOT google_allowed", "high",
                 message="'robots.txt keeps search engines off the homepage.'"),
        ),
    ),
    Check(
        "seo.sitemap", 4, "Sitemap",
        why="A sitemap helps search engines find all pages.",
        fix="Publish a sitemap and name it in robots.txt.",
        tables=("sitemaps", "robots"),
        pass_when="coalesce(sitemaps.sitemap_found, false) AND sitemaps.sitemap_urls > 0",
        rules=(
            Rule("missing", "warn", "NOT coalesce(sitemaps.sitemap_found, false)",
                 message="'No sitemap was found.'"),
            Rule("empty", "warn",
                 "coalesce(sitemaps.sitemap_found, false) AND sitemaps.sitemap_urls = 0",
                 message="'The sitemap lists no pages.'"),
            Rule("unannounced", "info",
                 "coalesce(sitemaps.sitemap_found, false) AND sitemaps.sitemap_urls > 0 AND "
                 "coalesce(robots.robots_exists, false) AND size(robots.robots_sitemaps) = 0",
                 "low", message="'robots.txt does not mention the sitemap.'"),
        ),
    ),
    Check(
        "seo.indexable", 9, "Allowed in search",
        why="A noindex instruction keeps a page out of search results.",
        fix="Remove noindex from pages that should be found.",
        facts={"pages_noindex": "count_if(noindex)"},
        rules=(
            Rule("home", "fail", "home.noindex", "high", affected="pages_noindex",
                 pages="noindex", message="'The homepage asks to be left out of search.'"),
            Rule("pages", "info", "NOT home.noindex AND pages_noindex > 0", "low",
                 affected="pages_noindex", pages="noindex",
                 message=some("pages_noindex", "pages", "pages ask to be left out of search.")),
        ),
    ),
    Check(
        "seo.social_tags", 4, "Link previews",
        why="Preview tags decide how a shared link looks.",
        fix="Give every page a preview title, text, full picture address and card type.",
        facts={"previews_lacking": "count_if(size(preview_problems) > 0)"},
        tables=("site_probe",),
        partial=share("pages", "0", "previews_lacking"),
        rules=(
            Rule("incomplete", "warn", "previews_lacking > 0",
                 "CASE WHEN size(home.preview_problems) > 0 THEN 'medium' ELSE 'low' END",
                 affected="previews_lacking", pages="size(preview_problems) > 0",
                 message="CASE WHEN size(home.preview_problems) = 4 THEN "
                         "'The homepage has no link preview tags.' ELSE "
                         + some("previews_lacking", "pages", "pages have an incomplete preview.")
                         + " END"),
            Rule("broken_image", "warn",
                 "coalesce(site_probe.og_image_url, '') <> '' AND (site_probe.og_image_status = 0 "
                 "OR site_probe.og_image_status >= 400 OR site_probe.og_image_type = '' OR "
                 "site_probe.og_image_too_big)",
                 message="'The preview picture of the homepage does not show.'"),
        ),
    ),
    Check(
        "seo.page_schema", 4, "Page schema",
        why="Structured data tells machines exactly what a page is.",
        fix="Add the missing JSON-LD properties of the page's type.",
        facts={
            "schema_broken": "count_if(json_broken)",
            "schema_lacking_raw": f"count_if(schema_elsewhere IN {_LACKING})",
            "schema_richer_raw": "count_if(schema_elsewhere = 'could be richer')",
            "schema_lacking": f"schema_lacking_raw - if(home.schema_elsewhere IN {_LACKING}, 1, 0)"
                              f" + if(home.schema_as_home IN {_LACKING}, 1, 0)",
            "schema_richer": "schema_richer_raw - if(home.schema_elsewhere = 'could be richer', 1, 0)"
                             " + if(home.schema_as_home = 'could be richer', 1, 0)",
        },
        rules=(
            Rule("broken", "fail", "schema_broken > 0", affected="schema_broken",
                 pages="json_broken",
                 message=some("schema_broken", "pages", "pages have broken structured data.")),
            Rule("lacking", "warn", "schema_lacking > 0",
                 f"CASE WHEN home.schema_as_home IN {_LACKING} THEN 'medium' ELSE 'low' END",
                 affected="schema_lacking",
                 pages=f"if(is_home, schema_as_home, schema_elsewhere) IN {_LACKING}",
                 message=some("schema_lacking", "pages", "pages lack structured data.")),
            Rule("richer", "info", "schema_richer > 0", "low", affected="schema_richer",
                 pages="if(is_home, schema_as_home, schema_elsewhere) = 'could be richer'",
                 message=some("schema_richer", "pages", "pages could say more about themselves.")),
        ),
    ),
    Check(
        "seo.broken_links", 6, "Broken links",
        why="Dead links frustrate visitors and waste attention.",
        fix="Correct or redirect each dead link.",
        tables=("link_status",), requires=("probes",),
        na="coalesce(link_status.internal_total, 0) <= 1",
        partial=share("link_status.internal_total", "link_status.internal_broken"),
        rules=(
            Rule("broken", "fail", "link_status.internal_broken > 0", "medium",
                 "CASE WHEN link_status.internal_broken > 5 THEN 'medium' ELSE 'low' END",
                 affected="link_status.internal_broken",
                 message=some("link_status.internal_broken", "link_status.internal_total",
                              "internal links are broken.")),
        ),
    ),
    Check(
        "seo.duplicate_titles", 4, "Unique titles",
        why="Equal titles make pages hard to tell apart.",
        fix="Say in each title what is different about the page.",
        tables=("title_groups",), na="pages < 2",
        rules=(
            Rule("shared", "warn", "coalesce(title_groups.titles_shared, 0) > 0",
                 affected="title_groups.titles_shared",
                 message="concat(title_groups.titles_shared, ' pages share their title.')"),
        ),
    ),
    Check(
        "seo.contact_details", 4, "Contact details",
        why="People ready to buy look for a number or an address first.",
        fix="Show a phone number and a mail address on the homepage.",
        facts={
            "contact_pages": "count_if(size(tel_links) > 0 OR size(mail_links) > 0 OR "
                             "size(phones) > 0)",
            "contact_elsewhere": "contact_pages - if(size(home.tel_links) > 0 OR "
                                 "size(home.mail_links) > 0 OR size(home.phones) > 0, 1, 0)",
            "contact_on_home": "size(home.dom_tel_links) > 0 OR size(home.dom_mail_links) > 0 OR "
                               "size(home.dom_phones) > 0 OR home.dom_has_email",
        },
        rules=(
            Rule("elsewhere", "info", "NOT contact_on_home AND contact_elsewhere > 0", "low",
                 affected="contact_elsewhere",
                 message="'Contact details stand only on other pages.'"),
            Rule("none", "warn", "NOT contact_on_home AND contact_elsewhere = 0", "high",
                 message="'No phone number or mail address was found.'"),
        ),
    ),
    Check(
        "seo.click_to_call", 3, "Numbers to tap",
        why="On a phone people expect to tap a number.",
        fix="Wrap phone numbers in tel: links.",
        na="size(home.dom_phones) = 0 AND size(home.dom_tel_links) = 0",
        facts={
            "phones_not_linked": "filter(home.dom_phones, p -> NOT exists(home.dom_tel_links, t -> "
            "length(regexp_replace(p, r\"\\D\", '')) >= 9 AND "
            "length(regexp_replace(t, r\"\\D\", '')) >= 9 AND "
            "right(regexp_replace(p, r\"\\D\", ''), 9) = right(regexp_replace(t, r\"\\D\", ''), 9)))",
        },
        rules=(
            Rule("plain_text", "warn", "size(phones_not_linked) > 0",
                 message="concat('The number ', get(phones_not_linked, 0), ' cannot be tapped.')"),
        ),
    ),
    Check(
        "seo.whatsapp_chat", 1, "Chat link",
        why="Many customers rather write than call.",
        fix="Link to a WhatsApp chat if you answer there.",
        rules=(
            Rule("none", "info", "NOT home.dom_has_whatsapp", "low", affected="0",
                 message="'The homepage has no WhatsApp link.'"),
        ),
    ),
    Check(
        "seo.directions", 1, "Directions",
        why="A map link brings visitors to the door.",
        fix="Link to a map on the contact page.",
        facts={
            "map_pages": "count_if(dom_has_map)",
        },
        rules=(
            Rule("none", "info", "map_pages = 0", "low", affected="0",
                 message="'No map or directions link was found.'"),
        ),
    ),
    Check(
        "seo.heading_structure", 4, "Heading outline",
        why="Headings are the outline people and search engines skim.",
        fix="Give each page one own h1 first, then h2 and h3 with real words.",
        facts={
            "outlined_pages": "count_if(size(dom_outline) > 0)",
            "outline_faulty": "count_if(dom_empty_heading OR dom_h1_not_first)",
            "outline_notes": "count_if(dom_heading_notes)",
            "outline_serious": "outline_faulty + coalesce(h1_groups.h1_shared_only, 0)",
        },
        tables=("h1_groups",), na="outlined_pages = 0",
        partial=share("outlined_pages", "0", "outline_serious"),
        rules=(
            Rule("serious", "warn", "outline_serious > 0",
                 "CASE WHEN home.dom_empty_heading OR home.dom_h1_not_first OR "
                 "coalesce(h1_groups.h1_home_shared AND h1_groups.h1_first_key = home_key, false) "
                 "THEN 'medium' ELSE 'low' END",
                 affected="outline_serious",
                 message=some("outline_serious", "pages", "pages have a confusing outline.")),
            Rule("notes", "info", "outline_serious = 0 AND outline_notes > 0", "low",
                 affected="outline_notes", pages="dom_heading_notes",
                 message=some("outline_notes", "pages", "pages could be outlined better.")),
        ),
    ),
    Check(
        "seo.image_seo", 4, "Image descriptions and names",
        why="Search engines know pictures by their description and file name.",
        fix="Describe what each picture shows, and name the file after it.",
        features={
            "image_verdicts": "transform(judged_images, i -> struct("
            "NOT i.has_alt OR (trim(coalesce(i.alt, '')) <> '' AND (regexp_replace(lower(trim(i.alt)), "
            "'^[ .]+|[ .]+$', '') IN (" + ", ".join(f"'{w}'" for w in fv.GENERIC_ALT) + ") OR "
            f"trim(i.alt) RLIKE r\"{fv.IMAGE_FILE}\" OR trim(i.alt) RLIKE r\"{fv.CAMERA_NAME}\")) AS bad, "
            f"length(trim(coalesce(i.alt, ''))) > {fv.ALT_MAX} OR regexp_replace(substring_index("
            "regexp_extract(i.src, r\"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)\", 1), '/', -1), "
            f"r\"{fv.IMAGE_FILE}\", '') RLIKE r\"{fv.CAMERA_NAME}\" AS note))",
            "images_bad": "size(filter(image_verdicts, v -> v.bad))",
            "images_noted": "size(filter(image_verdicts, v -> NOT v.bad AND v.note))",
        },
        facts={
            "images_judged": "sum(size(dom_image_verdicts))",
            "images_bad_total": "sum(dom_images_bad)",
            "images_noted_total": "sum(dom_images_noted)",
            "images_bad_pages": "count_if(dom_images_bad > 0)",
            "images_noted_pages": "count_if(dom_images_noted > 0)",
        },
        na="images_judged = 0",
        partial=share("images_judged", "0", "images_bad_total"),
        rules=(
            Rule("bad_alt", "warn", "images_bad_total > 0", "medium",
                 "CASE WHEN images_bad_total > 10 THEN 'medium' ELSE 'low' END",
                 affected="images_bad_pages", pages="dom_images_bad > 0",
                 message=some("images_bad_total", "images_judged",
                              "pictures have no useful description.")),
            Rule("notes", "info", "images_bad_total = 0 AND images_noted_total > 0", "low",
                 affected="images_noted_pages", pages="dom_images_noted > 0",
                 message=some("images_noted_total", "images_judged",
                              "pictures could be named better.")),
        ),
    ),
    Check(
        "seo.url_structure", 3, "Clean addresses",
        why="Clean addresses are easy to read, share and trust.",
        fix="Use short lower-case addresses with hyphens; redirect the old ones.",
        tables=("address_quality",),
        partial=share("address_quality.addresses", "0", "address_quality.addresses_bad"),
        rules=(
            Rule("bad", "warn", "address_quality.addresses_bad > 0", "low", "medium",
                 affected="address_quality.addresses_bad",
                 message=some("address_quality.addresses_bad", "address_quality.addresses",
                              "addresses break the usual rules.")),
            Rule("notes", "info",
                 "address_quality.addresses_bad = 0 AND address_quality.addresses_noted > 0", "low",
                 affected="address_quality.addresses_noted",
                 message=some("address_quality.addresses_noted", "address_quality.addresses",
                              "addresses could be simpler.")),
        ),
    ),
    Check(
        "seo.meta_tags", 4, "Essential meta tags",
        why="Meta tags tell browsers and search engines the basics of a page.",
        fix="Add the missing tags to the head of each page.",
        facts={
            "tags_core_missing": "count_if(size(core_tags_missing) > 0)",
            "tags_lang_only": "count_if(size(core_tags_missing) = 0 AND lang = '')",
            "tags_refresh": "count_if(refresh_meta IS NOT NULL)",
        },
        partial=share("pages", "0", "tags_core_missing + tags_refresh"),
        rules=(
            Rule("missing", "warn", "tags_core_missing > 0", affected="tags_core_missing",
                 pages="size(core_tags_missing) > 0",
                 message=some("tags_core_missing", "pages", "pages miss essential meta tags.")),
            Rule("no_language", "info", "tags_core_missing = 0 AND tags_lang_only > 0", "low",
                 affected="tags_lang_only", pages="lang = ''",
                 message=some("tags_lang_only", "pages", "pages do not name their language.")),
            Rule("refresh", "warn", "tags_refresh > 0", "low", affected="tags_refresh",
                 pages="refresh_meta IS NOT NULL",
                 message=some("tags_refresh", "pages", "pages reload or jump by themselves.")),
        ),
    ),
    Check(
        "seo.broken_external_links", 3, "Links to other websites",
        why="Dead links to others make a site look out of date.",
        fix="Correct or remove each dead link.",
        tables=("link_status",), requires=("probes",),
        na="coalesce(link_status.external_verified, 0) = 0",
        partial=share("link_status.external_verified", "link_status.external_broken"),
        rules=(
            Rule("broken", "warn", "link_status.external_broken > 0", "low",
                 affected="link_status.external_broken",
                 message=some("link_status.external_broken", "link_status.external_verified",
                              "links to other websites are broken.")),
        ),
    ),
    Check(
        "seo.broken_images", 4, "Broken images",
        why="A picture that does not load leaves a hole on the page.",
        fix="Upload the missing pictures again or remove them.",
        tables=("link_status",), requires=("probes",),
        na="coalesce(link_status.image_total, 0) = 0",
        partial=share("link_status.image_total", "link_status.image_broken"),
        rules=(
            Rule("broken", "fail", "link_status.image_broken > 0",
                 affected="link_status.image_broken",
                 message=some("link_status.image_broken", "link_status.image_total",
                              "pictures do not load.")),
        ),
    ),
]
