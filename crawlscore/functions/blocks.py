"""Ready-made blocks of a page as SQL over its features: marked outlines, preview tags, a complete head."""

from __future__ import annotations


def outline_text(outline: str, shared: str = "CAST(array() AS ARRAY<STRING>)") -> str:
    """Indented outline of a page with the problems of each heading marked."""
    h1s = f"size(filter({outline}, x -> x.level = 1))"
    marks = (
        "array_compact(array(CASE WHEN h.text = '' THEN 'empty' END, "
        f"CASE WHEN h.level = 1 AND {h1s} > 1 THEN concat('one of ', {h1s}, ' H1s') END, "
        f"CASE WHEN h.level = 1 AND array_contains({shared}, lower(h.text)) THEN 'also the H1 of another page' END, "
        f"CASE WHEN h.level = 1 AND i > 0 AND get({outline}, 0).level <> 1 AND {h1s} = 1 THEN 'should come first' END, "
        f"CASE WHEN i > 0 AND h.level > get({outline}, i - 1).level + 1 THEN concat('skips H', get({outline}, i - 1).level + 1) END))"
    )
    shown = "CASE WHEN h.text = '' THEN '(no text)' WHEN length(h.text) <= 80 THEN h.text ELSE concat(left(h.text, 77), '...') END"
    return (
        f"array_join(transform({outline}, (h, i) -> concat(repeat('  ', h.level - 1), 'H', h.level, '  ', {shown}, "
        f"CASE WHEN size({marks}) > 0 THEN concat('   <-- ', array_join({marks}, ', ')) ELSE '' END)), '\\n')"
    )


def preview_block(site_name: str = "''", is_article: str = "false") -> str:
    """SQL of the complete set of preview tags for a page, keeping what it has."""
    def tag(kind: str, name: str, value: str) -> str:
        for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            value = f"replace({value}, '{plain}', '{escaped}')"
        return f"concat('<meta {kind}=\"{name}\" content=\"', {value}, '\">')"

    return "concat_ws('\\n', " + ", ".join([
        tag("property", "og:type", f"coalesce(nullif(og_type, ''), if({is_article}, 'article', 'website'))"),
        tag("property", "og:url", "coalesce(nullif(og_url, ''), final_url)"),
        tag("property", "og:title", "coalesce(nullif(og_title, ''), nullif(title, ''), 'REPLACE: headline of this page')"),
        tag("property", "og:description", "coalesce(nullif(og_description, ''), nullif(description, ''), 'REPLACE: a sentence or two about this page')"),
        tag("property", "og:image", "coalesce(nullif(image_url, ''), 'REPLACE: full address of a 1200 x 630 picture')"),
        tag("property", "og:site_name", f"coalesce(nullif(og_site_name, ''), nullif({site_name}, ''), 'REPLACE: business name')"),
        tag("name", "twitter:card", "coalesce(nullif(twitter_card, ''), 'summary_large_image')"),
    ]) + ")"


def head_block() -> str:
    """SQL of a complete head for a page, with the values it already has."""
    def esc(value: str, quote: bool = True) -> str:
        pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")] + ([('"', "&quot;")] if quote else [])
        for plain, escaped in pairs:
            value = f"replace({value}, '{plain}', '{escaped}')"
        return value

    canonical = "if(coalesce(get(canonicals, 0), '') RLIKE '^https?://', get(canonicals, 0), final_url)"
    named = "coalesce(nullif(lang, ''), 'REPLACE: language code')"
    described = "coalesce(nullif(description, ''), 'REPLACE: what this page offers')"
    return (
        "concat_ws('\\n', concat('<html lang=\"', " + esc(named) + ", '\">'), '<head>', '  <meta charset=\"utf-8\">', "
        "'  <meta name=\"viewport\" content=\"width=device-width, initial-scale=1\">', "
        "concat('  <title>', " + esc("coalesce(nullif(title, ''), 'REPLACE: title of this page')", False) + ", '</title>'), "
        "concat('  <meta name=\"description\" content=\"', " + esc(described) + ", '\">'), "
        "concat('  <link rel=\"canonical\" href=\"', " + esc(canonical) + ", '\">'), "
        "CASE WHEN robots_meta <> '' THEN concat('  <meta name=\"robots\" content=\"', " + esc("robots_meta") + ", '\">') END, '</head>')"
    )
