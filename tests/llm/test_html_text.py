"""Layout of small pages, broken markup, and agreement with a plain reading of generated pages."""

import random
import re

import pytest

from crawlscore.llm import html_text as ht

CASES = {
    "<p>a<p>b<div>c</div>d": "a\n\nb\n\nc\nd",
    "<ul><li>x<li>y<ul><li>z</ul><li>w</ul>t": "- x\n- y\n  - z\n- w\n\nt",
    "<ol start=3><li>a<br>b<li value=9>c</ol>": "3. a\n   b\n9. c",
    "<table><tr><td>a<td>bbb<tr><th colspan=2>wide head<tr><td>cc<td>d</table>": "a   bbb\nwide head\ncc  d",
    "<table><td>a<td>b<tr><td rowspan=2>r<td>x<tr><td>y</table>after": "a  b\nr  x\n   y\n\nafter",
    "<table><tr><td>one<p>two<td>z</table>": "one  z\n\ntwo",
    "<table><tr><td><table><tr><td>in</table><td>out</table>": "in  out",
    "<pre>\na\n  b\n</pre>c": "a\n  b\n\nc",
    "<div style='display: none'>x</div><span hidden>y</span>z": "z",
    "<details><summary>s</summary>t</details><details open><summary>u</summary>v</details>": "s\nu\nv",
    "<p style='visibility:hidden'>q<b style='visibility:visible'>seen</b></p>": "seen",
    "a < b & c &amp; d &lt;e <": "a < b & c & d <e <",
    "<script>var a='<p>';</script>x<!-- y -->z<style>b</style>": "xz",
    "<head><title>t</title><meta x>hi": "hi",
    "<html><head><title>t</title></head><body>hi</body></html>": "hi",
    "<blockquote>q1<p>q2</blockquote><dl><dt>T<dd>D</dl>": "> q1\n>\n> q2\n\nT\n    D",
    "<b><p>x</b>y</p>z": "x\n\nyz",
    "a   <b> b</b>  c\n d": "a b c d",
    "<img alt='pic'> <input type=submit value=Go><input type=hidden value=no>": "pic Go",
    "<select><option>a<option>b</select>": "a\nb",
    "x<a href='y": "x",
    "</p></div></table>x": "x",
    "": "",
}


@pytest.mark.parametrize("markup", CASES)
def test_layout(markup):
    assert ht.render(markup) == CASES[markup]


def test_depth_and_length_are_not_limited():
    assert ht.render("<div>" * 50_000 + "x" + "</div>" * 50_000) == "x"
    assert ht.render("<p>w" * 100_000).split("\n\n") == ["w"] * 100_000


def test_random_markup_never_fails():
    rng = random.Random(1)
    parts = ["<p>", "</p>", "<table>", "</table>", "<tr>", "<td colspan=2>", "</td>", "<li>", "<ul>", "</ol>", "<b", "'", '"', ">", "&am",
             "<!--", "-->", "<script>", "</script>", "text ", "\n", "<br/>", "<pre>", "</", "<?x", "<select><option>", "<details>"]
    for _ in range(3000):
        ht.render("".join(rng.choice(parts) for _ in range(rng.randint(0, 40))))


def test_every_visible_word_is_kept_in_order():
    """Generated pages: words in visible and hidden places, read back word by word."""
    rng = random.Random(2)
    for _ in range(200):
        seen, markup, n = [], [], 0
        for _ in range(rng.randint(1, 40)):
            word = f"w{n}"
            n += 1
            shape = rng.choice(["<p>{}</p>", "<div>{}</div>", "<b>{}</b> ", "<ul><li>{}</ul>", "<h2>{}</h2>", "<table><tr><td>{}</table>",
                                "<pre>{}</pre>", "<i hidden>{}</i>", "<script>{}</script>", "<!-- {} -->", "<div style=display:none>{}</div>"])
            if not re.search("hidden|script|--|none", shape):
                seen.append(word)
            markup.append(shape.format(word))
        assert re.findall(r"w\d+", ht.render("".join(markup))) == seen


def test_rows_keep_their_columns(spark):
    rows = [(i, m, "v", 1) for i, m in enumerate([None, *CASES, "<p>long</p>" * 30_000])] * 2
    pages = spark.createDataFrame(rows, "page_id bigint, html string, visible_text string, text int")
    found = ht.extracted(pages)
    assert found.columns == [*pages.columns, "_visible_text"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r._visible_text == (CASES.get(r.html, "\n\n".join(["long"] * 30_000)) if r.html is not None else "")
    assert ht.extracted(pages.limit(0)).count() == 0
