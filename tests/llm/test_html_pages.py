"""The query over the given pages, and generated lists and tables, against independent readings."""

import os
import random
import re
from html.parser import HTMLParser

import pyarrow.parquet as pq
import pytest

from crawlscore.llm import html_text as ht
from crawlscore.llm import queries

DATA = "/root/testdata/sf0.001"
UNSEEN = {"head", "script", "style", "template", "noscript", "title"}


class Reading(HTMLParser):
    """The shown characters of a well-formed page in order, white space left out; marks of list items included."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.shown, self.unseen, self.lists = [], 0, []

    def handle_starttag(self, tag, attrs):
        if tag in UNSEEN:
            self.unseen += 1
        elif tag in ("ul", "ol"):
            self.lists.append(0 if tag == "ol" else None)
        elif tag == "li":
            if self.lists and self.lists[-1] is not None:
                self.lists[-1] += 1
                self.shown.append(f"{self.lists[-1]}.")
            else:
                self.shown.append("-")

    def handle_endtag(self, tag):
        if tag in UNSEEN:
            self.unseen -= 1
        elif tag in ("ul", "ol"):
            self.lists.pop()

    def handle_data(self, data):
        if not self.unseen:
            self.shown.append(data)

    @classmethod
    def of(cls, markup):
        reading = cls()
        reading.feed(markup or "")
        reading.close()
        return re.sub(r"[ \t\n\f\r]", "", "".join(reading.shown))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the given tables are not here")
def test_query_shows_what_a_plain_reading_shows(spark):
    pages = dict(zip(*[pq.read_table(f"{DATA}/pages.parquet")[c].to_pylist() for c in ("page_id", "html")]))
    rows = queries.QUERIES["op5_html_text"](spark, DATA).collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert re.sub(r"[ \t\n\f\r]", "", r.text) == Reading.of(pages[r.page_id]), r.page_id
        assert (r.n_chars, r.n_lines) == (len(r.text), r.text.count("\n") + 1)


def words(rng, least=1):
    return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(least, 4)))


def nested_list(rng, depth):
    """Markup of a list, and its lines."""
    ordered, start = rng.random() < 0.5, rng.randint(1, 99)
    markup, lines = (f"<ol start={start}>" if ordered else "<ul>"), []
    for k in range(rng.randint(1, 4)):
        mark = f"{start + k}. " if ordered else "- "
        text = words(rng)
        markup += f"<li>{text}"
        own = [text]
        if depth and rng.random() < 0.5:
            inner, below = nested_list(rng, depth - 1)
            markup += inner
            own += below
        lines += [(mark if n == 0 else " " * len(mark)) + line for n, line in enumerate(own)]
        markup += "</li>" if rng.random() < 0.5 else ""
    return markup + ("</ol>" if ordered else "</ul>"), lines


def test_nested_lists_are_marked_and_indented():
    rng = random.Random(11)
    for _ in range(300):
        markup, lines = nested_list(rng, 4)
        assert ht.render(f"x{markup}y").split("\n") == ["x", "", *lines, "", "y"], markup


def test_cells_stand_in_columns():
    rng = random.Random(12)
    for _ in range(300):
        columns = rng.randint(1, 5)
        cells = [[words(rng) for _ in range(columns)] for _ in range(rng.randint(1, 6))]
        close = rng.random() < 0.5  # end tags of cells and rows may be left out
        markup = "<table>" + "".join(
            "<tr>" + "".join(f"<td>{c}" + "</td>" * close for c in row) + "</tr>" * close for row in cells) + "</table>"
        widths = [max(len(row[k]) for row in cells) for k in range(columns)]
        lines = ["  ".join(c.ljust(w) for c, w in zip(row, widths)).rstrip() for row in cells]
        assert ht.render(markup).split("\n") == lines, markup


def test_tables_in_cells_keep_their_columns():
    rng = random.Random(13)
    for _ in range(100):
        inner = [[words(rng) for _ in range(2)] for _ in range(rng.randint(1, 4))]
        left, below = words(rng), words(rng)
        markup = ("<table><tr><td>" + left + "<td><table>" + "".join(f"<tr><td>{a}<td>{b}" for a, b in inner)
                  + f"</table><tr><td>{below}<td>end</table>")
        width, first = max(len(left), len(below)), max(len(a) for a, _ in inner)
        block = [f"{a.ljust(first)}  {b}" for a, b in inner]
        lines = [(left if n == 0 else "").ljust(width) + "  " + line for n, line in enumerate(block)]
        assert ht.render(markup).split("\n") == [*lines, f"{below.ljust(width)}  end"], markup
