"""HTML extraction: pages laid out as text, with all that a reader would see.

A tokenizer feeds a tree builder, which supplies the tags that HTML implies (ends of paragraphs, list items,
cells and options, missing rows) and ignores ends that match nothing. Elements that are hidden by kind, by
attribute or by inline style give no text. Inside svg and math a start tag that ends in '/' has no content, and
HTML blocks end the drawing, as in browsers. Of drawings the text elements and embedded HTML (foreignObject)
give text, not titles, descriptions, definitions and metadata (copies by use are not followed); of formulas
all but annotations. What is left is laid out: white space collapses, blocks start new
lines, paragraphs and the like keep a blank line, list items get their mark and indent, preformatted text
stays, and the cells of a table stand in columns of equal width. Buttons and fields are boxes of their own, so what is
beside them is another word; soft hyphens, which browsers show only where they break a word, are left out.

The tree is walked as it is built, with an explicit stack, so depth is not limited. Neither parser nor
layout looks at other pages: Spark deals out the pages, and a task holds one at a time.

Defined results: a null or empty page gives ''. Broken markup never fails: an unfinished tag at the end is
dropped, a '<' that starts no tag is text. Repeated rows are laid out alike; own columns are kept,
whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crawlscore.llm import common, ragged

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\f\r]+")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_BARE_SLASH = re.compile(r"=\s*(?:[^\s\"']\S*)?/$")  # the '/' belongs to a value without quotes
_STYLE = re.compile(r"(display|visibility|white-space)\s*:\s*([a-z-]+)")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Text up to the end tag, without tags inside.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HIDDEN = frozenset("head script style title template noscript iframe noembed noframes datalist audio video canvas "
                   "object rp".split())
#: Boxes within a line.
CONTROLS = frozenset("button textarea select".split())
SOFT_HYPHEN = "\u00ad"
#: Elements of drawings and formulas that are not shown themselves.
UNDRAWN = {
    "svg": frozenset("title desc defs metadata style script symbol clippath mask pattern marker filter lineargradient "
                     "radialgradient".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
#: Elements of drawings and formulas that hold HTML.
POINTS = {"svg": frozenset("foreignobject title desc".split()), "math": frozenset("mi mo mn ms mtext".split())}
#: HTML start tags that end a drawing or formula.
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr "
    "ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
#: Blank lines before and after.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu fieldset".split())
BLOCKS = SPACED | frozenset(
    "html body div section article aside nav header footer main address form details summary dialog legend "
    "figcaption li dt dd center search hgroup option optgroup caption tr td th thead tbody tfoot xmp".split())
#: Start tags that end an open paragraph.
ENDS_P = (SPACED | frozenset("address article aside center details dialog div dl figcaption footer form header "
                             "hgroup li main nav search section summary dt dd".split())) - {"tr", "td", "th"}
#: Start tag: the open elements it ends, unless one of the bounds stands above them.
IMPLIED = {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu", "td", "th"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl", "td", "th"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl", "td", "th"})),
    "option": (frozenset({"option"}), frozenset({"select", "datalist"})),
    "optgroup": (frozenset({"option", "optgroup"}), frozenset({"select"})),
    "tr": (frozenset({"tr", "td", "th", "caption"}), frozenset({"table"})),
    "td": (frozenset({"td", "th", "caption"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th", "caption"}), frozenset({"tr", "table"})),
    **{k: (frozenset({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}), frozenset({"table"}))
       for k in ("thead", "tbody", "tfoot")},
}
#: End tags of other elements do not reach beyond these.
WALLS = frozenset({"table", "td", "th", "caption"})


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), html.unescape(double or single or bare))
    return out


def _self_closing(raw: str) -> bool:
    return raw.endswith("/") and not _BARE_SLASH.search(_QUOTED.sub('""', raw))


class Flow:
    """Lines being laid out, with collapsed white space and at most one blank line between blocks."""

    __slots__ = ("lines", "line", "gap", "open_space")

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.gap = 0  # blank lines wanted before the next text
        self.open_space = True  # white space at this place would collapse

    def text(self, text: str) -> None:
        text = _SPACE.sub(" ", text)
        if self.open_space:
            text = text.lstrip(" ")
        if text:
            self.line.append(text)
            self.open_space = text[-1] == " "

    def apart(self) -> None:
        """What follows stands elsewhere on the page, so it is another word."""
        if self.line and not self.open_space:
            self.line.append(" ")
            self.open_space = True

    def end_line(self, gap: int = 0) -> None:
        """End the line if it holds text; ask for `gap` blank lines before the next."""
        if self.line:
            self._put("".join(self.line).rstrip(" "))
            self.line.clear()
        self.open_space = True
        self.gap = max(self.gap, gap)

    def hard_break(self) -> None:
        if self.line:
            self.end_line()
        elif self.lines:
            self.gap = max(self.gap, 1)

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = 0
        self.lines.append(line)

    def block(self, lines: list[str]) -> None:
        """Lines that are laid out already."""
        self.end_line()
        if lines:
            self._put(lines[0])
            self.lines.extend(lines[1:])

    def done(self) -> list[str]:
        self.end_line()
        return self.lines


class Table:
    """Rows of laid-out cells; columns get the width of their widest cell."""

    def __init__(self) -> None:
        self.rows: list[list[tuple[list[str], int, int]]] = []

    def layout(self) -> list[str]:
        placed: list[tuple[int, int, int, list[str]]] = []  # row, column, columns, lines
        taken: dict[tuple[int, int], bool] = {}
        n_columns = 0
        for r, row in enumerate(self.rows):
            c = 0
            for lines, columns, rows in row:
                while (r, c) in taken:
                    c += 1
                for k in range(columns):
                    for down in range(1, min(rows, len(self.rows) - r)):
                        taken[r + down, c + k] = True
                placed.append((r, c, columns, lines))
                c += columns
            n_columns = max(n_columns, c)
        widths = [0] * n_columns
        for _, c, columns, lines in placed:
            if columns == 1:
                widths[c] = max(widths[c], max(map(len, lines), default=0))
        for _, c, columns, lines in placed:
            if columns > 1:
                lack = max(map(len, lines), default=0) - sum(widths[c:c + columns]) - 2 * (columns - 1)
                widths[c + columns - 1] += max(lack, 0)
        starts = [0]
        for width in widths:
            starts.append(starts[-1] + (width + 2 if width else 0))
        out: list[str] = []
        by_row: dict[int, list[tuple[int, list[str]]]] = {}
        for r, c, _, lines in placed:
            by_row.setdefault(r, []).append((c, lines))
        for r in range(len(self.rows)):
            cells = by_row.get(r, [])
            for k in range(max((len(lines) for _, lines in cells), default=0)):
                line = ""
                for c, lines in cells:
                    if k < len(lines) and lines[k]:
                        line = line.ljust(starts[c]) + lines[k]
                if line or k:
                    out.append(line.rstrip())
        return out


class Open:
    """An open element."""

    __slots__ = ("tag", "hidden", "unseen", "pre", "flow", "table", "mark", "count", "span", "space", "mute", "point")

    def __init__(self, tag: str):
        self.tag, self.hidden, self.unseen, self.pre = tag, False, False, False
        self.flow: Flow | None = None  # of its own, put into the parent's when it ends
        self.table: Table | None = None
        self.mark, self.count, self.span = "", 0, (1, 1)
        self.space = ""  # svg or math
        self.mute = False  # in a drawing, but in none of its text elements
        self.point = False  # of a drawing or formula, with HTML inside


def _number(text: str | None, default: int) -> int:
    found = re.match(r"\s*(-?\d{1,9})", text or "")
    return int(found.group(1)) if found else default


class Page:
    """Builds the tree of one page and lays it out on the way."""

    def __init__(self) -> None:
        root = Open("#root")
        root.flow = Flow()
        self.stack = [root]
        self.flows = [root.flow]
        self.count: dict[str, int] = {}  # open elements by tag

    # --- tree ---

    def _push(self, tag: str, attributes: dict[str, str], space: str = "") -> None:
        above, node = self.stack[-1], Open(tag)
        node.hidden = above.hidden or tag in (UNDRAWN[space] if space else HIDDEN) or "hidden" in attributes
        node.unseen, node.pre = above.unseen, above.pre or (not space and tag in ("pre", "textarea", "xmp"))
        if space:
            self._draw(node, above, attributes, space)
        if above.tag == "details" and above.span == (0, 0) and tag != "summary":
            node.hidden = True
        if "style" in attributes:
            for name, value in _STYLE.findall(attributes["style"].lower()):
                if name == "display" and value == "none":
                    node.hidden = True
                elif name == "visibility":
                    node.unseen = value in ("hidden", "collapse")
                elif name == "white-space":
                    node.pre = value in ("pre", "pre-wrap", "break-spaces")
        if tag == "dialog" and "open" not in attributes:
            node.hidden = True
        if tag == "details" and "open" not in attributes:
            node.span = (0, 0)
        self.stack.append(node)
        self.count[tag] = self.count.get(tag, 0) + 1
        if node.hidden:
            return
        if space:
            if self._stands_apart(node, above, attributes):
                self.flows[-1].apart()
            return
        if tag in BLOCKS:
            nested_list = tag in ("ul", "ol", "menu") and self.count.get("li", 0)
            self.flows[-1].end_line(1 if tag in SPACED and not nested_list else 0)
        elif tag in CONTROLS:
            self.flows[-1].apart()
        if tag == "ol":
            node.count = _number(attributes.get("start"), 1)
        elif tag == "li":
            owner = next((n for n in reversed(self.stack[:-1]) if n.tag in ("ul", "ol", "menu")), None)
            if owner is not None and owner.tag == "ol":
                owner.count = _number(attributes.get("value"), owner.count)
                node.mark = f"{owner.count}. "
                owner.count += 1
            else:
                node.mark = "- "
        elif tag == "blockquote":
            node.mark = "> "
        elif tag == "dd":
            node.mark = "    "
        elif tag == "table":
            node.table = Table()
        elif tag == "tr":
            if (table := self._table()) is not None:
                table.rows.append([])
        elif tag in ("td", "th"):
            node.span = (max(1, min(_number(attributes.get("colspan"), 1), 1000)),
                         max(1, min(_number(attributes.get("rowspan"), 1), 65534)))
        if node.mark or tag in ("table", "td", "th"):
            node.flow = Flow()
            self.flows.append(node.flow)

    def _draw(self, node: Open, above: Open, attributes: dict[str, str], space: str) -> None:
        """What holds for elements of drawings and formulas."""
        tag = node.tag
        node.space, node.point = space, tag in POINTS[space]
        if space == "svg":
            node.mute = tag != "text" and tag != "foreignobject" and (above.space != "svg" or above.mute)
            node.hidden = node.hidden or attributes.get("display") == "none"
            if "visibility" in attributes:
                node.unseen = attributes["visibility"] in ("hidden", "collapse")
            if above.tag == "switch" and above.space and "systemlanguage" not in attributes:
                node.hidden = node.hidden or above.count > 0  # the first that fits is shown
                above.count += 1
        elif tag == "mphantom":
            node.unseen = True
        elif tag == "annotation-xml":
            node.point = attributes.get("encoding", "").lower() in ("text/html", "application/xhtml+xml")

    @staticmethod
    def _stands_apart(node: Open, above: Open, attributes: dict[str, str]) -> bool:
        if node.space == "svg":
            return node.tag in ("text", "foreignobject") or (
                node.tag == "tspan" and not attributes.keys().isdisjoint(("x", "y", "dy")))
        return node.tag in ("mtd", "mfrac") or (above.tag == "mfrac" and bool(above.space))

    def _table(self) -> Table | None:
        return next((n.table for n in reversed(self.stack) if n.table is not None), None)

    def _pop(self) -> None:
        node = self.stack.pop()
        self.count[node.tag] -= 1
        if node.hidden:
            return
        if node.space:
            if node.tag in ("text", "foreignobject", "mfrac"):
                self.flows[-1].apart()
            return
        tag = node.tag
        lines = None
        if node.flow is not None:
            self.flows.pop()
            lines = node.flow.done()
        if tag in ("td", "th"):
            table = self._table()
            if table is not None and table.rows:
                table.rows[-1].append((lines, *node.span))
            else:
                self.flows[-1].block(lines)
        elif node.table is not None:
            grid = node.table.layout()
            self.flows[-1].block(lines + grid if lines else grid)  # text between cells stands before the table
        elif node.mark:
            if lines:
                first, rest = (node.mark, node.mark) if tag == "blockquote" else (node.mark, " " * len(node.mark))
                self.flows[-1].block([(first if k == 0 else rest) + line if line else (rest.rstrip()) for k, line in enumerate(lines)])
        if tag in BLOCKS:
            nested_list = tag in ("ul", "ol", "menu") and self.count.get("li", 0)
            self.flows[-1].end_line(1 if tag in SPACED and not nested_list else 0)
        elif tag in CONTROLS:
            self.flows[-1].apart()

    def _close(self, tags: frozenset[str], bounds: frozenset[str]) -> None:
        """Pop up to the outermost of `tags` that stands before a bound."""
        last = None
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if self.stack[k].point:
                break
            if self.stack[k].space:
                continue
            if tag in tags:
                last = k
            elif tag in bounds:
                break
        if last is not None:
            while len(self.stack) > last:
                self._pop()

    def start(self, tag: str, raw: str) -> None:
        above = self.stack[-1]
        if above.space and not above.point or above.space == "math" and tag in ("mglyph", "malignmark"):
            attributes = _attributes(raw) if "=" in raw else {}
            if tag in BREAKOUT or (tag == "font" and not attributes.keys().isdisjoint(("color", "face", "size"))):
                self._leave_drawing()
            else:
                self._foreign(tag, raw, above.space)
                return
        if tag in ("html", "body") and self.count.get(tag):
            return
        if tag == "body" and self.count.get("head"):
            self._close(frozenset({"head"}), frozenset())
        elif self.count.get("head") and self.stack[-1].tag == "head" and tag not in HIDDEN and tag not in VOID:
            self._pop()  # content ends a head that was left open
        if tag in ENDS_P and self.count.get("p"):
            self._close(frozenset({"p"}), WALLS)
        if tag in IMPLIED and any(self.count.get(t) for t in IMPLIED[tag][0]):
            self._close(*IMPLIED[tag])
        if tag in ("td", "th") and self.count.get("table"):
            self._need_row()
        if tag in POINTS:
            self._foreign(tag, raw, tag)
            return
        attributes = _attributes(raw) if "=" in raw or raw.strip(" /") else {}
        if tag in VOID:
            self._void(tag, attributes)
        else:
            self._push(tag, attributes)

    def _foreign(self, tag: str, raw: str, space: str) -> None:
        self._push(tag, _attributes(raw) if raw.strip(" /") else {}, space)
        if _self_closing(raw):
            self._pop()

    def _leave_drawing(self) -> None:
        while self.stack[-1].space and not self.stack[-1].point:
            self._pop()

    def _need_row(self) -> None:
        for node in reversed(self.stack):
            if node.tag == "tr":
                return
            if node.tag == "table":
                self._push("tr", {})
                return

    def _void(self, tag: str, attributes: dict[str, str]) -> None:
        node = self.stack[-1]
        if node.hidden or node.unseen:
            return
        flow = self.flows[-1]
        if tag == "br":
            flow.hard_break()
        elif tag == "hr":
            flow.end_line(1)
        elif tag == "img" and attributes.get("alt") and "hidden" not in attributes:
            flow.text(attributes["alt"].replace(SOFT_HYPHEN, ""))
        elif tag == "input" and attributes.get("type", "").lower() in ("submit", "button", "reset") and "hidden" not in attributes:
            flow.apart()
            flow.text(attributes.get("value", "").replace(SOFT_HYPHEN, ""))
            flow.apart()

    def end(self, tag: str) -> None:
        if self.stack[-1].space:
            if tag in ("br", "p"):
                self._leave_drawing()
            elif self.count.get(tag):
                k = len(self.stack) - 1
                while self.stack[k].space:
                    if self.stack[k].tag == tag:
                        while len(self.stack) > k:
                            self._pop()
                        return
                    k -= 1
        if tag == "br":
            self._void("br", {})
        elif self.count.get(tag):
            own = frozenset({tag})
            for k in range(len(self.stack) - 1, 0, -1):
                if self.stack[k].space:
                    if self.stack[k].point:
                        return
                    continue
                if self.stack[k].tag in own:
                    while len(self.stack) > k:
                        self._pop()
                    return
                if self.stack[k].tag in WALLS and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                    return

    def text(self, text: str, literal: bool = False) -> None:
        if self.stack[-1].tag == "head" and text.strip():
            self._pop()  # text ends a head that was left open
        node = self.stack[-1]
        if node.hidden or node.unseen or (node.tag == "details" and node.span == (0, 0)):
            return
        if node.mute:
            return
        if node.space == "math" and not node.point and not (text := text.strip(" \t\n\f\r")):
            return
        if "&" in text and not literal:
            text = html.unescape(text)
        if SOFT_HYPHEN in text:
            text = text.replace(SOFT_HYPHEN, "")
        if node.pre:
            flow = self.flows[-1]
            lines = text.replace("\r\n", "\n").split("\n")
            for k, line in enumerate(lines):
                if k:
                    flow._put("".join(flow.line).rstrip())
                    flow.line.clear()
                if line:
                    flow.line.append(line)
                    flow.open_space = False
        else:
            self.flows[-1].text(text)

    def finish(self) -> str:
        while len(self.stack) > 1:
            self._pop()
        return "\n".join(self.flows[0].done()).strip("\n")


def render(markup: str | None) -> str:
    """The visible text of a page."""
    page, at = Page(), 0
    source = markup or ""
    size, lower = len(source), None
    while at < size:
        less = source.find("<", at)
        if less < 0:
            page.text(source[at:])
            break
        if less > at:
            page.text(source[at:less])
        if source.startswith("<!--", less):
            stop = source.find("-->", less + 4)
            at = size if stop < 0 else stop + 3
            continue
        if page.stack[-1].space and source.startswith("<![CDATA[", less):
            stop = source.find("]]>", less + 9)
            page.text(source[less + 9:size if stop < 0 else stop], literal=True)
            at = size if stop < 0 else stop + 3
            continue
        found = _TAG.match(source, less)
        if found is None:
            after = source[less + 1:less + 2]
            if after in ("!", "?") or (after == "/" and not source[less + 2:less + 3].isalpha()):
                stop = source.find(">", less)
                at = size if stop < 0 else stop + 1
                continue
            if not (after.isalpha() or after == "/"):
                page.text("<")
                at = less + 1
                continue
            found = _LOOSE.match(source, less)
            if found is None:
                break  # an unfinished tag at the end
        closing, tag, raw = found.groups()
        tag, at = tag.lower(), found.end()
        if closing:
            page.end(tag)
            continue
        page.start(tag, raw)
        if tag in ("pre", "textarea") and source.startswith("\n", at):
            at += 1  # a line break right after the start tag does not count
        if tag in RAW and not page.stack[-1].space:
            lower = source.lower() if lower is None else lower
            stop = lower.find("</" + tag, at) if len(lower) == size else source.find("</" + tag, at)
            stop = size if stop < 0 else stop
            page.text(source[at:stop])
            at = stop
            if stop == size:
                break
    return page.finish()


def extracted(pages: DataFrame, markup: str = "html", into: str = "visible_text") -> DataFrame:
    """The pages' own columns and their visible text, in a column `into` (with an underscore if it exists)."""
    name, = common.fresh(pages, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, markup):
                texts = pa.array([render(x) for x in part.column(markup).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, name])

    schema = pages.select("*", F.lit("").alias(name)).schema
    return pages.mapInArrow(run, schema)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's visible text, with its length and number of lines."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "html")
    return extracted(pages).select(
        "page_id", F.col("visible_text").alias("text"), F.length("visible_text").cast("long").alias("n_chars"),
        F.size(F.split("visible_text", "\n")).cast("long").alias("n_lines"))
