"""HTML to text by layout-aware rendering.

A tree builder repairs the markup (implied end tags, void elements, stray end tags), then the
tree is rendered: visible text alone, blocks on lines of their own with blank lines where
browsers have margins, list items with markers and indents, table cells in aligned columns,
preformatted text as it stands.

Cases: a null or empty page has the text ""; unclosed, misnested or very deep markup is read to
the end without recursion; repeated rows are rendered one by one; an empty table gives no rows.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from html import unescape
from html.parser import HTMLParser
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import append_columns, field

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template iframe object embed canvas audio video map datalist title meta link annotation annotation-xml".split())
#: Of an svg, only text elements and embedded HTML are drawn, and nothing in these.
FOREIGN = frozenset(("svg", "math"))
DRAWN = frozenset(("text", "foreignobject"))
UNDRAWN = frozenset("defs symbol desc metadata clippath mask pattern marker".split())
#: HTML may stand in these inside svg and math; elsewhere there, a tag of BREAKOUT ends them.
EMBEDS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
IN_SELECT = frozenset("option optgroup hr".split())
FIELDS = frozenset("input textarea select".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset form".split())
BLOCK = SPACED | frozenset("html body address article aside details dialog dd div dt figcaption footer header hgroup hr legend li main menu nav section summary tr caption center optgroup option".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends open elements of the first set, unless one of the second stands between.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
#: Other start tags, and text, end an open head.
IN_HEAD = frozenset("html head base link meta noscript script style template title".split())
SCOPE = frozenset("html table td th caption object template".split())
HIDING = re.compile(r"display\s*:\s*none", re.I)
VEIL = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)", re.I)
#: Fixed values of the HTML standard: the largest spans of a cell.
MOST_COLUMNS, MOST_ROWS = 1000, 65534
SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class TreeBuilder(HTMLParser):
    """The tree of a page; node.children holds nodes and strings."""

    CDATA_CONTENT_ELEMENTS = ("script", "style", "textarea")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", {})
        self.open = [self.root]
        self.count: dict[str, int] = {}

    def pop_to(self, depth: int) -> None:
        for n in self.open[depth:]:
            self.count[n.tag] -= 1
        del self.open[depth:]

    def end_implied(self, ends: set[str], barrier: set[str]) -> None:
        if not any(self.count.get(t) for t in ends):
            return
        last = None
        for i in range(len(self.open) - 1, 0, -1):
            tag = self.open[i].tag
            if tag in barrier:
                break
            if tag in ends:
                last = i
        if last is not None:
            self.pop_to(last)

    def end_head(self) -> None:
        if self.open[-1].tag == "head":
            self.pop_to(len(self.open) - 1)

    def close(self) -> None:
        if self.cdata_elem == "textarea" and self.rawdata:  # not closed: the rest is its text
            rest, self.rawdata = self.rawdata, ""
            self.handle_data(rest)
        super().close()

    def foreign(self) -> int | None:
        """The place of the outermost svg or math around what comes next, none inside embedded HTML."""
        found = None
        if any(self.count.get(t) for t in FOREIGN):
            for i in range(len(self.open) - 1, 0, -1):
                if self.open[i].tag in EMBEDS:
                    break
                if self.open[i].tag in FOREIGN:
                    found = i
        return found

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag not in IN_HEAD:
            self.end_head()
        if tag in BREAKOUT and (at := self.foreign()) is not None:
            self.pop_to(at)
        if self.count.get("select") and (tag in FIELDS or tag in BLOCK and tag not in IN_SELECT):
            self.end_implied({"select"}, SCOPE)
        if tag in ENDS:
            self.end_implied(*ENDS[tag])
        if tag in BLOCK and tag not in ("html", "body") and self.count.get("p"):
            self.end_implied({"p"}, SCOPE)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop_to(len(self.open) - 1)
        node = Node(tag, dict(attrs))
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.count[tag] = self.count.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        closes = tag in FOREIGN or tag not in BREAKOUT and self.foreign() is not None
        self.handle_starttag(tag, attrs)
        if closes and self.open[-1].tag == tag and tag not in VOID:  # elsewhere a slash closes nothing but void elements
            self.pop_to(len(self.open) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.end_head()
            self.open[-1].children.append(Node("br", {}))
        if not self.count.get(tag):
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.pop_to(i)
                return
            if self.open[i].tag in ("td", "th", "table") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "html", "body"):
                return

    def handle_data(self, data: str) -> None:
        if SPACE.sub("", data):
            self.end_head()
        if self.open[-1].tag == "textarea":
            data = unescape(data if self.open[-1].children else data.removeprefix("\n"))
        self.open[-1].children.append(data)


def visible(node: Node) -> bool:
    if node.tag in UNSEEN or "hidden" in node.attrs:
        return False
    return not ((style := node.attrs.get("style")) and HIDING.search(style))


def shown(select: Node) -> list[Node | str]:
    """What a select shows: all of a list box, else the selected or first option."""
    size = select.attrs.get("size") or ""
    if "multiple" in select.attrs or re.fullmatch(r"\d+", size) and int(size) > 1:
        return select.children
    first = last = enabled = None
    walk = [(c, False) for c in reversed(select.children)]
    while walk:
        node, off = walk.pop()
        if isinstance(node, str) or not visible(node):
            continue
        off = off or "disabled" in node.attrs
        if node.tag == "option":
            first, enabled = first or node, enabled or (None if off else node)
            last = node if "selected" in node.attrs else last
        else:
            walk.extend((c, off) for c in reversed(node.children))
    option = last or enabled or first
    return [] if option is None else [option.attrs["label"]] if option.attrs.get("label") else option.children


def veiled(node: Node) -> bool | None:
    """Whether a node's style veils what is in it: such text takes no part, but a node in it may lift the veil; None: no word on it."""
    found = VEIL.findall(node.attrs.get("style") or "")
    return {"hidden": True, "collapse": True, "visible": False}.get(found[-1].lower()) if found else None


def span(node: Node, name: str, least: int, most: int) -> int:
    value = node.attrs.get(name) or ""
    return max(least, min(int(value), most)) if re.fullmatch(r"\d{1,9}", value) else 1


def width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class Page:
    """Lines of one flow of text: the page, or a table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.marker = "", 0, False, ""

    def text(self, data: str, indent: str, pre: bool) -> None:
        if pre:
            first, *rest = data.split("\n")
            self.put(first, indent)
            for x in rest:
                self.end_line(force=True)
                self.put(x, indent)
            return
        parts = SPACE.split(data)
        for i, word in enumerate(parts):
            if i:
                self.space = True
            if word:
                self.put((" " if self.space and self.line.strip() else "") + word, indent)
                self.space = False

    def put(self, data: str, indent: str) -> None:
        if not data:
            return
        if not self.line:
            if self.lines:
                self.lines += [""] * (self.gap - (0 if self.lines[-1] else 1))
            self.line, self.marker = indent + self.marker, ""
        self.gap = 0
        self.line += data

    def end_line(self, force: bool = False) -> None:
        if self.line or force:
            self.lines.append(self.line.rstrip())
            self.line = ""
        self.space = False

    def block(self, blank: bool) -> None:
        self.end_line()
        self.gap = max(self.gap, int(blank))

    def done(self) -> list[str]:
        self.end_line()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def align(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Rows of cells (lines, columns, rows), with each column as wide as its widest line and two spaces between."""
    held: dict[int, int] = {}  # columns that cells of rows above still cover, for so many rows
    placed = []
    for r in rows:
        at, line, new = 0, [], {}
        for lines, columns, deep in r:
            while held.get(at):
                at += 1
            line.append((at, at + columns, lines))
            if deep != 1:
                new.update(dict.fromkeys(range(at, at + columns), deep - 1 if deep else MOST_ROWS))
            at += columns
        held = {c: n - 1 for c, n in held.items() if n > 1} | new
        placed.append(line)
    starts = sorted({a for line in placed for a, _, _ in line})  # columns in which no cell begins take no room
    size = [0] * len(starts)
    cells = [(bisect_left(starts, a), bisect_left(starts, b), max(map(width, lines), default=0)) for line in placed for a, b, lines in line]
    for a, b, n in sorted(cells, key=lambda x: x[1] - x[0]):
        size[b - 1] += max(0, n - sum(size[a:b]) - 2 * (b - a - 1))
    left = [0, *accumulate(n + 2 for n in size)]
    out = []
    for line in placed:
        for k in range(max((len(x[2]) for x in line), default=0)):
            text, end = "", 0
            for a, _, lines in line:
                if k < len(lines):
                    text += " " * (left[bisect_left(starts, a)] - end) + lines[k]
                    end = left[bisect_left(starts, a)] + width(lines[k])
            out.append(text.rstrip())
    return [x for x in out if x]


def render(html: str | None) -> str:
    """The visible text of a page."""
    if not html:
        return ""
    builder = TreeBuilder()
    builder.feed(html.replace("\x00", "�"))
    builder.close()
    pages, tables, lists = [Page()], [], []
    pre, veils, drawn = 0, [False], []  # drawn: for each open svg and text element in it, whether text shows
    walk: list[tuple[Node | str, bool]] = [(builder.root, False)]
    while walk:
        node, leaving = walk.pop()
        page = pages[-1]
        if isinstance(node, str):
            if drawn and not drawn[-1] or veils[-1]:
                continue
            if tables and tables[-1][1] is page and not node.strip():
                continue  # white space between rows and cells
            depth = sum(x[2] is page for x in lists)  # lines after an item's first stand under its text
            page.text(node, "  " * (depth - bool(page.marker) if depth else 0), pre > 0)
            continue
        tag = node.tag
        if not leaving:
            if not visible(node) or drawn and (tag in UNDRAWN or drawn[-1] is False and tag == "img"):
                continue
            if tag == "br":
                page.end_line(force=True)
                continue
            if tag == "img":
                if (alt := node.attrs.get("alt")) and not (veils[-1] if veiled(node) is None else veiled(node)):
                    page.text(alt, "", False)
                continue
            if tag == "hr":
                page.block(True)
                continue
            if tag in VOID:
                continue
            if tag in BLOCK:
                page.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
            if tag in ("ul", "ol", "menu"):
                start = node.attrs.get("start") or ""
                lists.append([tag == "ol", int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, page])
            elif tag == "li" and lists and lists[-1][2] is page:
                page.marker = f"{lists[-1][1]}. " if lists[-1][0] else "- "
                lists[-1][1] += 1
            elif tag == "table":
                tables.append(([], page))
            elif tag == "tr" and tables:
                tables[-1][0].append([])
            elif tag in ("td", "th") and tables:
                if not tables[-1][0]:
                    tables[-1][0].append([])
                pages.append(Page())
            if tag == "svg" or drawn and tag in DRAWN:
                drawn.append(tag != "svg")
            if tag in ("svg", "text", "foreignobject", "textarea", "select"):
                page.space = True
            if tag == "textarea" and page.line.strip():
                page.put(" ", "")
            pre += tag in ("pre", "textarea")
            veil = veiled(node)
            veils.append(veils[-1] if veil is None else veil)
            walk.append((node, True))
            walk.extend((c, False) for c in reversed(shown(node) if tag == "select" else node.children))
            continue
        pre -= tag in ("pre", "textarea")
        veils.pop()
        if tag == "svg" or drawn and tag in DRAWN:
            drawn.pop()
        if tag in ("svg", "text", "foreignobject", "textarea", "select"):
            page.space = True
        if tag in ("ul", "ol", "menu"):
            lists.pop()
            page.marker = ""
        if tag in ("td", "th") and tables:
            pages.pop()
            tables[-1][0][-1].append((page.done(), span(node, "colspan", 1, MOST_COLUMNS), span(node, "rowspan", 0, MOST_ROWS)))
            page = pages[-1]
        elif tag == "table":
            rows, _ = tables.pop()
            page.block(True)
            for line in align(rows):
                page.put(line, "")
                page.end_line()
            page.gap = 1
        elif tag in BLOCK:
            page.block(tag in SPACED and not (tag in ("ul", "ol") and lists))
    return "\n".join(pages[0].done())


def extract_text(df: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """df with the visible text of each page."""

    def make():
        return lambda pages: {text_col: [render(p) for p in pages]}

    return append_columns(df, html_col, make, [field(text_col, T.StringType())], rows=256)
