"""Visible text of HTML pages, laid out as a browser would without style: blocks, lists and aligned tables."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazemeter.llm.common import mapped

# Fixed values of HTML: elements without content, without visible text, and what they end or begin.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head script style template noscript title datalist audio video canvas iframe".split())
#: What an open head may hold; anything else ends it.
HEADED = frozenset("html head base basefont bgsound link meta noframes noscript script style template title".split())
#: Not shown within drawings and formulas; and where HTML begins again within them.
UNDRAWN = {"svg": frozenset("desc metadata defs symbol clippath mask marker pattern".split()), "math": frozenset(["annotation", "annotation-xml"])}
HTML_AGAIN = ("foreignobject", "annotation-xml", "desc", "title", "mi", "mo", "mn", "ms", "mtext")
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr".split())
BLOCK = SPACED | frozenset(
    "html body address article aside center details dd dialog div dt fieldset figcaption footer form header hgroup legend li main menu nav "
    "option optgroup search section summary tr td th thead tbody tfoot caption".split()
)
#: A start tag ends these open elements, up to the nearest of the second set.
ENDS = {
    **dict.fromkeys(BLOCK - frozenset("html body tr td th thead tbody tfoot caption option optgroup li dt dd summary legend".split()), ({"p"}, {"button", "td", "th", "li", "caption"})),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "caption", "p", "thead", "tbody", "tfoot"}, {"table"}),
    "tbody": ({"tr", "td", "th", "caption", "p", "thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "caption", "p", "thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "body": ({"head"}, {"html"}),
}
HIDING = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(visible|initial|hidden|collapse)", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")
#: Lines of a cell that others may stand beside are broken at so many characters, which bounds the padding of the rows below.
WRAP = 80
#: Browsers' own limit of nesting, here for boxes: what is nested deeper lies in the last of them.
NESTED = 512


class Node:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


#: A comment, a declaration, or a tag; in a tag, ">" within quotes does not end it. Nothing is tried twice over.
MARKUP = re.compile(r"""<!--.*?(?:-->|--!>|\Z)|<[!?][^>]*+>|</[^a-zA-Z][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""", re.S)
PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
ATTRIBUTE = re.compile(r"""([^\s=>"'/]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?+""")
#: Their content is no markup.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes")}


def tokens(html: str) -> Iterator[tuple[str, str, dict[str, str]]]:
    """Text, start tags and end tags of a page in order: ``(kind, text or name, attributes)``, the kind being "" for text, "<" or "/"."""
    at, last, foreign = 0, html.rfind(">"), 0
    while at < len(html):
        less = html.find("<", at)
        if less < 0 or less > last and not html.startswith("<!--", less):
            yield "", unescape(html[at:]), {}
            return
        if less > at:
            yield "", unescape(html[at:less]), {}
        found = MARKUP.match(html, less) or PLAIN_TAG.match(html, less)
        if not found:
            yield "", "<", {}
            at = less + 1
            continue
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            foreign -= tag in UNDRAWN and foreign > 0
            yield "/", tag, {}
            continue
        attributes: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(found[3]):
            attributes.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
        closed = found[3].endswith("/") and (foreign > 0 or tag in UNDRAWN)
        foreign += tag in UNDRAWN and not closed
        yield "<", tag, attributes
        if closed:
            yield "/", tag, {}
        elif tag in RAW:
            end = RAW[tag].search(html, at)
            stop = end.start() if end else len(html)
            yield "", unescape(html[at:stop]), {}
            at = stop


class Tree:
    """Builds the element tree; ``root`` has it. Tags that HTML implies are put in.

    ``path`` holds the open elements and ``open`` their places on it by tag, so no tag costs a walk up a deep tree.
    """

    def __init__(self, html: str) -> None:
        self.root = Node("#root", {}, None)
        self.path, self.open = [self.root], defaultdict(list)
        take = {"": self._text, "<": self._start, "/": self._end}
        for kind, what, attributes in tokens(html):
            take[kind](what, attributes)

    def _shut(self, place: int) -> None:
        """Closes the element at ``place`` and all within it."""
        while len(self.path) > place:
            self.open[self.path.pop().tag].pop()

    def _within(self, wanted: set, stop: set) -> int | None:
        """Place of the outermost open element of ``wanted`` inside the nearest of ``stop``."""
        low = max((self.open[t][-1] for t in stop if self.open[t]), default=0)
        return min((d[bisect_right(d, low)] for t in wanted if (d := self.open[t]) and d[-1] > low), default=None)

    def _start(self, tag: str, attributes: dict[str, str]) -> None:
        if tag in ENDS and (place := self._within(*ENDS[tag])):
            self._shut(place)
        if self.path[-1].tag == "head" and tag not in HEADED:
            self._shut(self.open["head"][0])
        for t in UNDRAWN:
            if tag in BLOCK and (drawn := self.open[t]) and not any(d and d[-1] > drawn[-1] for d in map(self.open.__getitem__, HTML_AGAIN)):
                self._shut(drawn[-1])
        if tag in ("td", "th") and self.path[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._start("tr", {})
        node = Node(tag, attributes, self.path[-1])
        self.path[-1].children.append(node)
        if tag not in VOID:
            self.open[tag].append(len(self.path))
            self.path.append(node)

    def _end(self, tag: str, _: dict[str, str]) -> None:
        """Closes the innermost open ``tag``; the end tags of a cell's content do not reach out of their table."""
        if places := self.open[tag]:
            tables = self.open["table"]
            if not (tables and tables[-1] > places[-1] and tag in ("td", "th", "tr", "li", "p", "div")):
                self._shut(places[-1])

    def _text(self, data: str, _: dict[str, str]) -> None:
        if self.path[-1].tag == "head" and not data.isspace():
            self._shut(self.open["head"][0])
        self.path[-1].children.append(data)


class Flow:
    """Lines of one box. Spaces collapse within a line, blank lines between blocks."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.space = self.blank = False

    def text(self, data: str, kept: bool) -> None:
        if kept:
            first, *rest = data.expandtabs().replace("\r\n", "\n").split("\n")
            self._put(first)
            for line in rest:
                self.line()
                self._put(line)
            return
        parts = SPACE.split(data)
        if not parts[0] and len(parts) > 1:
            self.space = True
        body = " ".join(p for p in parts if p)
        if body:
            self._put(" " * bool(self.space and self.now) + body)
            self.space = not parts[-1]

    def _put(self, data: str) -> None:
        if data and self.blank and not self.now:
            self.lines += [""] * bool(self.lines)
        if data:
            self.now.append(data)
            self.blank = False

    def line(self) -> None:
        """Ends the line, with or without text in it."""
        self.lines.append("".join(self.now).rstrip())
        self.now, self.space = [], False

    def end(self, blank: bool = False) -> None:
        """A block's edge."""
        if self.now:
            self.line()
        self.space, self.blank = False, self.blank or blank

    def box(self, lines: list[str]) -> None:
        for line in lines:
            self._put(line)
            self.line()

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _seen(node: Node, before: bool) -> bool:
    """Whether text right in ``node`` is to be seen: visibility is inherited, and can be set anew."""
    said = VISIBILITY.findall(node.attrs.get("style") or "")
    return said[-1].lower() in ("visible", "initial") if said else before


def _shown(node: Node, within: dict[str, int]) -> bool:
    a = node.attrs
    return not (
        node.tag in UNSEEN or any(n and node.tag in UNDRAWN[t] for t, n in within.items()) or "hidden" in a or HIDING.search(a.get("style") or "")
        or node.tag == "input" and (a.get("type") or "").lower() in ("hidden", "checkbox", "radio", "image", "file")
    )


def _wrapped(line: str) -> list[str]:
    """The line broken at spaces, or within longer words, into pieces of WRAP characters at most."""
    out = []
    while len(line) > WRAP:
        indent = len(line) - len(line.lstrip(" "))
        at = line.rfind(" ", indent + 1, WRAP + 1)
        at = at if at > 0 else WRAP
        out.append(line[:at].rstrip())
        line = line[at:].lstrip(" ")
    return [*out, line]


def _grid(rows: list[list[tuple[list[str], int, int]]]) -> list[list[list[str]]]:
    """The lines of each cell by row and column; places under a cell that spans rows stay empty."""
    grid, held = [], {}
    for row in rows:
        line: list[list[str]] = []
        new = {}
        for lines, across, down in row:
            while len(line) in held:
                line.append([])
            if down > 1:
                new |= dict.fromkeys(range(len(line), len(line) + across), down - 1)
            line += [lines, *[[]] * (across - 1)]
        grid.append(line)
        held = {c: n - 1 for c, n in held.items() if n > 1} | new
    return grid


def _table(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Lines of a table: columns as wide as their widest cell, two spaces between them."""
    grid = _grid(rows)
    grid = [[[y for x in cell for y in _wrapped(x)] if i + 1 < len(row) else cell for i, cell in enumerate(row)] for row in grid]
    widths: list[int] = []
    for row in grid:
        widths += [0] * (len(row) - len(widths))
        for i, cell in enumerate(row[:-1]):
            widths[i] = max([widths[i], *map(len, cell)])
    last = [len(row) - 1 for row in grid]
    for row, i in zip(grid, last, strict=True):
        # A row's last cell is not padded; it widens its column for rows that go on, as far as lines are broken.
        if row:
            widths[i] = max([widths[i], *(len(x) for x in row[i] if len(x) <= WRAP)])
    out = []
    for row in grid:
        for k in range(max([0, *map(len, row)])):
            out.append("  ".join((cell[k] if k < len(cell) else "").ljust(widths[i] if i + 1 < len(row) else 0) for i, cell in enumerate(row)).rstrip())
    return out


def _span(node: Node, name: str, most: int) -> int:
    """A cell's colspan or rowspan; rowspan 0 goes to the table's end."""
    said = node.attrs.get(name) or ""
    n = int(said) if said.isascii() and said.isdigit() and len(said) < 9 else 1
    return min(n or (most if name == "rowspan" else 1), most)


def visible_text(html: str | None) -> str:
    """All text a reader sees, or an empty string for null."""
    flow, kept = Flow(), 0
    boxes: list[tuple[Flow, str]] = []  # open list items, quotes and cells: the flow around each, and its mark
    tables: list[list[list[tuple[list[str], int, int]]]] = []
    work: list[tuple[Node | str, bool, bool]] = [(Tree(html or "").root, False, True)]
    within = dict.fromkeys(UNDRAWN, 0)
    boxed: set[int] = set()
    numbers: dict[int, int] = {}
    while work:
        node, leaving, seen = work.pop()
        if isinstance(node, str):
            if seen and not (node.isspace() and not kept and tables and not _in_cell(boxes, tables)):
                flow.text(node, kept > 0)
            continue
        tag = node.tag
        if not leaving:
            if not _shown(node, within):
                continue
            seen = _seen(node, seen)
            if tag in within:
                within[tag] += 1
            if tag in BLOCK or tag == "text" and within["svg"]:
                flow.end(tag in SPACED)
            if tag == "br":
                flow.line()
            elif tag in ("hr", "input", "img") and not seen:
                pass
            elif tag == "hr":
                flow.text("---", False)
                flow.end(True)
            elif tag == "input":
                flow.text(f" {node.attrs.get('value') or node.attrs.get('placeholder') or ''} ", False)
            elif tag == "img":
                flow.text(f" {node.attrs.get('alt') or ''} ", False)
            elif tag == "pre" or tag == "textarea":
                kept += 1
            elif tag == "table" and len(boxes) < NESTED:
                tables.append([])
                boxed.add(id(node))
            elif tag == "tr" and tables:
                tables[-1].append([])
            elif tag in ("td", "th") and tables and tables[-1] and len(boxes) < NESTED or tag in ("li", "blockquote", "dd") and len(boxes) < NESTED:
                boxes.append((flow, tag))
                boxed.add(id(node))
                flow = Flow()
            if tag not in VOID:
                work.append((node, True, seen))
                shut = tag == "details" and "open" not in node.attrs
                work += [(c, False, seen) for c in reversed(node.children) if not shut or isinstance(c, Node) and c.tag == "summary"]
            continue
        if tag in within:
            within[tag] -= 1
        if tag == "pre" or tag == "textarea":
            kept -= 1
        if id(node) in boxed and tag != "table":
            lines, (flow, _) = flow.done(), boxes.pop()
            if tag in ("td", "th"):
                tables[-1][-1].append((lines, _span(node, "colspan", 1000), _span(node, "rowspan", 65534)))
            else:
                mark = _mark(node, numbers)
                mark = mark if seen else " " * len(mark)
                flow.box([(mark if i == 0 else " " * len(mark)) + x if x else x for i, x in enumerate(lines)] or [mark.rstrip()] * (tag == "li" and seen))
        elif id(node) in boxed:
            flow.box(_table(tables.pop()))
        if tag in BLOCK or tag == "text" and within["svg"]:
            flow.end(tag in SPACED)
    return "\n".join(flow.done())


def _in_cell(boxes: list, tables: list) -> bool:
    """Whether text now would stand in a cell (or in a box within one) of the innermost table."""
    return sum(tag in ("td", "th") for _, tag in boxes) >= len(tables)


def _mark(node: Node, numbers: dict[int, int]) -> str:
    """What stands before a list item, a quote or a definition."""
    if node.tag != "li":
        return "> " if node.tag == "blockquote" else "    "
    up = node.parent
    if up is None or up.tag != "ol":
        return "- "
    numbers[id(up)] = numbers.get(id(up), 0) + 1
    return f"{numbers[id(up)]}. "


def rendered(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``(id, text)`` for every row of ``pages``.

    A tree is built with the tags HTML implies (a paragraph ends where a block begins, items, cells and rows end each other, a
    cell outside a row begins one). Text is visible unless it, or what it stands in, is no content, hidden or not
    displayed. Blocks start lines, paragraphs, lists and tables stand between blank lines, items have marks and are
    indented, cells are aligned by column; white space collapses but in preformatted text. Null and empty pages give empty
    texts; broken markup is taken as browsers take it in these rules, and never fails. Repeated rows and ids are kept.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    return mapped(
        pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")),
        lambda b: {"id": b.column(0), "text": pa.array([visible_text(h) for h in b.column(1).to_pylist()], pa.string())},
        f"id {kind}, text string",
    )
