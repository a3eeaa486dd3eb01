"""Operator 6: HTML extraction by layout.

A tokenizer and a tree builder with implied tags make a tree of each page; visibility rules drop what
a browser would not show (scripts, styles, head, templates, hidden elements, closed dialogs). All
other text is emitted: blocks on lines of their own with blank lines around paragraphs and headings,
lists with marks and indents, preformatted text as it is, and the cells of tables in aligned columns.
Each page is rendered whole by the worker that has it; nothing is shuffled.

Strings and elements that stand between the rows or cells of a table come in front of it; cells keep their columns below
a rowspan. Columns are padded to their longest cell. Where that would make a table's text much longer than its cells
(PADDING times; a page could grow with its square), the widest columns are padded less: their longer cells are whole, but
what is right of them is not aligned.

Hidden are scripts, styles, the head and the like, elements with the attribute hidden or whose style says display: none or
visibility: hidden, closed dialogs, and of a closed details all but its summary. An element's style is its inline style and the
simple rules (one element name, class or id, or an element name with a class) of style elements, by importance, specificity
and order; rules of other media than all and screen, and those under conditions (widths, features), are not applied. What is
visible inside an element of hidden visibility is shown. Buttons and text fields show their value.

Defined cases: null or empty html gives empty text; broken markup never fails: an end tag that
closes nothing is dropped, what is open at the end is closed, a lone < is text; elements may nest to any depth: those below
MAX_DEPTH keep their visibility, their text and their place between blocks, but not their layout as lists or tables; a null id
is kept; repeated rows are rendered each; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import table

MAX_DEPTH = 200
PADDING = 8

# Element names by their role in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noframes".split())
HIDDEN = frozenset("head script style template noscript title iframe object audio video canvas datalist noframes".split())
SHOWS_VALUE = frozenset("text search email url tel number date time submit button reset".split())
#: In svg and math, what is not shown where it stands.
ASIDE = frozenset("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml".split())
BLOCK = frozenset(
    """address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table ul tr
    caption optgroup select""".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre table ul ol dl figure".split())
ENDS_P = (BLOCK - {"body", "html", "tr", "caption", "option", "optgroup", "select", "legend", "dt", "dd", "li"}) | {"hr", "li", "dd", "dt"}
#: A start tag on the left closes open elements on the right, up to the nearest element that bounds them.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
_IN_HEAD = frozenset("base link meta title style script template noscript head html".split())
_PARTS = frozenset("tr td th thead tbody tfoot".split())
_NO_PARENT_PAST = frozenset({"td", "th", "table"})
_TABLE_ENDS = frozenset("table tr tbody thead tfoot td th body html".split())

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>", re.S)
_LOOSE = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_MARK = re.compile(r"[{};]")
_DECLARED = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_MEDIA = re.compile(r"@media\s+(?:[^{}]*,\s*)?(?:only\s+)?(?:all|screen)\s*(?:,[^{}]*)?", re.I)
_COMMENT = re.compile(r"/\*.*?(?:\*/|$)", re.S)
_SIMPLE = re.compile(r"[a-z][a-z0-9]*|(?:[a-z][a-z0-9]*)?\.[\w-]+|#[\w-]+")
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attrs", "children", "parted", "tag")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []
        self.parted = False  # holds rows or cells of the table around it

    def attr(self, name: str) -> str | None:
        if name not in self.attrs.lower():
            return None
        for m in _ATTR.finditer(self.attrs):
            if m[1].lower() == name:
                return html.unescape(next((g for g in m.groups()[1:] if g is not None), ""))
        return None

    def style(self, rules: Styles) -> tuple[str | None, str | None]:
        """The values of display and visibility that rules and the inline style give this element, if any."""
        found = {}
        names = [(self.tag, 1)]
        if self.attrs:
            if rules:
                names += [x for c in (self.attr("class") or "").split() for x in ((f".{c}", 10), (f"{self.tag}.{c}", 11))]
                if (own := self.attr("id")) is not None:
                    names.append((f"#{own}", 100))
            for name, (value, important) in declared(self.attr("style") or "").items():
                found[name] = ((important, 1000, 0), value)
        for selector, specific in names:
            for name, (value, important, order) in rules.get(selector, {}).items():
                rank = (important, specific, order)
                if name not in found or rank > found[name][0]:
                    found[name] = rank, value
        return tuple(found[n][1] if n in found else None for n in ("display", "visibility"))

    def shown(self, rules: Styles = {}) -> bool:
        """Whether any of it is shown; of an element of hidden visibility only the visible parts stay in it."""
        if self.tag in HIDDEN:
            return False
        if self.tag == "dialog" and self.attr("open") is None or self.attrs and self.attr("hidden") is not None:
            return False
        if self.tag == "input" and (self.attr("type") or "").lower() == "hidden":
            return False
        if not self.attrs and not rules:
            return True
        display, visibility = self.style(rules)
        if display == "none":
            return False
        if visibility in ("hidden", "collapse"):
            self.children = [c for c in self.children if isinstance(c, Node) and c.inside_hidden(rules)]
            return bool(self.children)
        return True

    def inside_hidden(self, rules: Styles) -> bool:
        """shown(), where what is around it is hidden."""
        if self.style(rules)[1] == "visible":
            return self.shown(rules)
        if not self.shown(rules):
            return False
        self.children = [c for c in self.children if isinstance(c, Node) and c.inside_hidden(rules)]
        return bool(self.children)


#: By selector what its rules say of display and visibility: value, importance, place in the order of rules.
Styles = dict[str, dict[str, tuple[str, bool, int]]]


_ORDER = count()


def declared(body: str) -> dict[str, tuple[str, bool]]:
    """What declarations say of display and visibility, and whether that is important; the last important one, else the last one."""
    found: dict[str, tuple[str, bool]] = {}
    for m in _DECLARED.finditer(body):
        name, important = m[1].lower(), bool(m[3])
        if important or not found.get(name, ("", False))[1]:
            found[name] = m[2].lower(), important
    return found


def blocks(sheet: str) -> Iterator[tuple[str, str]]:
    """What stands before and inside the braces of each outermost block of a style sheet; what is open at the end is closed."""
    level = start = inner = 0
    for m in _MARK.finditer(sheet):
        if m[0] == "{":
            if not level:
                before, inner = sheet[start:m.start()].strip(), m.end()
            level += 1
        elif m[0] == "}" and level:
            level -= 1
            if not level:
                yield before, sheet[inner:m.start()]
                start = m.end()
        elif not level:
            start = m.end()
    if level:
        yield before, sheet[inner:]


def read_styles(sheet: str, rules: Styles, depth: int = 0) -> None:
    """Add the simple rules of a style sheet that hide or show."""
    for before, body in blocks(_COMMENT.sub(" ", sheet)):
        if before.startswith("@"):
            if depth < 8 and _MEDIA.fullmatch(before):
                read_styles(body, rules, depth + 1)
            continue
        values = declared(body)
        for selector in map(str.strip, before.split(",")) if values else ():
            if _SIMPLE.fullmatch(selector):
                own = rules.setdefault(selector, {})
                for name, (value, important) in values.items():
                    if important or not own.get(name, ("", False, 0))[1]:
                        own[name] = value, important, next(_ORDER)


class Tree:
    """The open elements of a page while it is read.

    Each stands with the node that takes its children: itself, or below MAX_DEPTH the one at that depth,
    or, if it is hidden there, a node that is thrown away.
    """

    def __init__(self):
        self.root = Node("html")
        self.stack: list[tuple[Node, Node]] = [(self.root, self.root)]
        self.at: dict[str, list[int]] = defaultdict(list)  # places of the open elements by name
        self.rules: Styles = {}

    @property
    def top(self) -> Node:
        return self.stack[-1][0]

    def add(self, child: Node | str) -> None:
        self.stack[-1][1].children.append(child)

    def push(self, node: Node) -> None:
        into = self.stack[-1][1]
        into.children.append(node)
        if len(self.stack) >= MAX_DEPTH:
            into = into if node.shown(self.rules) else Node("")
        else:
            into = node
        self.at[node.tag].append(len(self.stack))
        self.stack.append((node, into))

    def cut(self, at: int) -> None:
        """Close the elements from that place on."""
        for node, into in reversed(self.stack[at:]):
            self.at[node.tag].pop()
            if into is not node and into.tag:
                into.children.append(Node(node.tag))  # the end of a block that has no node of its own
        del self.stack[at:]

    def close(self, names: set, bounds: set) -> None:
        """Close open elements of these names, up to the nearest element that bounds them."""
        bound = self.last(bounds)
        first = [x[k] for x in map(self.at.__getitem__, names) if (k := bisect_right(x, bound)) < len(x)]
        if first:
            self.cut(min(first))

    def last(self, names: Iterable[str]) -> int:
        """Place of the innermost open element of these names; 0 if none is open."""
        return max((x[-1] for x in map(self.at.__getitem__, names) if x), default=0)

    def end(self, tag: str) -> None:
        at = self.last([tag])
        if at and (tag in _TABLE_ENDS or self.last(_NO_PARENT_PAST) <= at):
            self.cut(at)

    def text(self, s: str) -> None:
        if s:
            if self.top.tag == "head" and s.strip():
                self.cut(len(self.stack) - 1)
            self.add(html.unescape(s))


def parse(page: str) -> tuple[Node, Styles]:
    """The tree of a page, and the rules of its style elements."""
    tree = Tree()
    at, n = 0, len(page)
    pattern = _TAG
    while at < n:
        lt = page.find("<", at)
        if lt < 0 or page.find(">", lt) < 0 and not page.startswith("<!--", lt):
            tree.text(page[at:])
            break
        tree.text(page[at:lt])
        m = pattern.match(page, lt)
        if not m and page[lt + 1:lt + 3].strip("/")[:1].isalpha():
            pattern = _LOOSE  # a quote stays open to the end: from here on quotes don't count
            m = pattern.match(page, lt)
        if not m:
            tree.text("<")
            at = lt + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            tree.end(tag)
            continue
        if tag == "html":
            continue
        if tree.top.tag == "head" and tag not in _IN_HEAD:
            tree.cut(len(tree.stack) - 1)
        if tag in ENDS_P:
            tree.close({"p"}, {"td", "th", "table", "button", "object", "html"})
        if tag in CLOSES:
            tree.close(*CLOSES[tag])
        if tag == "body" and tree.at["body"]:
            continue
        node = Node(tag, m[3].rstrip("/") if m[3] else "")
        if tag in _PARTS:
            for x, _ in reversed(tree.stack):
                if x.tag == "table" or x.parted:
                    break
                x.parted = True
        if tag in RAW:
            tree.add(node)
            end = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
            inner = page[at:end.start() if end else n]
            if tag == "style":
                read_styles(inner, tree.rules)
            elif tag != "script":
                inner = html.unescape(inner)
            node.children.append(inner)
            at = end.end() if end else n
        elif tag in VOID or m[3].endswith("/") and (tag in ("svg", "math") or tree.at["svg"] or tree.at["math"]):
            tree.add(node)  # only in svg and math a slash ends an element
        else:
            tree.push(node)
    return tree.root, tree.rules


class Page:
    """Lines of a rendered page."""

    def __init__(self, rules: Styles | None = None):
        self.rules = rules or {}
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent = self.mark = ""
        self.blank = False

    def word(self, s: str) -> None:
        """Running text: white space collapses."""
        s = _SPACE.sub(" ", s)
        if s.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.now.append(s)

    def line(self, keep: bool = False) -> None:
        """End the current line."""
        s = "".join(self.now)
        s = s if keep else s.strip(" ")
        self.now = []
        if s or keep:
            if self.blank and self.lines and self.lines[-1]:
                self.lines.append("")
            self.blank = False
            self.lines.append(f"{self.mark or self.indent}{s}" if s else "")
            self.mark = ""

    def space(self) -> None:
        self.line()
        self.blank = True


def _row(out: Page, node: Node) -> list[Node]:
    """Cells of a row, through what is wrongly around them; all else goes to out."""
    cells = []
    for c in node.children:
        if isinstance(c, str):
            out.word(c)
        elif c.shown(out.rules):
            out.word(" ")
            if c.tag in ("td", "th"):
                cells.append(c)
            elif c.parted:
                cells += _row(out, c)
            else:
                _render(out, c)
    return cells


def _rows(out: Page, node: Node) -> list[list[Node] | None]:
    """Rows of a table, through its sections and what is wrongly around them, None between sections; all else, as captions and strings, goes to out."""
    rows: list[list[Node] | None] = []
    loose = False
    for c in node.children:
        if isinstance(c, str):
            out.word(c)
            continue
        if not c.shown(out.rules):
            continue
        out.word(" ")
        if c.tag in ("td", "th"):
            if not loose:
                rows.append([])
            rows[-1].append(c)
            loose = True
            continue
        if c.tag == "tr":
            rows.append(_row(out, c))
        elif c.tag in ("thead", "tbody", "tfoot"):
            rows += [None, *_rows(out, c), None]
        elif c.tag == "colgroup" or c.parted:
            rows += _rows(out, c)
        else:
            _render(out, c)
            continue
        loose = False
    return rows


def _span(cell: Node, name: str, most: int) -> int:
    span = cell.attr(name) or "1"
    return min(int(span), most) if span.isdecimal() and len(span) < 6 else 1


def _widths(rows: list[list[str]]) -> list[int]:
    """Of each column, for cells padded to it: its longest cell, less where padding would outgrow the cells."""
    longest = [max(len(row[k]) for row in rows if k < len(row)) for k in range(max(map(len, rows), default=0))]
    most = max(longest, default=0)
    room = PADDING * sum(len(c) for row in rows for c in row) + 4096
    while most > 1 and sum(min(longest[k], most) for row in rows for k in range(len(row) - 1)) > room:
        most //= 2
    return [min(n, most) for n in longest]


def _table(out: Page, node: Node) -> None:
    found = _rows(out, node)
    out.line()
    rows = []
    taken: dict[int, int] = {}  # columns that cells of rows above reach into, and for how many rows
    for cells in found:
        if cells is None:
            taken = {}
            continue
        row, below = [], {}
        for c in cells:
            while len(row) in taken:
                row.append("")
            inner = Page(out.rules)
            _children(inner, c)
            inner.line()
            at = len(row)
            row.append(" ".join(x.strip() for x in inner.lines if x.strip()))
            row += [""] * (_span(c, "colspan", 1000) - 1)
            if down := (_span(c, "rowspan", 65534) or 65534) - 1:
                below |= dict.fromkeys(range(at, len(row)), down)
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | below
        rows.append(row)
    widths = _widths(rows)
    for row in rows:
        if any(row):
            out.now = ["  ".join(cell.ljust(w) for cell, w in zip(row, widths, strict=False)).rstrip()]
            out.line(keep=True)


def _children(out: Page, node: Node, pre: bool = False) -> None:
    for c in node.children:
        if isinstance(c, str):
            if pre:
                first, *rest = c.replace("\r\n", "\n").split("\n")
                out.now.append(first)
                for x in rest:
                    out.line(keep=True)
                    out.now.append(x)
            else:
                out.word(c)
        elif c.shown(out.rules):
            _render(out, c, pre)


def _drawing(out: Page, node: Node) -> None:
    """Text of svg and math."""
    for c in node.children:
        if isinstance(c, str):
            out.word(c)
        elif c.tag not in ASIDE and c.shown(out.rules):
            if c.tag in BLOCK:
                _render(out, c)
                continue
            out.word("" if c.tag in ("tspan", "a") else " ")
            _children(out, c) if c.tag == "foreignobject" else _drawing(out, c)


def _render(out: Page, node: Node, pre: bool = False) -> None:
    tag = node.tag
    if tag in ("svg", "math"):
        out.word(" ")
        _drawing(out, node)
        out.word(" ")
        return
    if tag == "br":
        out.line(keep=bool(out.now) or not out.lines or out.lines[-1] != "")
        return
    if tag == "img":
        return
    if tag in ("td", "th", "input", "button", "wbr"):
        out.word(" ")
    if tag == "input" and (node.attr("type") or "text").lower() in SHOWS_VALUE:
        out.word(f"{node.attr('value') or ''} ")
        return
    if tag == "details" and node.attr("open") is None:
        summary = [c for c in node.children if isinstance(c, Node) and c.tag == "summary"][:1]
        node = Node(tag)
        node.children = summary
    nested = tag in ("ul", "ol") and out.indent
    if tag in BLOCK:
        out.space() if tag in SPACED and not nested else out.line()
    if tag == "hr":
        out.blank = True
        return
    if tag == "table":
        _table(out, node)
    elif tag in ("ul", "ol", "menu", "dir"):
        before, k = out.indent, 0
        for c in node.children:
            if isinstance(c, str):
                out.word(c)
                continue
            if not c.shown(out.rules):
                continue
            if c.tag == "li":
                k += 1
                out.line()
                mark = f"{k}. " if tag == "ol" else "- "
                out.mark, out.indent = before + mark, before + " " * len(mark)
                _children(out, c)
                out.line()
                out.mark, out.indent = "", before
            else:
                _render(out, c)
    else:
        indent = out.indent
        if tag in ("blockquote", "dd"):
            out.indent += "  "
        _children(out, node, pre or tag == "pre")
        if tag == "pre" and "".join(out.now).strip():
            out.line(keep=True)
        if tag in BLOCK:
            out.line()
        out.indent = indent
    if tag in BLOCK:
        out.space() if tag in SPACED and not nested else out.line()


def visible_text(page: str) -> str:
    root, rules = parse(page)
    out = Page(rules)
    _children(out, root)
    out.line()
    return "\n".join(out.lines).strip("\n")


def extract(pages: DataFrame, key: str = "page_id", column: str = "html") -> DataFrame:
    """The key and the visible text of each row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([visible_text(t.as_py()) for t in b.column("html")], pa.string())], ["key", "text"])

    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).withColumns({"n_chars": F.length("text"), "n_lines": F.size(F.split("text", "\n"))})
