"""Reading HTML pages into typed elements: headings, paragraphs, list items, quotes and tables with their cells.

A tolerant parser makes a small tree of each page, in Arrow batches; what a page opens and doesn't close ends where its
parent does, or where the next of its kind begins. A page that is a browser's view of a source is unwrapped first. Site
furniture is left out, the main part is chosen, and its elements come in reading order, repeated texts once.

Defined cases: null and empty pages have no elements; a page of bare text has none either; markup of any depth is walked
without recursion; repeated rows are read each; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwell.plans.views import view

# Site furniture, elements without an end tag, and what a start tag ends up to which bound.
FURNITURE = frozenset("script style noscript svg header footer nav aside form template".split())
_EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = frozenset("address article blockquote div dl fieldset figure h1 h2 h3 h4 h5 h6 hr main ol p pre section table ul header footer nav aside form".split())
_ENDS = {
    "li": ({"li"}, {"ul", "ol"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    **dict.fromkeys(("thead", "tbody", "tfoot"), ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"})),
}
#: Where the main part of a page may be; the first that holds more than MAIN_LEAST characters is taken, else the body.
MAIN = ("main", "article", "#content", ".content", "div.main")
MAIN_LEAST = 40
#: Cells of this class are the lines of a page that a browser shows as source; more than so many make such a page.
SOURCE_CLASS, SOURCE_LINES = "line-content", 10


class Element:
    __slots__ = ("attrs", "children", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self, skip: frozenset[str] = frozenset()) -> Iterator[Element]:
        """All elements inside it in reading order, without those of some names and what these hold."""
        todo = [c for c in reversed(self.children) if isinstance(c, Element)]
        while todo:
            e = todo.pop()
            if e.tag not in skip:
                yield e
                todo.extend(c for c in reversed(e.children) if isinstance(c, Element))

    def text(self, skip: frozenset[str] = frozenset()) -> str:
        parts, todo = [], list(reversed(self.children))
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                parts.append(c)
            elif c.tag not in skip:
                if c.tag == "br" or c.tag in _BLOCKS or c.tag in ("li", "td", "th", "tr"):
                    parts.append(" ")
                    todo.append(" ")
                todo.extend(reversed(c.children))
        return " ".join("".join(parts).split())

    def inside(self, names: frozenset[str], top: Element) -> bool:
        e = self.parent
        while e is not None and e is not top:
            if e.tag in names:
                return True
            e = e.parent
        return False

    def matches(self, selector: str) -> bool:
        """selector: a name, .class, #id, or a name with a class."""
        if selector.startswith("#"):
            return self.attrs.get("id") == selector[1:]
        name, _, kind = selector.partition(".")
        return name in ("", self.tag) and (not kind or kind in self.attrs.get("class", "").split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Element("", {}, None)

    def _end(self, names: set[str], bounds: set[str]) -> None:
        """Close the outermost open element of these names below the nearest bound."""
        e, last = self.now, None
        while e.parent is not None and e.tag not in bounds:
            last = e if e.tag in names else last
            e = e.parent
        if last is not None:
            self.now = last.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _BLOCKS:
            self._end({"p"}, {"td", "th", "li", "table", "body"})
        if tag in _ENDS:
            self._end(*_ENDS[tag])
        e = Element(tag, {k: v or "" for k, v in attrs}, self.now)
        self.now.children.append(e)
        if tag not in _EMPTY:
            self.now = e

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _EMPTY:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        e = self.now
        while e.parent is not None and e.tag != tag:
            if e.tag == "table" and tag not in ("body", "html"):
                return  # nothing inside a table ends what is around it
            e = e.parent
        if e.parent is not None:
            self.now = e.parent

    def handle_data(self, data: str) -> None:
        self.now.children.append(data)


def parse(page: str) -> Element:
    b = _Builder()
    b.feed(page)
    b.close()
    return b.root


def _span(e: Element, name: str) -> int:
    n = e.attrs.get(name, "").strip()
    return max(1, min(int(n), 1000)) if n.isdecimal() and len(n) < 6 else 1


def table_cells(table: Element) -> list[dict]:
    """Cells of a table on its grid: row, col, text, row_span, col_span, header. Tables inside cells are text of these cells."""
    rows = [e for e in table.walk() if e.tag == "tr" and _owner(e) is table]
    taken: set[tuple[int, int]] = set()
    out = []
    for r, row in enumerate(rows):
        c = 0
        for cell in (x for x in row.walk() if x.tag in ("td", "th") and _owner(x) is table):
            while (r, c) in taken:
                c += 1
            down, right = min(_span(cell, "rowspan"), len(rows) - r), _span(cell, "colspan")
            taken |= {(r + i, c + j) for i in range(down) for j in range(right)}
            out.append({"row": r, "col": c, "text": cell.text(FURNITURE), "row_span": down, "col_span": right, "header": cell.tag == "th"})
            c += right
    return out


def _owner(e: Element) -> Element | None:
    """The table that an element belongs to."""
    e = e.parent
    while e is not None and e.tag != "table":
        e = e.parent
    return e


def elements_of(page: str, main: tuple[str, ...] = MAIN) -> list[dict]:
    """kind, level, text and cells of the elements of a page, in reading order."""
    root = parse(page)
    lines = [e for e in root.walk() if e.tag == "td" and SOURCE_CLASS in e.attrs.get("class", "").split()]
    if len(lines) > SOURCE_LINES:
        root = parse("\n".join("".join(c if isinstance(c, str) else c.text() for c in e.children) for e in lines))
    chosen = None
    for selector in main:
        chosen = next((e for e in root.walk(FURNITURE) if e.matches(selector)), None)
        if chosen is not None and len(chosen.text(FURNITURE)) > MAIN_LEAST:
            break
        chosen = None
    top = chosen or next((e for e in root.walk() if e.tag == "body"), root)
    out, seen = [], set()

    def add(kind: str, text: str, level: int | None = None, cells: list[dict] | None = None) -> None:
        if cells is not None or text and text not in seen:
            seen.add(text)
            out.append({"kind": kind, "level": level, "text": text, "cells": cells})

    tables, lists = frozenset({"table"}), frozenset({"ul", "ol"})
    for e in top.walk(FURNITURE):
        if e.tag == "table":
            if not e.inside(tables, top) and (cells := table_cells(e)):
                rows: dict[int, list[str]] = {}
                for c in cells:
                    rows.setdefault(c["row"], []).append(c["text"])
                add("table", "\n".join(" | ".join(r) for r in rows.values()), cells=cells)
        elif e.inside(tables, top):
            continue
        elif len(e.tag) == 2 and e.tag[0] == "h" and e.tag[1] in "123456":
            add("heading", e.text(FURNITURE), int(e.tag[1]))
        elif e.tag == "p" and not e.inside(lists, top):
            add("paragraph", e.text(FURNITURE))
        elif e.tag == "li" and not any(x.tag in lists for x in e.walk()):
            add("list_item", e.text(FURNITURE))
        elif e.tag in ("blockquote", "pre"):
            add("quote", e.text(FURNITURE))
    return out


_CELL = pa.struct([("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("header", pa.bool_())])


def read_pages(pages: DataFrame, key: str = "page_id", column: str = "html", main: tuple[str, ...] = MAIN) -> DataFrame:
    """key, pos (from 0), kind (heading, paragraph, list_item, quote or table), level (of headings), text, and cells (of tables, on their grid)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, page in zip(b.column("key"), b.column("html"), strict=True):
                found = elements_of(page.as_py() or "", main)
                if found:
                    columns = [pa.array([e[c] for e in found], t) for c, t in (("kind", pa.string()), ("level", pa.int32()), ("text", pa.string()), ("cells", pa.list_(_CELL)))]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()] * len(found), b.schema.field("key").type), pa.array(range(len(found)), pa.int32()), *columns], ["key", "pos", "kind", "level", "text", "cells"])

    kind = dict(pages.dtypes)[key]
    rows = pages.select(F.col(key).alias("key"), F.col(column).cast("string").alias("html"))
    cell = "row: int, col: int, text: string, row_span: int, col_span: int, header: boolean"
    return rows.mapInArrow(read, f"key {kind}, pos int, kind string, level int, text string, cells array<struct<{cell}>>").withColumnRenamed("key", key)


def src15_html_reader(spark, sf_dir):
    """Elements of all pages; the lists of every third page are tables of one column."""
    p = view(spark, sf_dir, "pages")
    as_table = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<(/?)ul>", "<$1table>"), "<li>", "<tr><td>"), "</li>", "</td></tr>")
    found = read_pages(p.select("page_id", F.when(F.col("page_id") % 3 == 0, as_table).otherwise(F.col("html")).alias("html")))
    return found.select("page_id", "pos", "kind", "level", F.sha1("text").alias("sha"), F.length("text").alias("n"), F.coalesce(F.size("cells"), F.lit(-1)).alias("cells"))


QUERIES = {"src15_html_reader": src15_html_reader}

SQL: dict[str, str] = {}
