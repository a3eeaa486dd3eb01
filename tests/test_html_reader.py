"""The HTML reader on pages made from known elements."""

import random

import pytest

from sparkwell.sources import html_reader


def cell(row, col, text, row_span=1, col_span=1, header=False):
    return dict(row=row, col=col, text=text, row_span=row_span, col_span=col_span, header=header)


@pytest.mark.parametrize("page,want", [
    ("<h2>A &amp; b</h2><p>one<br>two<p>three", [("heading", "A & b"), ("paragraph", "one two"), ("paragraph", "three")]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", [("list_item", "a"), ("list_item", "c"), ("list_item", "d")]),
    ("<nav><p>menu</nav><article><p>short</article><p>body text</p>", [("paragraph", "short"), ("paragraph", "body text")]),
    ("<p>before</p><article><p>" + "long " * 10 + "</article><p>after", [("paragraph", ("long " * 10).strip())]),
    ("<p>same<p>same<blockquote>q</blockquote><pre>x\n y</pre>", [("paragraph", "same"), ("quote", "q"), ("quote", "x y")]),
    ("<p>a</div></table>b<p>c", [("paragraph", "ab"), ("paragraph", "c")]),
    ("just text", []), ("", []), ("<p", []), ("<li><p>inner</li>", [("list_item", "inner"), ("paragraph", "inner")][:1]),
])
def test_elements(page, want):
    assert [(e["kind"], e["text"]) for e in html_reader.elements_of(page)] == want


def test_tables_with_spans_and_tables_inside():
    page = """<table><thead><tr><th rowspan=2>k<th colspan=2>w<tr><th>x<th>y</thead>
      <tr><td>1<td><table><tr><td>in<td>ner</table><td>3</table><table><tr><td>1</table>"""
    first, second = html_reader.elements_of(page)
    assert first["cells"] == [cell(0, 0, "k", 2, 1, True), cell(0, 1, "w", 1, 2, True), cell(1, 1, "x", header=True), cell(1, 2, "y", header=True), cell(2, 0, "1"), cell(2, 1, "in ner"), cell(2, 2, "3")]
    assert first["text"] == "k | w\nx | y\n1 | in ner | 3" and second["cells"] == [cell(0, 0, "1")]


def test_source_views_are_unwrapped():
    lines = ["<html>", "<body>", "<h1>Title &amp; more</h1>", *[f"<p>line {k}</p>" for k in range(9)]]
    escape = lambda s: s.replace("&", "&amp;").replace("<", "&lt;")
    page = "<table>" + "".join(f"<tr><td class=line-number>{k}</td><td class='line-content'>{escape(x)}</td></tr>" for k, x in enumerate(lines)) + "</table>"
    got = html_reader.elements_of(page)
    assert [e["text"] for e in got] == ["Title & more", *[f"line {k}" for k in range(9)]] and got[0]["level"] == 1


def test_random_trees(spark):
    """Pages written from trees give the elements of the trees."""
    r = random.Random(4)
    number = iter(range(10**6))

    def block(depth):
        kind = r.choice(["h", "p", "ul", "table", "div", "quote"] if depth < 4 else ["h", "p"])
        text = f"t{next(number)} word"
        if kind == "h":
            n = r.randrange(1, 7)
            return f"<h{n} class=x>{text}</h{n}>", [("heading", n, text, None)]
        if kind == "p":
            return f"<p>{text}" + r.choice(["", "</p>"]), [("paragraph", None, text, None)]
        if kind == "quote":
            return f"<blockquote>{text}</blockquote>", [("quote", None, text, None)]
        if kind == "ul":
            items = [f"i{next(number)}" for _ in range(r.randrange(1, 4))]
            return "<ul>" + "".join(f"<li>{i}" + r.choice(["", "</li>"]) for i in items) + "</ul>", [("list_item", None, i, None) for i in items]
        if kind == "div":
            inner = [block(depth + 1) for _ in range(r.randrange(0, 4))]
            return "<div>" + "".join(x for x, _ in inner) + "</div>", [e for _, es in inner for e in es]
        grid = [[f"c{next(number)}" for _ in range(r.randrange(1, 4))] for _ in range(r.randrange(1, 4))]
        rows = "".join("<tr>" + "".join(f"<td>{c}" + r.choice(["", "</td>"]) for c in row) + r.choice(["", "</tr>"]) for row in grid)
        return f"<table>{r.choice(['', '<tbody>'])}{rows}</table>", [("table", None, "\n".join(" | ".join(row) for row in grid), [(i, j, c) for i, row in enumerate(grid) for j, c in enumerate(row)])]

    pages, want = [], {}
    for k in range(60):
        parts = [block(0) for _ in range(r.randrange(0, 8))]
        pages.append((k, "<html><head><title>no</title><style>p{}</style></head><body>" + "".join(x for x, _ in parts) + r.choice(["", "</body></html>"])))
        want[k] = [e for _, es in parts for e in es]
    pages += [(None, "<p>x"), (900, None), (901, "<div>" * 5000 + "<p>deep" + "</div>" * 5000)]
    got: dict = {}
    for x in html_reader.read_pages(spark.createDataFrame(pages, "page_id long, html string")).orderBy("page_id", "pos").collect():
        got.setdefault(x.page_id, []).append((x["kind"], x.level, x.text, None if x.cells is None else [(c.row, c.col, c.text) for c in x.cells]))
    assert got == {k: v for k, v in want.items() if v} | {None: [("paragraph", None, "x", None)], 901: [("paragraph", None, "deep", None)]}
