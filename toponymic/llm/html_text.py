"""Visible text of web pages, laid out as a browser would lay it out in plain text.

A tokeniser cuts the page into tags and text, a tree builder supplies implied tags
(an open paragraph ends at the next block, a list item at the next item, a cell at the
next cell, rows and table bodies open where they are missing) and a renderer walks the
tree: invisible elements are skipped, blocks stand on lines of their own with a blank
line around paragraphs, headings, lists and tables, list items carry their mark and
indentation, preformatted text keeps its spacing, and table cells are padded to common
column positions. Both walks use a stack, so nesting depth has no limit.

Defined cases: a null page has the empty text; text outside any element is shown; an
unclosed tag at the end is dropped, an unknown one is inline; a ``<`` that starts no tag
is text. Cells wider than ``ALIGNED`` characters keep their whole text but don't widen
their column, so one long cell doesn't pad every row.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from toponymic.llm import texts

ALIGNED = 40

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset("title textarea".split())
HIDDEN = frozenset("head script style template noscript iframe noembed noframes object audio video canvas svg math "
                   "datalist select title meta link map".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
                  "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option "
                  "p pre search section summary ul table caption thead tbody tfoot tr xmp".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure dir menu".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
_ENDS_P = BLOCK - {"body", "html", "caption", "thead", "tbody", "tfoot", "tr", "legend", "option", "optgroup"}
#: Start tag -> open elements that it ends, and the elements beyond which none is looked for.
_CLOSES = {
    "li": (("li",), LISTS), "dt": (("dt", "dd"), {"dl"}), "dd": (("dt", "dd"), {"dl"}),
    "tr": (("tr", "td", "th", "caption"), {"table"}), "td": (("td", "th", "caption"), {"table", "tr"}),
    "th": (("td", "th", "caption"), {"table", "tr"}), "thead": (("thead", "tbody", "tfoot", "caption"), {"table"}),
    "tbody": (("thead", "tbody", "tfoot", "caption"), {"table"}), "tfoot": (("thead", "tbody", "tfoot", "caption"), {"table"}),
    "option": (("option",), {"select", "datalist"}), "optgroup": (("optgroup",), {"select"}),
}
_SCOPE = frozenset("table td th caption html template object marquee".split())

_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>""")
_LOOSE = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?""")
_NOT_SHOWN = re.compile(r"(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))", re.IGNORECASE)
_SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name or text, attributes) with kind text, start, end."""
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], ""
        if lt == n:
            return
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
            continue
        if page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
            continue
        m = _TAG.match(page, lt) or _LOOSE.match(page, lt)
        if m is None:
            if lt + 1 < n and (page[lt + 1].isalpha() or page[lt + 1] == "/"):
                return                                        # a tag that the page's end cuts off
            yield "text", "<", ""
            at = lt + 1
            continue
        name, at = m.group(2).lower(), m.end()
        yield ("end" if m.group(1) else "start"), name, m.group(3)
        if not m.group(1) and (name in RAW or name in RCDATA):
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])", re.IGNORECASE).search(page, at)
            stop = end.start() if end else n
            yield "raw" if name in RAW else "text", page[at:stop], ""
            at = stop


def attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        found.setdefault(name.lower(), html.unescape(value))
    return found


def build(page: str) -> Node:
    """The tree of a page, with the tags that it implies."""
    root = Node("html", {})
    stack = [root]

    def close(names: tuple[str, ...], beyond: frozenset[str] | set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                if names[0] not in ("tr", "thead"):
                    return
            elif stack[i].tag in beyond:
                return

    def open_(name: str, attrs: dict[str, str]) -> None:
        node = Node(name, attrs)
        stack[-1].children.append(node)
        if name not in VOID:
            stack.append(node)

    for kind, value, rest in tokens(page):
        if kind in ("text", "raw"):
            if value:
                value = html.unescape(value) if kind == "text" else value
                if stack[-1].tag == "head" and value.strip(" \t\n\r\f"):
                    stack.pop()                               # text ends the head
                stack[-1].children.append(value)
        elif kind == "start":
            attrs = attributes(rest) if rest.strip(" /") else {}
            if value in ("html", "body"):
                if stack[-1].tag == "head":
                    stack.pop()
                target = root if value == "html" else next((x for x in stack if x.tag == "body"), None)
                if target is not None:
                    for k, v in attrs.items():
                        target.attributes.setdefault(k, v)
                    continue
            if stack[-1].tag == "head" and value not in HIDDEN and value not in ("base", "meta", "link"):
                stack.pop()                                   # a body element ends the head
            if value in _ENDS_P:
                close(("p",), _SCOPE)
            if value in _CLOSES:
                close(*_CLOSES[value])
            if value in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
                if stack[-1].tag == "table":
                    open_("tbody", {})
                open_("tr", {})
            elif value == "tr" and stack[-1].tag == "table":
                open_("tbody", {})
            if value in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            open_(value, attrs)
        else:
            if value == "br":
                stack[-1].children.append(Node("br", {}))
                continue
            if value == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p", {}))
                continue
            if value in HEADINGS:                             # ends whichever heading is open
                value = next((x.tag for x in reversed(stack) if x.tag in HEADINGS), value)
            beyond = {"table"} if value in ("tr", "td", "th", "thead", "tbody", "tfoot") else \
                () if value in ("table", "body", "html", "div", "article", "section", "main") else _SCOPE
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == value:
                    del stack[i:]
                    break
                if stack[i].tag in beyond:
                    break
    return root


def hidden(node: Node) -> bool:
    """Whether an element and all in it is not shown."""
    a = node.attributes
    if node.tag in HIDDEN or (node.tag == "dialog" and "open" not in a):
        return True
    if not a:
        return False
    return ("hidden" in a or (node.tag == "input" and a.get("type", "").lower() == "hidden")
            or ("style" in a and bool(_NOT_SHOWN.search(a["style"]))))


class Lines:
    """Lines under construction: collapses white space and keeps block spacing."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False          # white space waits for the next word
        self.blank = False          # a blank line waits for the next line
        self.prefix: list[str] = []
        self.mark = ""              # mark of a list item whose first line is still to come

    def text(self, value: str) -> None:
        if not value:
            return
        lead, tail = value[0] in " \t\n\r\f", value[-1] in " \t\n\r\f"
        body = _SPACE.sub(" ", value).strip(" ")
        if not body:
            self.space = True
            return
        if (lead or self.space) and self.line:
            self.line.append(" ")
        self.line.append(body)
        self.space = tail

    def exact(self, value: str) -> None:
        first, *rest = value.split("\n")
        self.line.append(first)
        for x in rest:
            self.end(keep=True)
            self.line.append(x)

    def end(self, keep: bool = False) -> None:
        """Ends the line; an empty one counts only if it is kept."""
        line = "".join(self.line)
        self.line, self.space = [], False
        if line or keep:
            self.add(line)

    def add(self, line: str) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = "".join(self.prefix)
        if self.mark and line:
            indent, self.mark = indent[:len(indent) - len(self.mark)] + self.mark, ""
        self.lines.append((indent + line).rstrip(" "))

    def gap(self) -> None:
        self.end()
        self.blank = True

    def done(self) -> list[str]:
        self.end()
        return self.lines


class Table:
    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []      # column, columns, lines
        self.taken: dict[int, int] = {}                             # column -> rows still covered from above
        self.caption: list[str] = []

    def row(self) -> None:
        self.rows.append([])
        self.column = 0
        self.covered, self.taken = self.taken, {c: n - 1 for c, n in self.taken.items() if n > 1}

    def cell(self, node: Node, lines: list[str]) -> None:
        if not self.rows:
            self.row()
        while self.column in self.covered:
            self.column += 1
        wide, tall = _span(node, "colspan", 1000), _span(node, "rowspan", 65534)
        self.rows[-1].append((self.column, wide, lines))
        if tall > 1:
            for c in range(self.column, self.column + wide):
                self.taken[c] = tall - 1
        self.column += wide

    def lines(self) -> list[str]:
        width: dict[int, int] = {}
        for row in self.rows:
            for column, wide, lines in row:
                longest = max(map(len, lines), default=0)
                if wide == 1 and longest <= ALIGNED:
                    width[column] = max(width.get(column, 0), longest)
        at, starts = 0, {}
        last = max((c + w for row in self.rows for c, w, _ in row), default=0)
        for c in range(last):
            starts[c] = at
            at += width.get(c, 0) + (2 if width.get(c, 0) else 0)
        out = list(self.caption)
        for row in self.rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line = ""
                for column, _, lines in row:
                    if i < len(lines) and lines[i]:
                        line = line.ljust(starts[column]) if len(line) <= starts[column] or not line else line + "  "
                        line += lines[i]
                out.append(line.rstrip(" "))
        return out


def _span(node: Node, name: str, most: int) -> int:
    value = node.attributes.get(name, "")
    return min(most, max(1, int(value))) if value.isascii() and value.isdigit() else 1


def render(root: Node) -> str:
    """The visible text of a tree."""
    out = [Lines()]
    tables: list[Table] = []
    lists: list[list] = []                  # [tag, next number]
    pre = 0
    todo: list[tuple[Node | str, bool]] = [(root, True)]
    while todo:
        node, entering = todo.pop()
        o = out[-1]
        if isinstance(node, str):
            if pre:
                o.exact(node)
            elif not (tables and node.isspace() and not o.line):
                o.text(node)
            continue
        tag = node.tag
        if entering:
            if hidden(node):
                continue
            if tag == "br":
                o.end(keep=True)
                continue
            if tag == "img":
                continue
            if tag == "table":
                o.gap()
                tables.append(Table())
                out.append(Lines())         # what stands in the table outside its cells
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th", "caption") and tables:
                out.append(Lines())
            elif tag in BLOCK:
                if tag in SPACED and not (tag in LISTS and lists):
                    o.gap()
                else:
                    o.end()
                if tag in LISTS:
                    start = node.attributes.get("start", "")
                    lists.append([tag, int(start) if re.fullmatch(r"-?\d{1,9}", start, re.ASCII) else 1])
                elif tag == "li":
                    mark = "* "
                    if lists and lists[-1][0] == "ol":
                        mark = f"{lists[-1][1]}. "
                        lists[-1][1] += 1
                    o.prefix.append(" " * len(mark))
                    o.mark = mark
                elif tag in ("dd", "blockquote"):
                    o.prefix.append("    ")
                elif tag in ("pre", "xmp"):
                    pre += 1
            todo.append((node, False))
            children = node.children
            if tag in ("pre", "textarea") and children and isinstance(children[0], str) and children[0].startswith("\n"):
                children = [children[0][1:], *children[1:]]
            if tag == "details" and "open" not in node.attributes:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.extend((c, True) for c in reversed(children))
            continue
        if tag == "table" and tables:
            loose, table = out.pop().done(), tables.pop()
            o = out[-1]
            for line in [*loose, *table.lines()]:
                o.add(line)
            o.blank = True
        elif tag in ("td", "th") and tables:
            tables[-1].cell(node, out.pop().done())
        elif tag == "caption" and tables:
            tables[-1].caption += out.pop().done()
        elif tag in BLOCK and not (tag == "tr" and tables):
            if tag in ("pre", "xmp"):
                pre -= 1
                while o.line and not "".join(o.line):
                    o.line = []
            o.end()
            if tag in LISTS and lists:
                lists.pop()
            elif tag == "li" and o.prefix:
                o.prefix.pop()
                o.mark = ""
            elif tag in ("dd", "blockquote") and o.prefix:
                o.prefix.pop()
            if tag in SPACED and not (tag in LISTS and lists):
                o.blank = True
    lines = out[0].done()
    while lines and not lines[0]:
        lines.pop(0)
    while lines and not lines[-1]:
        lines.pop()
    return "\n".join(lines)


def page_text(page: str | None) -> str:
    return render(build(page)) if page else ""


def visible_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """``id_col`` and ``text`` of every row; map-only."""
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texts.small(batches, 1):
            found = [page_text(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=schema.names)

    return pages.select(id_col, html_col).mapInArrow(run, schema)
