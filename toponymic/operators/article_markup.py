"""Text and metadata of marked-up articles (P1, P2), one parse for both.

Articles and pages are often not well-formed, so a lenient tokeniser feeds a stack of
open elements in one pass; the function runs inside ``mapInArrow``, so Spark partitions
the documents and only the extracted columns leave a task. The rules:

* comments, scripts, styles, declarations and processing instructions hold no text;
  character references of every kind are decoded;
* an element closed by its own end tag holds everything inside, elements of the same name
  included, so text after a list or a table inside a paragraph is kept;
* a ``p`` (``li``, ``dt``, ``dd``, ``tr``, ``td``, ``th``) ends where the next one starts unless a
  container was opened in between; one that is never closed ends at the first
  block-level tag after it, or with the element around it;
* an end tag without an open element is ignored, and so is an inline one that would
  close a container.

A null document has null text and null metadata.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

META = T.StructType([
    T.StructField("year", T.IntegerType()), T.StructField("pub_type", T.StringType()),
    T.StructField("journal", T.StringType()), T.StructField("doi", T.StringType()), T.StructField("pmid", T.StringType())])

# Elements that flow inside a line of text (the usual page and article tags).
INLINE = frozenset("a abbr b bdi bdo big bold cite code data del dfn em email ext-link font i inline-formula ins italic kbd "
                   "label mark monospace named-content overline q roman s samp sans-serif sc small span strike strong "
                   "styled-content sub sup time tt u underline uri var xref".split())
# Page elements that end an unclosed paragraph.
BLOCK = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form "
                  "h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section table ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
REPEATED = frozenset("p li dt dd tr td th".split())
RAW = frozenset(("script", "style"))

# A whole tag that holds no further "<", or the beginning of any markup. A try ends at the next "<".
_HEAD = re.compile(r"""<(?:(/?)([A-Za-z][^\s/>"'<]*+)(?=[\s/>])((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|/?[A-Za-z]|[!?])""")
_SUBSET_END = re.compile(r"\]\s*>")
_NAME_END = re.compile(r"[\s/>]")
_SPECIAL = re.compile(r"""[>"']""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_YEAR = re.compile(r"\s*([+-]?\d{1,9})\s*", re.ASCII)
_FRONT = frozenset(("front", "pub-date", "year", "journal-title", "article-id"))


class Element:
    """A named element; ``end`` is the piece behind its text. ``blocks``: how many block tags came before it.
    ``front``, ``date``: the outermost element of that kind around it."""
    __slots__ = ("name", "attributes", "start", "end", "blocks", "front", "date")

    def __init__(self, name: str, attributes: dict[str, str], start: int, blocks: int, inside: "Element | None"):
        self.name, self.attributes, self.start, self.blocks, self.end = name, attributes, start, blocks, None
        self.front = self.date = None
        if inside is not None:
            self.front = inside.front or (inside if inside.name == "front" else None)
            outermost = inside.name == "front" and inside.front is None
            self.date = None if outermost else inside.date or (inside if inside.name == "pub-date" else None)


class _Next:
    """The next match of a pattern at or after rising positions, every character searched once."""

    def __init__(self, pattern: re.Pattern, markup: str):
        self.search, self.markup, self.since, self.found = pattern.search, markup, 0, -1

    def __call__(self, at: int) -> int:
        """Position of the match, or the length of the markup."""
        if not self.since <= at <= self.found:
            m = self.search(self.markup, at)
            self.since, self.found = at, m.start() if m else len(self.markup)
        return self.found


def tokens(markup: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, kind, name, rest) of the tags (kind ``<`` or ``</``) and other markup (``data``: rest is its text;
    ``!``) of a document, in order. The caller may send a position to go on from.

    Quotes in a tag hide what is in them; a tag that never ends is text. What was once found to lead to no
    end isn't read again, so the time follows the length of the markup.
    """
    n, at = len(markup), 0
    name_end, special, search = _Next(_NAME_END, markup), _Next(_SPECIAL, markup), _HEAD.search
    dead: set[int] = set()                  # places of > and quotes from which no tag ends
    last = {quote: markup.rfind(quote) for quote in "\"'"}
    subset = True
    while True:
        head = search(markup, at)
        if head is None:
            return
        start, at = head.span()
        kind, name, rest = "!", "", ""
        if head.group(2) is not None:
            kind, name, rest = "<" + head.group(1), head.group(2).lower(), head.group(3)
        elif markup.startswith("!--", start + 1):
            stop = markup.find("-->", start + 4)
            at = stop + 3 if stop >= 0 else n
        elif markup[start + 1:start + 9].upper() == "![CDATA[":
            stop = markup.find("]]>", start + 9)
            kind, rest = "data", markup[start + 9:stop if stop >= 0 else n]
            at = stop + 3 if stop >= 0 else n
        elif markup[at - 1] in "!?":
            stop = markup.find(">", at)
            if subset and markup[start + 1:start + 9].upper() == "!DOCTYPE":
                bracket = markup.find("[", start, stop if stop >= 0 else n)
                if bracket >= 0:
                    m = _SUBSET_END.search(markup, bracket)
                    subset, stop = m is not None, m.end() - 1 if m else stop
            at = stop + 1 if stop >= 0 else n
        else:
            begin = at - 1
            after = name_end(at)
            seen, q = [], special(after)
            while q < n and markup[q] != ">" and q not in dead:
                seen.append(q)
                close = markup.find(markup[q], q + 1) if last[markup[q]] > q else -1
                if close < 0:
                    q = n
                    break
                # a search of its own: places inside of tags don't come in rising order
                m = _SPECIAL.search(markup, close + 1)
                q = m.start() if m else n
            if q >= n or markup[q] != ">":
                dead.update(seen)
                at = begin + 1
                continue
            kind = "</" if begin > start + 1 else "<"
            name, rest, at = markup[begin:after].lower(), markup[after:q], q + 1
        to = yield start, at, kind, name, rest
        if to is not None:
            at = to
            yield start, at, "", "", ""


def _attributes(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        found.setdefault(m.group(1).lower(), html.unescape(next(v for v in m.groups()[1:] if v is not None)))
    return found


def parse(markup: str, names: frozenset[str]) -> tuple[list[str], list[Element]]:
    """Text pieces of a document and the elements called ``names``, in document order; an
    element's text is ``pieces[start:end]``."""
    pieces: list[str] = []
    found: list[Element] = []
    stack: list[tuple[str, Element | None]] = []
    opened: dict[str, list[int]] = {}           # places in the stack, by name
    containers: list[int] = []                  # places of elements that aren't inline
    inner: list[int] = []                       # places of elements called ``names``
    blocks: list[int] = []                      # pieces before each block tag

    def shut(at: int, own: bool = False) -> None:
        """Takes the elements from ``at`` on away. They have no end tag of their own, but for the one at
        ``at`` with ``own``; so they end at the first block tag after their start."""
        for i in range(len(stack) - 1, at - 1, -1):
            name, e = stack.pop()
            opened[name].pop()
            if containers and containers[-1] == i:
                containers.pop()
            if e is not None:
                inner.pop()
                early = e.blocks < len(blocks) and not (own and i == at)
                e.end = blocks[e.blocks] if early else len(pieces)

    done, n = 0, len(markup)
    stream = tokens(markup)
    for start, at, kind, name, rest in stream:
        if start > done:
            text = markup[done:start]
            pieces.append(html.unescape(text) if "&" in text else text)
        done = at
        if kind == "data" and rest:
            pieces.append(rest)
        if not name:
            continue
        if name in BLOCK:
            blocks.append(len(pieces))
        if kind == "</":
            places = opened.get(name)
            if places and not (name in INLINE and containers and containers[-1] > places[-1]):
                shut(places[-1], own=True)
            continue
        if name in REPEATED and containers and stack[containers[-1]][0] == name:
            shut(containers[-1])
        element = None
        if name in names:
            element = Element(name, _attributes(rest), len(pieces), len(blocks), stack[inner[-1]][1] if inner else None)
            found.append(element)
        if name in RAW and not rest.endswith("/"):
            close = re.compile(f"</{name}\\s*>", re.IGNORECASE).search(markup, at)
            done = close.end() if close else n
            stream.send(done)
        if name in VOID or name in RAW or rest.endswith("/"):
            if element is not None:
                element.end = len(pieces)
        else:
            opened.setdefault(name, []).append(len(stack))
            if name not in INLINE:
                containers.append(len(stack))
            if element is not None:
                inner.append(len(stack))
            stack.append((name, element))
    if done < n:
        pieces.append(html.unescape(markup[done:]))
    shut(0)
    return pieces, found


def _text(pieces: list[str], element: Element) -> str:
    return "".join(pieces[element.start:element.end])


def _meta(pieces: list[str], found: list[Element]) -> dict:
    front = next((e for e in found if e.name == "front"), None)
    out = dict.fromkeys(META.names)
    if front is None:
        return out

    inner = [e for e in found if e.front is front]
    date = next((e for e in inner if e.name == "pub-date"), None)
    if date is not None:
        year = next((e for e in inner if e.name == "year" and e.date is date), None)
        number = _YEAR.fullmatch(_text(pieces, year)) if year is not None else None
        if number and "pub-type" in date.attributes:
            out["year"], out["pub_type"] = int(number.group(1)), date.attributes["pub-type"]
    journal = next((e for e in inner if e.name == "journal-title"), None)
    out["journal"] = (_text(pieces, journal) or None) if journal is not None else None
    for kind in ("doi", "pmid"):
        e = next((e for e in inner if e.name == "article-id" and e.attributes.get("pub-id-type") == kind), None)
        out[kind] = (_text(pieces, e) or None) if e is not None else None
    return out


def element_text(markup: str | None, tag: str = "p") -> str | None:
    """Text of every element ``tag``, in document order, each followed by two newlines."""
    if markup is None:
        return None
    pieces, found = parse(markup, frozenset((tag.lower(),)))
    return "".join(_text(pieces, e) + "\n\n" for e in found)


def article_fields(markup: str | None, tag: str = "p") -> tuple[str | None, dict]:
    """``element_text`` and the metadata, in one parse."""
    if markup is None:
        return None, dict.fromkeys(META.names)
    tag = tag.lower()
    pieces, found = parse(markup, _FRONT | {tag})
    return "".join(_text(pieces, e) + "\n\n" for e in found if e.name == tag), _meta(pieces, found)


#: Bytes of markup that a worker turns into text at once; a longer document is taken alone.
BATCH_BYTES = 4 << 20


def _bounded(batches: Iterator[pa.RecordBatch], column: int, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``most`` bytes of markup, so memory doesn't follow the number of rows."""
    most = BATCH_BYTES if most is None else most
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        lo = total = 0
        for i, n in enumerate(lengths):
            if i > lo and total + n > most:
                yield batch.slice(lo, i - lo)
                lo, total = i, 0
            total += n
        yield batch.slice(lo)


def with_tag_text(df: DataFrame, markup_col: str, tag: str = "p", out_col: str = "text") -> DataFrame:
    """``df`` with the text of every ``tag`` element of its markup."""
    schema, at = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())]), df.columns.index(markup_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, at):
            found = [element_text(x, tag) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def with_article_fields(df: DataFrame, markup_col: str, tag: str = "p", out_col: str = "text",
                        meta_col: str = "meta") -> DataFrame:
    """``df`` without its markup, with the text (P2) and a struct of the metadata."""
    kept = [i for i, c in enumerate(df.columns) if c != markup_col]
    at = df.columns.index(markup_col)
    schema = T.StructType([*(df.schema.fields[i] for i in kept), T.StructField(out_col, T.StringType()),
                           T.StructField(meta_col, META)])
    kind = pa.struct([("year", pa.int32()), *((n, pa.string()) for n in META.names[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _bounded(batches, at):
            found = [article_fields(x, tag) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array([t for t, _ in found], pa.string()),
                 pa.array([m for _, m in found], kind)], names=schema.names)

    return df.mapInArrow(run, schema)
