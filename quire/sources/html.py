"""Reading HTML pages into chapters and segments, with the standard library's parser.

A small tree is built for each page. Chapters are cut at headings that are direct children of the body;
headings with only white space between them open one chapter. Within a chapter the outermost block
elements are its segments.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = frozenset(("p", *HEADINGS, "li", "blockquote"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
_SILENT = frozenset(("script", "style", "template"))
#: A start tag of these closes an open p, as browsers do.
_CLOSES_P = frozenset(("p", *HEADINGS, "ul", "ol", "dl", "table", "blockquote", "div", "section", "article", "nav", "pre", "form", "header", "footer", "main", "aside", "hr"))


@dataclass
class Node:
    """An element, with the places in its markup where its start tag begins and ends and its end tag begins
    and ends (-1 for elements that were made)."""

    tag: str
    attributes: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    span: tuple[int, int, int, int] = (-1, -1, -1, -1)

    def text(self) -> str:
        return "".join(text for text in self.pieces(_SILENT) if isinstance(text, str))

    def find(self, tag: str) -> Node | None:
        return next((n for n in self.walk() if n.tag == tag), None)

    def walk(self) -> Iterator[Node]:
        return (n for n in self.pieces() if isinstance(n, Node))

    def pieces(self, closed: frozenset[str] = frozenset()) -> Iterator[Node | str]:
        """Everything inside, elements before their contents, in order; those of ``closed`` are not entered.

        A list of what is still to be visited stands in for recursion, so markup may be of any depth."""
        ahead = [iter(self.children)]
        while ahead:
            for c in ahead[-1]:
                yield c
                if isinstance(c, Node) and c.tag not in closed:
                    ahead.append(iter(c.children))
                    break
            else:
                ahead.pop()


class _Builder(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.html = html
        self.root = Node("", span=(0, 0, len(html), len(html)))
        self.path = [self.root]
        self.open: Counter[str] = Counter()
        self.items: list[int] = []  # places in the path of lists and their items
        self.lines = [0, *(m.end() for m in re.finditer("\n", html))]

    def _here(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def _cut(self, k: int, at: int, end: int) -> None:
        """Close the elements from place k of the path on; the end tag, if there is one, is that of k."""
        for n in self.path[k:]:
            self.open[n.tag] -= 1
            n.span = (*n.span[:2], at, at)
        self.path[k].span = (*self.path[k].span[:2], at, end)
        del self.path[k:]
        while self.items and self.items[-1] >= k:
            self.items.pop()

    def _close(self, tag: str, at: int, end: int) -> None:
        if self.open[tag]:
            self._cut(next(k for k in range(len(self.path) - 1, 0, -1) if self.path[k].tag == tag), at, end)

    def _start(self, tag: str, attrs: list) -> Node:
        at = self._here()
        node = Node(tag, {k: v or "" for k, v in attrs}, span=(at, *[at + len(self.get_starttag_text() or "")] * 3))
        self.path[-1].children.append(node)
        return node

    def handle_starttag(self, tag, attrs):
        at = self._here()
        if tag in _CLOSES_P:
            self._close("p", at, at)
        if tag == "li" and self.items and self.path[self.items[-1]].tag == "li":
            self._cut(self.items[-1], at, at)
        node = self._start(tag, attrs)
        if tag not in _VOID:
            if tag in ("ul", "ol", "li"):
                self.items.append(len(self.path))
            self.open[tag] += 1
            self.path.append(node)

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)

    def handle_endtag(self, tag):
        at = self._here()
        self._close(tag, at, self.html.find(">", at) + 1 or len(self.html))

    def handle_data(self, data):
        self.path[-1].children.append(data)

    def finished(self) -> Node:
        self.feed(self.html)
        self.close()
        if len(self.path) > 1:
            self._cut(1, len(self.html), len(self.html))
        return self.root


def parse(html: str) -> Node:
    return _Builder(html).finished()


def outermost_blocks(nodes: list[Node | str]) -> Iterator[Node]:
    """Block elements that are in no other block element, in order."""
    return (n for n in Node("", children=nodes).pieces(_SILENT | BLOCKS) if isinstance(n, Node) and n.tag in BLOCKS)


def _chapters(root: Node, cut_at: tuple[str, ...] = HEADINGS) -> list[tuple[str, list[tuple[str, str, Node]]]]:
    """(title, [(kind, text, block)]) of the chapters of a page."""
    body = root.find("body") or root
    cuts: list[tuple[list[str], list]] = [([], [])]
    in_heading = False
    for child in body.children:
        if isinstance(child, Node) and child.tag in cut_at:
            if not in_heading:
                cuts.append(([], []))
            cuts[-1][0].append(child.text().strip())
            in_heading = True
        elif not (isinstance(child, str) and not child.strip()):
            in_heading = False
        cuts[-1][1].append(child)
    out = []
    for titles, nodes in cuts:
        segments = [("heading" if b.tag in HEADINGS else "text", t, b) for b in outermost_blocks(nodes) if (t := b.text().strip())]
        if segments:
            out.append((" / ".join(t for t in titles if t) or next((t for k, t, _ in segments if k == "heading"), ""), segments))
    return out


def chapters(html: str, cut_at: tuple[str, ...] = HEADINGS) -> list[dict]:
    """Chapters {title, segments [(kind, text)]} of a page; those without text are left out."""
    return [{"title": title, "segments": [(kind, text) for kind, text, _ in segments]} for title, segments in _chapters(parse(html), cut_at)]


def anchored_blocks(html: str) -> list[tuple[str, str, Node]]:
    """(anchor, kind, block) of all segments of a page, under the anchors that its chapters give them."""
    return [(f"q{c}_{s}", kind, block) for c, (_, segments) in enumerate(_chapters(parse(html))) for s, (kind, _, block) in enumerate(segments)]


def encoding(data: bytes) -> str:
    """The encoding that markup declares and is readable in, else UTF-8."""
    head = data[:1024].decode("ascii", "replace")
    declared = re.search(r"""(?:charset|encoding)\s*=\s*["']?([A-Za-z0-9_.:-]+)""", head)
    try:
        if declared:
            data.decode(declared[1])
            return declared[1]
    except (LookupError, UnicodeDecodeError):
        pass
    return "utf-8"


def decode(data: bytes) -> str:
    """Text of markup: by its declared encoding, else UTF-8 with replacement; without a byte order mark."""
    return data.removeprefix(b"\xef\xbb\xbf").decode(encoding(data), "replace")


SCHEMA = "page_id long, chapter int, title string, seg int, kind string, anchor string, source string"


def html_segments(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """Segments of all chapters of HTML pages; null pages have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (page, c, ch["title"], s, kind, f"q{c}_{s}", text)
                for page, markup in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for c, ch in enumerate(chapters(markup or ""))
                for s, (kind, text) in enumerate(ch["segments"])
            ]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            types = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    return pages.select(F.col(key).cast("long").alias("page_id"), F.col(html).cast("string").alias("html")).mapInArrow(run, SCHEMA)
