"""Assembling books: one file per document from its rendered segments.

Each document is put together in one task from its own segments; files are rows (name, bytes), which the
tasks themselves save in any store that pyarrow's file systems reach.
"""

from __future__ import annotations

import html as html_lib
import io
import mimetypes
import os
import posixpath
import re
import urllib.parse
import uuid
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text
from quire.operators import render
from quire.sources import epub, html
from quire.sources.html import _SILENT, _VOID, Node, decode, parse

FORMATS = {"text": ".txt", "markdown": ".md", "html": ".html", "epub": ".epub"}


def serialize(root: Node) -> str:
    """Markup of a parsed tree."""
    out: list[str] = []
    ahead: list[tuple[Node | str, bool]] = [(root, False)]
    while ahead:
        node, raw = ahead.pop()
        if isinstance(node, str):
            out.append(node if raw else html_lib.escape(node, quote=False))
            continue
        if node.tag:
            attributes = "".join(f' {k}="{html_lib.escape(v)}"' for k, v in node.attributes.items())
            out.append(f"<{node.tag}{attributes}{'/' if node.tag in _VOID else ''}>")
            if node.tag in _VOID:
                continue
            ahead.append((f"</{node.tag}>", True))
        ahead += [(c, node.tag in _SILENT) for c in reversed(node.children)]
    return "".join(out)


def _filled(block: Node, shown: str) -> None:
    """Put a translation into a block; images stay, in proportion to where they stood."""
    source, images = epub.inline_content(block)
    kept = [n for n in block.walk() if n.tag in ("img", "image", "svg")]
    cuts, at = [], 0
    for i in images[: len(kept)]:
        at = max(at, min(len(shown), round(i["offset"] * len(shown) / len(source)) if source else 0))
        cuts.append(at)
    parts: list[Node | str] = []
    for piece, image in zip([shown[a:b] for a, b in zip([0, *cuts], [*cuts, len(shown)], strict=True)], [*kept, None], strict=False):
        for k, line in enumerate(piece.split("\n")):
            parts += ([Node("br")] if k else []) + ([line] if line else [])
        if image is not None:
            parts.append(image)
    block.children = parts


#: Styles that are added to a book: for upright lines where it asked for vertical ones, and for sources.
_HORIZONTAL = "html, body { writing-mode: horizontal-tb !important; -webkit-writing-mode: horizontal-tb !important; -epub-writing-mode: horizontal-tb !important; }"
_SOURCE = ".source { font-size: 0.85em; opacity: 0.7; }"


def asks_vertical(markup: str) -> bool:
    """Whether markup or style asks for vertical writing, by the rules of ``text.looks_vertical``."""
    low = markup.lower()
    name, value = text.RIGHT_TO_LEFT
    modes = re.findall(r"writing-mode\s*:\s*([a-z-]+)", low)
    classes = [w for c in re.findall(r"\bclass\s*=\s*[\"']([^\"']*)", low) for w in re.split(r"\W+", c)]
    return any(m in text.VERTICAL_MODES for m in modes) or re.search(rf"{name}\s*=\s*[\"']{value}[\"']", low) is not None or text.VERTICAL_CLASS in classes


#: Orders in which a translation and its source are printed.
ORDERS = ("target_first", "source_first")


def _source_node(block: Node, source: str, tag: str, keep_style: bool) -> Node:
    """The element that shows a source; it may look like the block that it is the source of."""
    own = block.attributes if keep_style else {}
    names = [*own.get("class", "").split(), "source"]
    return Node(tag, {"class": " ".join(dict.fromkeys(names))} | ({"style": own["style"]} if "style" in own else {}), [source])


def place_source(block: Node, source: str, order: str = "target_first", lines: bool = False, keep_style: bool = False) -> tuple[list[Node], list[Node]]:
    """The elements that go before and after a translated block to show its source.

    An item of a list, a quotation or a table cell keeps it inside, as do blocks of several lines, where it
    is a line; every other block gets a neighbour."""
    first = order == "source_first"
    if lines:
        node = _source_node(block, source, "span", keep_style)
        block.children = [node, Node("br"), *block.children] if first else [*block.children, Node("br"), node]
    elif block.tag in ("li", "blockquote", "td", "th", "dt", "dd"):
        node = _source_node(block, source, "div", keep_style)
        block.children = [node, *block.children] if first else [*block.children, node]
    else:
        node = _source_node(block, source, "p" if block.tag == "p" else "div", keep_style)
        return ([node], []) if first else ([], [node])
    return [], []


def _spliced(markup: str, edits: list[tuple[int, int, str]]) -> str:
    """The markup with places (first, last) replaced; everything else stays as it is."""
    out, at = [], 0
    for first, last, new in sorted(edits):
        out += [markup[at:first], new]
        at = last
    return "".join([*out, markup[at:]])


def render_template(markup: str, targets: dict[str, str], bilingual: bool = False, order: str = "target_first", keep_style: bool = False) -> str:
    """A page with its blocks translated (by anchor); all markup outside them stays character by character.

    With ``bilingual`` the source of all but headings is shown too, where it is another text."""
    edits: list[tuple[int, int, str]] = []
    for anchor, kind, block in html.anchored_blocks(markup):
        if anchor not in targets:
            continue
        start, inner, inner_end, end = block.span
        source, shown = block.text().strip(), targets[anchor] or block.text().strip()
        before, after = [], []
        _filled(block, shown)
        if bilingual and kind != "heading" and source != shown.strip():
            before, after = place_source(block, source, order, keep_style=keep_style)
        edits.append((inner, inner_end, "".join(map(serialize, block.children))))
        edits += [(start, start, "".join(map(serialize, before)))] * bool(before) + [(end, end, "".join(map(serialize, after)))] * bool(after)
    if bilingual and (head := html.parse(markup).find("head")) is not None and not keep_style:
        edits.append((head.span[2], head.span[2], f"<style>{_SOURCE}</style>"))
    return _spliced(markup, edits)


def rewrite_page(data: bytes, targets: dict[str, str], bilingual: bool = False, order: str = "target_first") -> bytes:
    """``render_template`` on a file, which keeps its encoding; what that cannot write is a reference."""
    name = html.encoding(data)
    mark = b"\xef\xbb\xbf" if data.startswith(b"\xef\xbb\xbf") else b""
    return mark + render_template(data[len(mark) :].decode(name, "replace"), targets, bilingual, order).encode(name, "xmlcharrefreplace")


def render_resource(
    markup: str, index: int, targets: dict[str, str], bilingual: bool = False, lang: str = "zh-Hans", skip_nav: bool = False, styles: tuple[str, ...] = (), order: str = "target_first"
) -> str:
    """A resource with its translated blocks; with ``bilingual`` also their sources, by ``place_source``."""
    root = parse(markup)
    body = root.find("body") or root
    parents = {id(c): n for n in [body, *body.walk()] for c in n.children if isinstance(c, Node)} if bilingual else {}
    n = 0
    for block in list(epub._innermost(body, skip_nav)):
        lines = [t for line in epub.split_breaks(block) if (t := epub.inline_content(line)[0])]
        anchors = [f"q{index}_{n + k}" for k in range(len(lines))]
        n += len(lines)
        found = [targets.get(a) or s for a, s in zip(anchors, lines, strict=True)]
        if any(a in targets for a in anchors):
            source = "\n".join(lines)
            _filled(block, "\n".join(found))
            if bilingual and block.tag not in html.HEADINGS and source != "\n".join(found):
                before, after = place_source(block, source, order, lines=len(lines) > 1)
                around = parents[id(block)].children
                at = next(k for k, c in enumerate(around) if c is block)
                around[at : at + 1] = [*before, block, *after]
    if (top := root.find("html")) is not None:
        top.attributes |= {"lang": lang, "xml:lang": lang}
        if styles:
            if (head := top.find("head")) is None:
                head = Node("head")
                top.children.insert(0, head)
            head.children += [Node("style", {}, [x]) for x in styles]
    return '<?xml version="1.0" encoding="utf-8"?>\n' + serialize(root)


#: A start tag, whose attributes may hold > in quotes.
_START_TAG = re.compile(rb"""<[^>"']*(?:"[^"]*"[^>"']*|'[^']*'[^>"']*)*>""")


def _ncx_labels(data: bytes) -> list[tuple[int, int, str | None]]:
    """The label of every navPoint of an NCX in pre-order, whatever the prefixes of its names: the bytes
    (first, last) of the label's text, (-1, -1) without one, and the raw link."""
    parser = expat.ParserCreate(namespace_separator=" ")
    path: list[str] = []
    points: list[list] = []
    open_points: list[list] = []
    text: list[int] | None = None

    def start(name: str, attributes: dict[str, str]) -> None:
        nonlocal text
        name, above = name.rpartition(" ")[2], path[-1] if path else ""
        path.append(name)
        if name == "navPoint" and above in ("navMap", "navPoint"):
            points.append([-1, -1, None])
            open_points.append(points[-1])
        elif open_points and name == "content" and above == "navPoint":
            open_points[-1][2] = attributes.get("src")
        elif open_points and name == "text" and path[-3:-1] == ["navPoint", "navLabel"] and open_points[-1][0] < 0:
            tag = _START_TAG.match(data, parser.CurrentByteIndex)
            if tag and not tag[0].endswith(b"/>"):  # an element without contents has no place for a label
                text = open_points[-1]
                text[:2] = [tag.end(), -1]

    def end(name: str) -> None:
        nonlocal text
        if path.pop() == "text" and text is not None:
            text[1] = parser.CurrentByteIndex
            text = None
        elif name.rpartition(" ")[2] == "navPoint" and open_points:
            open_points.pop()

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(data, True)
    return [(first, last, href) for first, last, href in points]


#: A label of a table of contents, and the raw link that its entry had when it was read (null: not known).
Label = tuple[str, str | None]


def relabel(data: bytes, labels: dict[int, Label], ncx: bool, by_name: dict[str, str] | None = None) -> bytes:
    """A table of contents with new labels by place in pre-order; nothing else of it is changed.

    An entry whose raw link is not the one that was read is another entry and stays. ``by_name`` has the
    labels of state without places, by the name of the file that an entry links to. A table that cannot be
    parsed stays as it is."""

    def label(k: int, raw: str | None) -> str | None:
        if k in labels:
            text, expected = labels[k]
            return text if text and (expected is None or expected == (raw or "")) else None
        return (by_name or {}).get(posixpath.basename((raw or "").partition("#")[0]))

    if ncx:
        try:
            found = _ncx_labels(data)
        except expat.ExpatError:
            return data
        edits = [(a, b, new) for k, (a, b, raw) in enumerate(found) if a >= 0 and (new := label(k, raw)) is not None]
        out, at = [], 0
        for a, b, new in sorted(edits):
            out += [data[at:a], html_lib.escape(new, quote=False).encode("ascii", "xmlcharrefreplace")]
            at = b
        return b"".join([*out, data[at:]])
    name = html.encoding(data)
    markup = data.decode(name, "replace")
    edits = []
    for k, (node, _, _) in enumerate(epub.nav_labels(parse(markup))):
        if (new := label(k, node.attributes.get("href"))) is not None:
            edits.append((node.span[1], node.span[2], html_lib.escape(new, quote=False)))
    return _spliced(markup, edits).encode(name, "xmlcharrefreplace")


def rewrite_epub(
    data: bytes, targets: dict[str, str], labels: dict[tuple[str, int], str | Label] | None = None, bilingual: bool = False, lang: str = "zh-Hans", order: str = "target_first",
    by_name: dict[str, str] | None = None,
) -> bytes:
    """The same book, translated in place: other entries are copied, the language is set.

    Anchors that the book does not have are an error: the state is of another file."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
        package = epub.read_package(z)
        there = {s["anchor"] for r in epub.read(data)["resources"] for s in r["segments"]}
        if gone := sorted(set(targets) - there)[:3]:
            raise ValueError(f"the book has no segments {', '.join(gone)}")
        marked = [n for n in z.namelist() if n in package.spine or n == package.path or n.lower().endswith(".css")]
        vertical = any(asks_vertical(decode(z.read(n))) for n in marked)
        styles = ((_HORIZONTAL,) if vertical else ()) + ((_SOURCE,) if bilingual else ())
        for item in z.infolist():
            body = z.read(item)
            if item.filename == "mimetype":
                new.writestr(item, body, zipfile.ZIP_STORED)
                continue
            if item.filename in package.spine:
                body = render_resource(decode(body), package.spine.index(item.filename), targets, bilingual, lang, item.filename in package.contents, styles, order).encode()
            elif item.filename == package.path:
                body = re.sub(r"(<dc:language[^>]*>).*?(</dc:language>)", rf"\g<1>{lang}\g<2>", decode(body), flags=re.S).encode()
                if vertical:
                    name, value = text.RIGHT_TO_LEFT
                    body = re.sub(rf"({name}\s*=\s*[\"']){value}([\"'])", r"\g<1>ltr\g<2>", decode(body)).encode()
            if (labels or by_name) and item.filename in package.contents:
                own = {k: t if isinstance(t, tuple) else (t, None) for (path, k), t in (labels or {}).items() if path == item.filename}
                body = relabel(body, own, item.filename.lower().endswith(".ncx") or b"<ncx" in body[:2048], by_name)
            new.writestr(item.filename, body)
    return out.getvalue()


def _package_ends(package: bytes) -> tuple[dict[str, tuple[int, str]], set[str]]:
    """Where the manifest and the spine of a package end, with the prefixes of their tags, and all ids."""
    parser, ends, ids = expat.ParserCreate(), {}, set()

    def start(name: str, attributes: dict[str, str]) -> None:
        ids.update(v for k, v in attributes.items() if k == "id")

    def end(name: str) -> None:
        prefix, _, tag = name.rpartition(":")
        at = parser.CurrentByteIndex
        if tag in ("manifest", "spine") and package[at : at + 2] == b"</":
            ends.setdefault(tag, (at, f"{prefix}:" if prefix else ""))

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(package, True)
    return ends, ids


def with_last_page(data: bytes, title: str, paragraphs: list[str], lang: str = "zh-Hans", stem: str = "about") -> bytes:
    """An EPUB with one more page behind all others, under a file name and an id that it does not use yet; it stays
    as it is where its package cannot be read or has no manifest or spine."""
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        try:
            path = epub.package_path(z)
            package = z.read(path)
            ends, ids = _package_ends(package)
        except (KeyError, ValueError, ET.ParseError, expat.ExpatError):
            return data
        if len(ends) < 2:
            return data
        taken = {n.lower() for n in z.namelist()}
        file_names = (f"{stem}{k}.xhtml" for k in ("", *(f"-{i}" for i in range(1, len(taken) + 2))))
        name = next(n for n in file_names if posixpath.join(posixpath.dirname(path), n).lower() not in taken)
        own = next(i for i in (f"{stem}-page{k}" for k in ("", *(f"-{i}" for i in range(1, len(ids) + 2)))) if i not in ids)
        added = {"manifest": f'item id="{own}" href="{name}" media-type="application/xhtml+xml"/>', "spine": f'itemref idref="{own}"/>'}
        for tag, (at, prefix) in sorted(ends.items(), key=lambda x: -x[1][0]):
            package = package[:at] + f"<{prefix}{added[tag]}".encode() + package[at:]
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as new:
            for item in z.infolist():
                new.writestr(item, package if item.filename == path else z.read(item))
            e = html_lib.escape
            body = f"<h1>{e(title, quote=False)}</h1>" + "".join(f"<p>{e(p, quote=False)}</p>" for p in paragraphs)
            new.writestr(posixpath.join(posixpath.dirname(path), name), f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" lang="{e(lang)}"><head><title>{e(title, quote=False)}</title></head><body>{body}</body></html>')
    return out.getvalue()


def with_last_pages(files: DataFrame, title: str, paragraphs: list[str]) -> DataFrame:
    """EPUB files (path, content), each with one more page behind all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([with_last_page(content, title, paragraphs)], pa.binary())], names=["path", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, content binary")


def _media_type(name: str) -> str:
    return mimetypes.guess_type(name)[0] or "image/png"


def build_epub(title: str, chapters: list[tuple[str, list[tuple[str, str]]]], lang: str = "zh-Hans", images: dict[str, bytes] | None = None) -> bytes:
    """A new book from chapters (title, [(kind, text)]).

    A text of kind ``image`` names one of ``images``, which is shown there; images that no chapter shows,
    as a cover, stand on a page before the chapters."""
    e = html_lib.escape
    named = {name for _, segments in chapters for kind, name in segments if kind == "image"}
    if alone := [name for name in images or {} if name not in named]:
        chapters = [("", [("image", name) for name in alone]), *chapters]

    def shown(kind: str, line: str) -> str:
        if kind == "image":
            return f'<div class="image"><img src="images/{e(urllib.parse.quote(line))}" alt=""/></div>' if line in (images or {}) else ""
        tag = "h2" if kind == "heading" else "p"
        return f"<{tag}>{e(line, quote=False).replace(chr(10), '<br/>')}</{tag}>"

    out = io.BytesIO()
    page = '<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{lang}"><head><title>{title}</title></head><body>{body}</body></html>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        z.writestr("META-INF/container.xml", '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="book.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        names = [f"c{k}.xhtml" for k in range(len(chapters))]
        for name, (head, segments) in zip(names, chapters, strict=True):
            body = "".join(shown(kind, line) for kind, line in segments)
            z.writestr(name, page.format(lang=lang, title=e(head or title), body=body))
        links = "".join(f'<li><a href="{n}">{e(h or f"{k + 1}")}</a></li>' for k, (n, (h, s)) in enumerate(zip(names, chapters, strict=True)) if h or any(kind != "image" for kind, _ in s))
        z.writestr("nav.xhtml", page.format(lang=lang, title=e(title), body=f'<nav epub:type="toc"><ol>{links}</ol></nav>'))
        for name, data in (images or {}).items():
            z.writestr(f"images/{name}", data)
        items = "".join(f'<item id="i{k}" href="{n}" media-type="application/xhtml+xml"/>' for k, n in enumerate(names)) + "".join(f'<item id="m{k}" href="images/{e(urllib.parse.quote(n))}" media-type="{_media_type(n)}"/>' for k, n in enumerate(images or {}))
        spine = "".join(f'<itemref idref="i{k}"/>' for k in range(len(names)))
        z.writestr(
            "book.opf",
            f'<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{e(title)}</dc:identifier><dc:title>{e(title)}</dc:title><dc:language>{lang}</dc:language></metadata>'
            f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>{items}</manifest><spine>{spine}</spine></package>',
        )
    return out.getvalue()


def output_names(paths: DataFrame, fmt: str, bilingual: bool = False) -> DataFrame:
    """(path, name): the name of the file that is made of each book. Books that would get the same name,
    whatever its case, are told apart by a hash of their paths."""
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]+)$", 1), r"\.[^.]*$", "")
    each = paths.select("path").distinct().withColumn("_stem", stem)
    apart = F.count("*").over(Window.partitionBy(F.lower("_stem"))) > 1
    own = F.when(apart, F.concat(F.col("_stem"), F.lit("-"), F.substring(F.sha2("path", 256), 1, 12))).otherwise(F.col("_stem"))
    return each.select("path", F.concat(own, F.lit((".zh-bi" if bilingual else ".zh") + FORMATS[fmt])).alias("name"))


def named(files: DataFrame, fmt: str, bilingual: bool, shelf: DataFrame | None) -> DataFrame:
    """Files (path of the book, content) as (path of the file, content)."""
    names = output_names(files if shelf is None else shelf, fmt, bilingual).withColumnRenamed("path", "_book")
    return files.join(names, F.col("path") == F.col("_book")).select(F.col("name").alias("path"), "content")


def assembled(segments: DataFrame, fmt: str, bilingual: bool = False, images: DataFrame | None = None, order: str = "target_first", shelf: DataFrame | None = None) -> DataFrame:
    """Rows (path, content) with one file per document from (path, title, chapter, chapter_title, seg,
    kind, source, target); ValueError for an unknown format or order.

    ``images`` has the images of documents (path, images map<string, binary>, places), which go into an
    EPUB: ``places`` says before which segment of a chapter, counted from 0 and perhaps behind the last, an
    image is shown. ``shelf`` (path) has all books among which names are to differ, by default these."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; known: {', '.join(FORMATS)}")
    if order not in ORDERS:
        raise ValueError(f"unknown order {order!r}; known: {', '.join(ORDERS)}")
    first = order == "source_first"
    if fmt == "epub":
        text = render.shown(F.col("source"), F.col("target"))
        other = render.bilingual_source(F.col("source"), text, F.col("kind")) if bilingual else F.lit(None).cast("string")
        place = F.row_number().over(Window.partitionBy("path", "chapter").orderBy("seg")) - 1
        lines = F.posexplode(F.array(other, text) if first else F.array(text, other)).alias("part", "text")
        printed = segments.withColumn("place", place).select("path", "title", "chapter", "chapter_title", "place", lines, "kind").where("text is not null")
        printed = printed.withColumn("part", F.col("part") + 1)
        if images is None:
            images = segments.sparkSession.createDataFrame([], "path string, images map<string,binary>, places array<struct<chapter:int,place:int,name:string>>")
        # An image is a line before the segment at its place, so one behind the last segment stays too.
        at = images.select("path", F.posexplode("places").alias("_k", "_x")).select("path", F.col("_x.chapter").alias("chapter"), F.col("_x.place").alias("place"), F.col("_x.name").alias("text"), "_k")
        pictures = at.select("path", F.lit(None).cast("string").alias("title"), "chapter", F.lit(None).cast("string").alias("chapter_title"), "place", (F.col("_k") - 1_000_000_000).alias("part"), "text", F.lit("image").alias("kind"))

        def build(key: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values(["chapter", "place", "part"], kind="stable")
            if not (rows["kind"] != "image").any():
                return pd.DataFrame({"path": [], "content": []})
            chapters = [(str(next(iter(g["chapter_title"].dropna()), "")), list(zip(g["kind"], g["text"], strict=True))) for _, g in rows.groupby("chapter")]
            found = dict(own["images"].iloc[0] or {}) if len(own) else {}
            return pd.DataFrame({"path": [key[0]], "content": [build_epub(str(next(iter(rows["title"].dropna()), "")), chapters, images=found)]})

        made = printed.unionByName(pictures).groupBy("path").cogroup(images.select("path", "images").groupBy("path")).applyInPandas(build, "path string, content binary")
        return named(made, fmt, bilingual, segments if shelf is None else shelf)
    wide = segments.withColumn("seg", F.struct("chapter", F.col("seg").alias("s")))
    if fmt == "html":
        body = render.html_blocks(wide, ["path"])
        content = F.concat(F.lit('<!DOCTYPE html><html><head><meta charset="utf-8"></head><body>\n'), "text", F.lit("</body></html>\n"))
    else:
        body = render.joined(render.blocks(wide, ["path"], bilingual=bilingual, source_first=first, markdown=fmt == "markdown"), ["path"], ["seg", "part"])
        content = F.col("text")
    return named(body.select("path", F.encode(content, "utf-8").alias("content")), fmt, bilingual, segments if shelf is None else shelf)


_LABELS = "array<struct<toc_path:string,toc_node:int,toc_href:string,name:string,label:string>>"


def _in_place(files: DataFrame, segments: DataFrame, labels: DataFrame | None, rewrite: Callable[[bytes, dict[str, str], list[dict]], bytes]) -> DataFrame:
    """Files (path, content) rewritten in tasks with their targets by anchor and their labels; a file with
    neither is left as it is."""
    targets = segments.where("target is not null and anchor is not null").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("anchor", "target"))).alias("targets"))
    both = files.select("path", "content").join(targets, "path", "left")
    if labels is None:
        both = both.withColumn("labels", F.lit(None).cast(_LABELS))
    else:
        names = [F.col(c) if c in labels.columns else F.lit(None).cast("string").alias(c) for c in ("toc_path", "toc_node", "toc_href", "name", "label")]
        titled = labels.where("label is not null").select("path", *names).groupBy("path").agg(F.collect_list(F.struct("toc_path", "toc_node", "toc_href", "name", "label")).alias("labels"))
        both = both.join(titled, "path", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content, found, own in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "targets", "labels")), strict=True):
                new = rewrite(content, dict(found or []), own or []) if found or own else content
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([new], pa.binary())], names=["path", "content"])

    return both.select("path", "content", "targets", "labels").mapInArrow(run, "path string, content binary")


def translated_epubs(files: DataFrame, segments: DataFrame, labels: DataFrame | None = None, bilingual: bool = False, order: str = "target_first") -> DataFrame:
    """Original files (path, content), each translated in place: (path, content).

    ``segments`` has the texts to show (path, anchor, target), ``labels`` the titles of entries of the
    table of contents (path, toc_path, toc_node, label), perhaps with the raw link that they were read with
    (toc_href), or, where no place is known, the name of the file they link to. A file without either is left
    as it is."""

    def rewrite(content: bytes, targets: dict[str, str], named: list[dict]) -> bytes:
        own = {(n["toc_path"], n["toc_node"]): (n["label"], n["toc_href"]) for n in named if n["toc_path"] is not None}
        by_name = {n["name"]: n["label"] for n in named if n["toc_path"] is None and n["name"]}
        return rewrite_epub(content, targets, own, bilingual=bilingual, order=order, by_name=by_name)

    return _in_place(files, segments, labels, rewrite)


def translated_pages(files: DataFrame, segments: DataFrame, bilingual: bool = False, order: str = "target_first") -> DataFrame:
    """Original HTML files (path, content), each as its own template: blocks are translated by anchor,
    all else stays byte by byte."""
    return _in_place(files, segments, None, lambda content, targets, _: rewrite_page(content, targets, bilingual, order))


def save_files(files: DataFrame, folder: str) -> list[str]:
    """Save rows (path, content) below a folder that the executors reach, and return the paths.

    The tasks that made the files write them, each first under a temporary name and then moved in one step,
    so that a repeated task does no harm and no reader sees half a file. A folder without a scheme is one of
    this machine, which only a session of one process may write to."""
    if "://" not in folder and not files.sparkSession.sparkContext.master.startswith("local"):
        raise ValueError(f"executors would each write to their own {folder}; name a folder that they share, with its scheme")
    target = folder if "://" in folder else "file://" + os.path.abspath(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(target)
        for batch in batches:
            saved = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base.rstrip('/')}/{name}"
                store.create_dir(path.rpartition("/")[0], recursive=True)
                part = f"{path}.{uuid.uuid4().hex}.part"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, path)
                saved.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(saved, pa.string())], names=["path"])

    return sorted(r["path"] for r in files.select("path", "content").mapInArrow(run, "path string").collect())
