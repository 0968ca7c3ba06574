"""Reading EPUB files: container, package, contents, and the text blocks of each resource."""

from __future__ import annotations

import io
import posixpath
import re
import urllib.parse
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass, field

from quire.sources.html import _SILENT, HEADINGS, Node, decode, parse

_CANDIDATES = frozenset(("p", *HEADINGS, "li", "blockquote", "td", "th", "dt", "dd", "div"))
_IMAGES = frozenset(("img", "image", "svg"))
#: Elements whose contents are not read as text of a block.
_UNREAD = frozenset(("rt", "rp", "script", "style")) | _IMAGES
_HTML = ("application/xhtml+xml", "text/html")


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def resolve(base: str, raw: str | None) -> tuple[str, str, bool]:
    """(resource, fragment, external) of a reference found in the file ``base``; + stays +."""
    raw = (raw or "").strip()
    parts = urllib.parse.urlsplit(raw)
    if parts.scheme or parts.netloc:
        return raw, "", True
    path, fragment = urllib.parse.unquote(parts.path), urllib.parse.unquote(parts.fragment)
    if not path:
        return base if raw else "", fragment, False
    full = path.lstrip("/") if path.startswith("/") else posixpath.join(posixpath.dirname(base), path)
    return posixpath.normpath(full), fragment, False


@dataclass
class Package:
    path: str
    title: str = ""
    spine: list[str] = field(default_factory=list)
    contents: list[str] = field(default_factory=list)


def package_path(z: zipfile.ZipFile) -> str:
    for e in ET.fromstring(z.read("META-INF/container.xml")).iter():
        if _tag(e) == "rootfile" and e.get("full-path"):
            return e.get("full-path")
    raise ValueError("the container names no package file")


def read_package(z: zipfile.ZipFile) -> Package:
    """Title, spine (HTML resources, each once) and tables of contents (nav, then spine toc, then NCX)."""
    path = package_path(z)
    root = ET.fromstring(z.read(path))
    items, spine, refs, title = {}, None, [], ""
    for e in root.iter():
        tag = _tag(e)
        if tag == "title" and not title:
            title = (e.text or "").strip()
        elif tag == "item" and e.get("id"):
            items[e.get("id")] = (resolve(path, e.get("href"))[0], e.get("media-type", ""), (e.get("properties") or "").split())
        elif tag == "spine":
            spine = e
        elif tag == "itemref":
            refs.append(e.get("idref"))
    html = [items[r][0] for r in refs if r in items and (items[r][1] in _HTML or items[r][0].lower().endswith((".xhtml", ".html", ".htm")))]
    toc = [h for h, _, p in items.values() if "nav" in p]
    if spine is not None and spine.get("toc") in items:
        toc.append(items[spine.get("toc")][0])
    toc += [h for h, m, _ in items.values() if m == "application/x-dtbncx+xml" or h.lower().endswith(".ncx")]
    return Package(path, title, list(dict.fromkeys(html)), list(dict.fromkeys(toc)))


def ncx_entries(data: bytes, path: str) -> list[dict]:
    """Entries of an NCX in pre-order, each with the place of its parent."""
    out: list[dict] = []
    for nav in (e for e in ET.fromstring(data).iter() if _tag(e) == "navMap"):
        ahead: list[tuple[ET.Element, int | None, int]] = [(p, None, 0) for p in reversed(nav) if _tag(p) == "navPoint"]
        while ahead:
            point, parent, depth = ahead.pop()
            label = next((" ".join("".join(x.itertext()).split()) for x in point if _tag(x) == "navLabel"), "")
            raw = next((x.get("src") for x in point if _tag(x) == "content"), None)
            href, fragment, external = resolve(path, raw)
            out.append({"toc_path": path, "node": len(out), "parent": parent, "depth": depth, "title": label, "raw_href": raw, "href": href, "fragment": fragment, "external": external})
            ahead += [(p, len(out) - 1, depth + 1) for p in reversed(point) if _tag(p) == "navPoint"]
    return out


def nav_labels(root: Node) -> Iterator[tuple[Node, int | None, int]]:
    """The labels of a navigation document in pre-order, each with the place of its parent and its depth. An
    item's label is its direct link, else its direct span; an item with neither hands its parent down."""
    navs = [n for n in root.walk() if n.tag == "nav"]
    typed = [n for n in navs if "toc" in n.attributes.get("epub:type", "").split()]
    scope = typed or [n for n in navs if not n.attributes.get("epub:type")][:1]
    count = 0
    lists = [ol for nav in scope if (ol := nav.find("ol")) is not None]
    ahead: list[tuple[Node, int | None, int]] = [(li, None, 0) for ol in reversed(lists) for li in reversed(ol.children) if isinstance(li, Node) and li.tag == "li"]
    while ahead:
        li, parent, depth = ahead.pop()
        own = [c for c in li.children if isinstance(c, Node)]
        label = next((c for c in own if c.tag == "a"), None) or next((c for c in own if c.tag == "span"), None)
        if label is not None:
            yield label, parent, depth
            parent, depth, count = count, depth + 1, count + 1
        inner = [x for c in own if c.tag == "ol" for x in c.children if isinstance(x, Node) and x.tag == "li"]
        ahead += [(x, parent, depth) for x in reversed(inner)]


def nav_entries(html: str, path: str) -> list[dict]:
    """Entries of an EPUB 3 navigation document in pre-order."""
    out = []
    for label, parent, depth in nav_labels(parse(html)):
        raw = label.attributes.get("href")
        href, fragment, external = resolve(path, raw)
        out.append({"toc_path": path, "node": len(out), "parent": parent, "depth": depth, "title": " ".join(label.text().split()), "raw_href": raw, "href": href, "fragment": fragment, "external": external})
    return out


def toc_entries(z: zipfile.ZipFile, paths: list[str]) -> list[dict]:
    """Entries of all tables of contents; one that cannot be read is passed over."""
    out: list[dict] = []
    for path in paths:
        try:
            data = z.read(path)
            out += ncx_entries(data, path) if path.lower().endswith(".ncx") or b"<ncx" in data[:2048] else nav_entries(decode(data), path)
        except (KeyError, ET.ParseError, UnicodeDecodeError):
            continue
    return out


def _innermost(root: Node, skip_nav: bool) -> Iterator[Node]:
    """Blocks with text that hold no other such block, in order.

    An element is judged when its contents have been walked, by what has been counted since it began:
    blocks found, and texts that show. What scripts, styles and templates hold shows outside them not."""
    found: list[Node] = []
    shown = 0
    ahead: list[tuple[Node | str, tuple[int, int] | None]] = [(root, None)]
    while ahead:
        node, before = ahead.pop()
        if isinstance(node, str):
            shown += bool(node.strip())
        elif before is None:
            if node is not root:
                ahead.append((node, (len(found), shown)))
            ahead += [(c, None) for c in reversed(node.children) if not (skip_nav and isinstance(c, Node) and c.tag == "nav")]
        else:
            if node.tag in _CANDIDATES and (len(found), shown > before[1]) == (before[0], True):
                found.append(node)
            if node.tag in _SILENT:
                shown = before[1]
    return iter(found)


def inline_content(block: Node) -> tuple[str, list[dict]]:
    """Text of a block without ruby annotations, white space collapsed, and its images with offset."""
    parts, size, last, images = [], 0, "", []
    for c in block.pieces(_UNREAD):
        if isinstance(c, str):
            part = re.sub(r"[ \t\r\n\f]+", " ", c)
            part = part[1:] if part.startswith(" ") and (not size or last in " \n") else part
        elif c.tag == "br":
            while parts and (cut := parts[-1].rstrip(" ")) != parts[-1]:
                size -= len(parts[-1]) - len(cut)
                parts.pop()
                if cut:
                    parts.append(cut)
            part = "\n"
        else:
            if c.tag in _IMAGES:
                images.append({"tag": c.tag, "offset": size})
            continue
        if part:
            parts.append(part)
            size, last = size + len(part), part[-1]
    text = "".join(parts)
    out = text.strip()
    lead = len(text) - len(text.lstrip())
    for i in images:
        i["offset"] = min(max(0, i["offset"] - lead), len(out))
        i["placement"] = "before" if i["offset"] == 0 else "after" if i["offset"] == len(out) else "inline"
    return out, images


def split_breaks(block: Node) -> list[Node]:
    """A block with direct br children as one node per line; blank lines are left out."""
    if not any(isinstance(c, Node) and c.tag == "br" for c in block.children):
        return [block]
    lines = [Node(block.tag, dict(block.attributes))]
    for c in block.children:
        if isinstance(c, Node) and c.tag == "br":
            lines.append(Node(block.tag))
        else:
            lines[-1].children.append(c)
    return [x for x in lines if x.text().strip()]


def resource(html: str, index: int, skip_nav: bool = False) -> tuple[list[dict], dict[str, int]]:
    """Segments of a resource, innermost blocks cut at line breaks, and the place in them of each id.

    An id in a block stands for the line that it is in, one between blocks for the block that follows; one
    after the last block stands for the number of segments. Of equal ids the first counts."""
    root = parse(html)
    out: list[dict] = []
    starts, ends, lines = {}, {}, {}
    for block in _innermost(root.find("body") or root, skip_nav):
        starts[id(block)] = len(out)
        for line in split_breaks(block):
            lines |= {id(n): len(out) for n in line.walk()}
            text, images = inline_content(line)
            if text:
                out.append({"anchor": f"q{index}_{len(out)}", "kind": "heading" if block.tag in HEADINGS else "text", "source": text, "images": images})
        ends[id(block)] = len(out)
    ids: dict[str, int] = {}
    ahead = 0
    open_: list[tuple[Node, int | None]] = [(root, None)]
    while open_:  # in document order; a block is met again, as (block, -1), when it ends
        node, place = open_.pop()
        if place == -1:
            ahead = ends[id(node)]
            continue
        inside = place if place is not None else starts.get(id(node))
        at = lines.get(id(node), ahead if inside is None else inside)
        for name in ("id", "name"):
            if value := node.attributes.get(name):
                ids.setdefault(value, at)
        if place is None and inside is not None:
            open_.append((node, -1))
        open_ += [(c, inside) for c in reversed(node.children) if isinstance(c, Node)]
    return out, ids


def resource_segments(html: str, index: int, skip_nav: bool = False) -> list[dict]:
    return resource(html, index, skip_nav)[0]


def read(data: bytes) -> dict:
    """A whole book: title, resources with segments, ids and their place in the book, contents."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        package, there = read_package(z), set(z.namelist())
        navs, resources, at = set(package.contents), [], 0
        for i, h in enumerate(package.spine):
            if h in there:
                segments, ids = resource(decode(z.read(h)), i, h in navs)
                resources.append({"href": h, "index": i, "start": at, "segments": segments, "ids": ids})
                at += len(segments)
        return {"title": package.title, "resources": resources, "toc": toc_entries(z, package.contents)}
