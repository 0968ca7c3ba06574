"""Reading FB2 books: the first unnamed body, section by section."""

from __future__ import annotations

import base64
import binascii
import xml.etree.ElementTree as ET
from collections.abc import Iterator

_TEXT = frozenset(("p", "v", "text-author"))
_INSIDE = frozenset(("epigraph", "cite", "poem", "stanza", "title", "annotation"))


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _flat(e: ET.Element) -> str:
    return " ".join("".join(e.itertext()).split())


def _child(e: ET.Element, tag: str) -> ET.Element | None:
    return next((c for c in e if _tag(c) == tag), None)


def root_of(data: bytes) -> ET.Element:
    """The parsed book: by its declared encoding, else as UTF-8 with replacement."""
    try:
        return ET.fromstring(data)
    except (ET.ParseError, LookupError, ValueError):
        text = data.decode("utf-8", "replace")
        end = text.find("?>")
        return ET.fromstring(text[end + 2 :] if text.lstrip("﻿").startswith("<?xml") and end > 0 else text)


def _title(e: ET.Element) -> str:
    t = _child(e, "title")
    return "" if t is None else " ".join(x for p in t if (x := _flat(p)))


def _segments(e: ET.Element) -> tuple[list[tuple[str, str]], list[tuple[int, str]]]:
    """Own blocks of a section, without those of its sections, and its images with the number of blocks
    that come before each."""
    blocks: list[tuple[str, str]] = []
    images: list[tuple[int, str]] = []
    ahead = [(c, e) for c in reversed(e)]
    while ahead:
        c, above = ahead.pop()
        tag = _tag(c)
        if tag == "section" or (tag == "title" and _tag(above) == "section"):
            continue
        if tag in _TEXT or tag == "subtitle":
            images += [(len(blocks), name) for i in c.iter() if _tag(i) == "image" and (name := _link(i))]
            if text := _flat(c):
                blocks.append(("heading" if tag == "subtitle" else "text", text))
        elif tag == "image":
            images += [(len(blocks), name)] if (name := _link(c)) else []
        elif tag in _INSIDE:
            ahead += [(x, c) for x in reversed(c)]
    return blocks, images


def _link(image: ET.Element) -> str:
    return next((v for k, v in image.attrib.items() if k.rpartition("}")[2] == "href"), "").lstrip("#")


def _walk(top: ET.Element) -> Iterator[dict]:
    ahead = [top]
    while ahead:
        section = ahead.pop()
        own, images = _segments(section)
        title = _title(section)
        inner = [c for c in section if _tag(c) == "section"]
        if own or title or images or not inner:
            if segments := ([("heading", title)] if title else []) + own:
                yield {"title": title, "segments": segments, "images": [(n + bool(title), name) for n, name in images]}
            elif images:  # an illustration alone goes to the chapter before it
                yield {"title": "", "segments": [], "images": images}
        ahead += reversed(inner)


def chapters(data: bytes) -> list[dict]:
    """Chapters {title, segments, images} of a book."""
    root = root_of(data)
    bodies = [b for b in root if _tag(b) == "body"]
    body = next((b for b in bodies if "name" not in b.attrib), None)
    if body is None:
        body = bodies[0] if bodies else root
    out = []
    head = _child(body, "title")
    if head is not None:
        names = [t for p in head if (t := _flat(p))]
        if names:
            out.append({"title": names[-1], "segments": [("heading", t) for t in names], "images": []})
    for section in body:
        if _tag(section) == "section":
            for chapter in _walk(section):
                if chapter["segments"] or not out:
                    out.append(chapter)
                else:
                    out[-1]["images"] += [(len(out[-1]["segments"]), name) for _, name in chapter["images"]]
    if len(out) > 1 and not out[0]["segments"]:  # nothing comes before its images
        out[1]["images"] = [(0, name) for _, name in out[0]["images"]] + out[1]["images"]
    out = [x for x in out if x["segments"]]
    if not out:
        own, images = _segments(body)
        out = [{"title": "", "segments": own, "images": images}] if own else []
    return out


def binaries(data: bytes) -> dict[str, bytes]:
    """Embedded files by id; those that cannot be decoded are left out."""
    out = {}
    for e in root_of(data):
        if _tag(e) == "binary" and e.get("id"):
            try:
                out[e.get("id")] = base64.b64decode("".join((e.text or "").split()), validate=True)
            except (binascii.Error, ValueError):
                continue
    return out
