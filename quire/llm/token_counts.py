"""Offset-mapped attribution of tokens to the sections of a document.

A document is encoded once as a whole; its sections are spans of characters that cover the text
without gaps. The byte span of every token follows from the vocabulary, and a sorted interval join
finds the section of each token. A token that crosses a boundary goes by an explicit rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import small_batches
from quire.llm.tokenization import byte_bpe, default_path

SCHEMA = "doc_id long, section int, kind string, start long, end long, n_tokens long, n_crossing long, doc_tokens long"
RULES = ("first", "last", "majority")
_ARROW = pa.schema([("doc_id", pa.int64()), ("section", pa.int32()), ("kind", pa.string())] + [(n, pa.int64()) for n in ("start", "end", "n_tokens", "n_crossing", "doc_tokens")])


def line_sections(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions at which sections start, and whether each is a title: every line with its
    newline is a section, the first one the title. An empty text is one empty section."""
    starts = np.flatnonzero(data[:-1] == 10) + 1 if len(data) else np.zeros(0, np.int64)
    starts = np.concatenate(([0], starts))
    return starts, np.arange(len(starts)) == 0


def attribute(lengths: np.ndarray, starts: np.ndarray, n_bytes: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and tokens that cross into a later section, per section.

    Token k covers bytes [ends[k] - lengths[k], ends[k]). Rule first: it counts for the section of its
    first byte; last: of its last byte; majority: of the section holding most of its bytes, ties to
    the earliest."""
    ends = np.cumsum(lengths)
    begin = ends - lengths
    a = np.searchsorted(starts, begin, "right") - 1
    b = np.searchsorted(starts, ends - 1, "right") - 1
    owner = a if rule == "first" else b if rule == "last" else a.copy()
    if rule == "majority":
        bounds = np.append(starts, n_bytes)
        for k in np.flatnonzero(a != b):
            inside = [min(ends[k], bounds[s + 1]) - max(begin[k], bounds[s]) for s in range(a[k], b[k] + 1)]
            owner[k] = a[k] + int(np.argmax(inside))
    n = len(starts)
    return np.bincount(owner, minlength=n), np.bincount(a[a != b], minlength=n)


def field_sections(parts: list[str]) -> tuple[str, np.ndarray]:
    """The text of several fields, joined by newlines, and the byte positions at which they start."""
    sizes = [len(p.encode()) + 1 for p in parts]
    return "\n".join(parts), np.cumsum([0, *sizes[:-1]])


def token_counts(documents: DataFrame, rule: str = "first", path: str | None = None, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """Tokens per section of every whole document; one row per section.

    The sections of a single field are its lines. With several ``fields`` they are the document, joined by
    newlines, and each field with the newline behind it is a section whose kind is the field's name; a null
    field is empty.

    Returns doc_id, section (from 0), kind (title or body), start and end (code points, end
    exclusive), n_tokens, n_crossing (tokens that start here and end in a later section), doc_tokens.
    Over a document n_tokens sums to doc_tokens. A null or empty text is one title section with no
    tokens; null and repeated doc_ids are carried as they are; further columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    if not fields:
        raise ValueError("there must be a field")
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in small_batches(batches, 1):
            found: list[tuple] = []
            for doc, *parts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text, starts = field_sections([p or "" for p in parts])
                data = np.frombuffer(text.encode(), np.uint8)
                ids = bpe.ids(text)
                kinds = np.array(fields)
                if len(fields) == 1:
                    starts, title = line_sections(data)
                    kinds = np.where(title, "title", "body")
                tokens, crossing = attribute(bpe.lengths[ids], starts, len(data), rule)
                chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                edges = chars[np.append(starts, len(data))]
                found.append((doc, starts, kinds, edges[:-1], edges[1:], tokens, crossing, len(ids)))
            if not found:
                continue
            sizes = [len(x[1]) for x in found]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x[0] for x, n in zip(found, sizes, strict=True) for _ in range(n)], pa.int64()),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])),
                    pa.array([str(k) for x in found for k in x[2]], pa.string()),
                    *(pa.array(np.concatenate([x[k] for x in found]).astype(np.int64)) for k in (3, 4, 5, 6)),
                    pa.array(np.repeat([x[7] for x in found], sizes).astype(np.int64)),
                ],
                schema=_ARROW,
            )

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(f).cast("string").alias(f"_{k}") for k, f in enumerate(fields))).mapInArrow(run, SCHEMA)
