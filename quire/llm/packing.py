"""Bounded-space online packing of tokenised documents into fixed windows.

Every partition keeps a fixed number of open windows. A piece goes where it fits best; when it fits
nowhere and no further window may be opened, it is cut so that it fills the fullest window, which is
then emitted. What is open at the end of a partition is merged with the leftovers of other
partitions, a bounded number of partitions at a time, until one group is left. The last window of
all is cut into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import small_batches, written
from quire.llm.tokenization import byte_bpe, default_path

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, open boolean, part long, ids binary"
_ARROW = pa.schema(
    [(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("open", pa.bool_()), ("part", pa.int64()), ("ids", pa.binary())]
)


class Packer:
    """The open windows of one partition or group. ``full`` collects the pieces of emitted windows."""

    def __init__(self, window: int, windows: int, level: int, part: int, keep_ids: bool = False):
        self.window, self.windows, self.keep_ids = window, windows, keep_ids
        self.next_id = (level << 58) | (part << 34)
        self.open: list[tuple[int, list]] = []  # fill, pieces
        self.full: list[tuple] = []

    def _emit(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            raw = ids.tobytes()
            self.full.append((doc, start, len(ids), zlib.crc32(raw), total, self.next_id, at, False, None, raw if self.keep_ids else None))
            at += len(ids)
        self.next_id += 1

    def _put(self, k: int, piece: tuple) -> None:
        fill, pieces = self.open[k]
        pieces.append(piece)
        if fill + len(piece[2]) == self.window:
            del self.open[k]
            self._emit(pieces)
        else:
            self.open[k] = (fill + len(piece[2]), pieces)

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        """Place one document or piece of it, cutting it as needed."""
        while len(ids) >= self.window:
            self._emit([(doc, start, ids[: self.window], total)])
            ids, start = ids[self.window :], start + self.window
        while len(ids):
            fits = [(self.window - fill, k) for k, (fill, _) in enumerate(self.open) if fill + len(ids) <= self.window]
            if fits:
                return self._put(min(fits)[1], (doc, start, ids, total))
            if len(self.open) < self.windows:
                self.open.append((0, []))
                return self._put(len(self.open) - 1, (doc, start, ids, total))
            fill, k = max((fill, -k) for k, (fill, _) in enumerate(self.open))
            room = self.window - fill
            self._put(-k, (doc, start, ids[:room], total))
            ids, start = ids[room:], start + room

    def leftovers(self, part: int) -> list[tuple]:
        """The pieces of the windows that are still open, with their ids."""
        return [
            (doc, start, len(ids), zlib.crc32(ids.tobytes()), total, k, at, True, part, ids.tobytes())
            for k, (_, pieces) in enumerate(self.open)
            for at, (doc, start, ids, total) in enumerate(pieces)
        ]

    def finish(self) -> None:
        """Fill windows one after another, then powers of two, so that nothing is padded."""
        rest = [piece for _, pieces in self.open for piece in pieces]
        self.open = []
        left = sum(len(p[2]) for p in rest)
        while left:
            size = self.window if left >= self.window else 1 << (left.bit_length() - 1)
            taken, room = [], size
            while room:
                doc, start, ids, total = rest.pop(0)
                taken.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    rest.insert(0, (doc, start + room, ids[room:], total))
                room -= len(taken[-1][2])
            self._emit(taken)
            left -= size


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _ARROW]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def pack(documents: DataFrame, window: int = 1024, windows: int = 16, fan_in: int = 64, path: str | None = None, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """Pack (doc_id, text) into sequences of at most ``window`` ids; one row per piece.

    Returns doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with ``keep_ids``,
    ids (the piece itself, little-endian unsigned 32-bit). A null or empty text is
    the single id ``end_id``; a null doc_id and repeated doc_ids are carried as they are; an empty
    table gives no rows; further columns are ignored. ``window`` must be a power of two for the last
    sequences to need no padding. Memory per task: ``windows`` windows and one document's ids.
    """
    path = path or default_path()

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part = byte_bpe(path), TaskContext.get().partitionId()
        packer = Packer(window, windows, 0, part, keep_ids)
        for batch in small_batches(batches, 1):
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = np.append(bpe.ids(text or ""), np.uint32(end_id)).astype("<u4", copy=False)
                packer.add(doc, 0, ids, len(ids))
                if len(packer.full) >= 20_000:
                    yield _batch(packer.full)
                    packer.full = []
        yield _batch(packer.full + packer.leftovers(part))

    def merge(level: int, last: bool):
        def run(key: tuple[pa.Scalar, ...], group: pa.Table) -> pa.Table:
            rows = group.sort_by([("part", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
            packer = Packer(window, windows, level, key[0].as_py(), keep_ids)
            for doc, start, total, ids in zip(*(rows.column(n).to_pylist() for n in ("doc_id", "start", "doc_tokens", "ids")), strict=True):
                packer.add(doc, start, np.frombuffer(ids, "<u4"), total)
            if last:
                packer.finish()
            return pa.Table.from_batches([_batch(packer.full + packer.leftovers(key[0].as_py()))])

        return run

    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = written(source.mapInArrow(first, SCHEMA), "packed")
    out = "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *(["ids"] if keep_ids else [])
    done, level = pieces.where("not open").select(*out), 0
    left = pieces.where("open")
    parts = left.agg(F.max("part")).first()[0]
    while parts is not None:
        level, last = level + 1, parts < fan_in
        grouped = left.withColumn("group", F.floor(F.col("part") / fan_in).cast("long")).groupBy("group")
        pieces = written(grouped.applyInArrow(merge(level, last), SCHEMA), f"packed-{level}")
        done = done.unionByName(pieces.where("not open").select(*out))
        left, parts = pieces.where("open"), None if last else parts // fan_in
    return done
