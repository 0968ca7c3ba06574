"""A filter of 64-bit keys of a fixed size, for broadcasting: it lets all its keys through and few others.

Its size does not grow with the keys; with very many of them it lets more through, which costs work where
the keys are joined exactly afterwards, but loses nothing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.words import mix

#: Bits that one task makes.
PART = 1 << 16


def slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """The three bits, of so many of the filter, that stand for each key."""
    return np.stack([(mix(keys + np.uint64(k)) % np.uint64(bits)).astype(np.int64) for k in range(3)])


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys (unsigned) the filter lets through."""
    at = slots(keys, 8 * len(bits))
    return ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(0)


def _part_bits(part: pa.Table) -> pa.Table:
    bits = np.zeros(PART, np.uint8)
    bits[part.column("bit").to_numpy()] = 1
    return pa.table({"part": part.column("part").slice(0, 1), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def key_filter(keys: DataFrame, size: int) -> np.ndarray:
    """The filter of the one column of ``keys`` (long); its parts are made in tasks, and ``size`` bits, a
    multiple of PART, reach the driver."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = slots(batch.column(0).to_numpy().view(np.uint64), size).ravel()
            yield pa.RecordBatch.from_arrays([pa.array((at // PART).astype(np.int32)), pa.array((at % PART).astype(np.int32))], names=["part", "bit"])

    made = keys.mapInArrow(rows, "part int, bit int").distinct().groupBy("part").applyInArrow(_part_bits, "part int, bits binary")
    bits = np.zeros(size // 8, np.uint8)
    for row in made.collect():
        bits[row.part * PART // 8 : (row.part + 1) * PART // 8] = np.frombuffer(row.bits, np.uint8)
    return bits
