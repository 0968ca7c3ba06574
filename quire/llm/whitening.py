"""Whitening of embeddings by merging singular value decompositions.

A partition keeps, of the vectors it has read, their number, the exact sums, the mean and all singular
values and right singular vectors of the centred rows. Two such states are merged by decomposing the
stacked factors together with one row that corrects for the distance of the means; nothing is cut off,
so the merged state is that of all rows. States are merged FAN at a time in tasks until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import drop_written, written

#: Components that are returned for each vector.
COMPONENTS = 8
#: x = floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
#: States that one task merges.
FAN = 16
#: Rows that are decomposed in one go.
ROWS = 4096
#: A component with less than this share of the variance has none.
NOTHING = 1e-13
#: Scaled entries are held within this, where doubles and longs are exact.
_FARTHEST = float(1 << 52)


@dataclass
class State:
    """n rows with these sums; the centred rows have the factor s[:, None] * v (full rank, no cut)."""

    n: int
    sums: list[int]
    mean: np.ndarray
    factor: np.ndarray

    @classmethod
    def of_rows(cls, x: np.ndarray, origin: np.ndarray | None = None) -> State:
        """The state of whole-number rows."""
        n, sums = len(x), exact_sums(x)
        floor = np.array([s // n for s in sums], np.int64)
        near = (x - floor).astype(np.float64)  # small numbers, so that centring loses nothing
        rest = near.mean(0)
        return cls(n, sums, floor + rest, decomposed(near - rest))

    def merged(self, other: State) -> State:
        n = self.n + other.n
        sums = [a + b for a, b in zip(self.sums, other.sums, strict=True)]
        # The difference of the means from whole numbers, then rounded once.
        apart = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        correction = np.sqrt(self.n / n * other.n) * apart
        return State(n, sums, np.array([s / n for s in sums]), decomposed(np.vstack((self.factor, other.factor, correction))))

    def packed(self) -> tuple[int, list[str], bytes]:
        return self.n, [str(s) for s in self.sums], self.factor.tobytes()

    @classmethod
    def unpacked(cls, n: int, sums: list[str], factor: bytes) -> State:
        whole = [int(s) for s in sums]
        return cls(n, whole, np.array([s / n for s in whole]), np.frombuffer(factor).reshape(-1, len(whole)).copy())


def exact_sums(x: np.ndarray) -> list[int]:
    """Column sums of whole numbers, in pieces that cannot overflow."""
    if int(np.abs(x).max(initial=0)) < (1 << 62) // max(1, len(x)):
        return [int(s) for s in x.sum(0)]
    return [sum(map(int, c)) for c in x.T]


def decomposed(rows: np.ndarray) -> np.ndarray:
    """Singular values times right singular vectors of the rows: as many rows as dimensions at most, and
    the same inner products of columns."""
    _, s, v = np.linalg.svd(rows, full_matrices=False)
    return s[:, None] * v


def whole_numbers(entries: np.ndarray) -> np.ndarray:
    """x of each entry, as 64-bit whole numbers."""
    scaled = np.floor(np.clip(entries * SCALE, -_FARTHEST, _FARTHEST))
    return scaled.astype(np.int64) + SHIFT


def usable(vectors: pa.Array) -> np.ndarray:
    """Which vectors are not null and hold neither null nor non-finite entries; empty ones do not count."""
    flat = vectors.values
    bad = ~np.isfinite(flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False))
    before = np.concatenate(([0], np.cumsum(bad)))
    at = vectors.offsets.to_numpy()
    return vectors.is_valid().to_numpy(zero_copy_only=False) & (before[at[1:]] == before[at[:-1]]) & (at[1:] > at[:-1])


def _by_length(vectors: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimensions, positions, x rows) of the usable vectors, those of one length together."""
    ok = usable(vectors)
    at = vectors.offsets.to_numpy()
    size = at[1:] - at[:-1]
    flat = vectors.values.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
    for d in np.unique(size[ok]).tolist():
        rows = np.flatnonzero(ok & (size == d))
        yield d, rows, whole_numbers(flat[at[rows][:, None] + np.arange(d)])


def _lists(column: pa.Array) -> pa.ListArray:
    return column.cast(pa.list_(pa.float64()))


def _rows_of(states: list[tuple[int, State, int]]) -> pa.RecordBatch:
    packed = [s.packed() for _, s, _ in states]
    return pa.RecordBatch.from_arrays(
        [pa.array([d for d, _, _ in states], pa.int32()), pa.array([k for _, _, k in states], pa.int64()), pa.array([p[0] for p in packed], pa.int64()), pa.array([p[1] for p in packed], pa.list_(pa.string())), pa.array([p[2] for p in packed], pa.binary())],
        names=["dim", "part", "n", "sums", "factor"],
    )


_STATE = "dim int, part long, n long, sums array<string>, factor binary"


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One state per partition and vector length."""
    from pyspark import TaskContext

    found: dict[int, State] = {}
    for batch in batches:
        for d, _, x in _by_length(_lists(batch.column(0))):
            for k in range(0, len(x), ROWS):
                new = State.of_rows(x[k : k + ROWS])
                found[d] = found[d].merged(new) if d in found else new
    if found:
        part = TaskContext.get().partitionId()
        yield _rows_of([(d, s, part) for d, s in found.items()])


def _merge(group: pa.Table) -> pa.Table:
    """The states of one group as one state, numbered for the next round."""
    rows = sorted(group.to_pylist(), key=lambda r: r["part"])
    states = [State.unpacked(r["n"], r["sums"], r["factor"]) for r in rows]
    while len(states) > 1:
        states = [states[k].merged(states[k + 1]) if k + 1 < len(states) else states[k] for k in range(0, len(states), 2)]
    return pa.Table.from_batches([_rows_of([(rows[0]["dim"], states[0], rows[0]["part"] // FAN)])])


def _fitted(vectors: DataFrame) -> dict[int, State]:
    """The state of all vectors by their length. What reaches the driver are one state for each length."""
    states = written(vectors.mapInArrow(_states, _STATE), "svd-0")
    k = 0
    while (most := states.agg(F.max("part")).first()[0] or 0) > 0:
        k += 1
        new = written(states.groupBy("dim", F.floor(F.col("part") / FAN).alias("_g")).applyInArrow(_merge, _STATE), f"svd-{k}")
        drop_written(states)
        states = new
        if k > most.bit_length() + 1:
            raise RuntimeError("states are not merged")
    out = {r.dim: State.unpacked(r.n, r.sums, r.factor) for r in states.collect()}
    drop_written(states)
    return out


@dataclass
class Whitener:
    """Components by falling variance, at most COMPONENTS of them."""

    n: int
    sums: list[int]
    axes: np.ndarray
    values: np.ndarray
    share: np.ndarray

    @classmethod
    def of(cls, state: State) -> Whitener:
        _, s, v = np.linalg.svd(state.factor, full_matrices=False)
        d = len(state.sums)
        if len(s) < d:  # fewer rows than dimensions: what is left has no variance
            _, s_all, v = np.linalg.svd(np.vstack((state.factor, np.zeros((d - len(state.factor), d)))))
            s = s_all
        values, most = s * s / state.n, min(COMPONENTS, d)
        total = values.sum()
        share = values / total if total > 0 else np.zeros(len(values))
        return cls(state.n, state.sums, v[:most], values[:most], share[:most])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """Projections of x - S/n over the deviation; 0 along components that have no variance."""
        floor = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        scale = np.where(self.share > NOTHING, np.sqrt(np.where(self.values > 0, self.values, 1)), np.inf)
        return ((x - floor) - rest) @ self.axes.T / scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, exact; null beyond 64 bits."""
        sums = np.array(self.sums, dtype=object)
        far = max(max(abs(int(x.max(initial=0)) * self.n - s), abs(int(x.min(initial=0)) * self.n - s)) for s in self.sums)
        if far * far * x.shape[1] < 1 << 63 and int(np.abs(x).max(initial=0)) * self.n < 1 << 63:
            off = x * self.n - sums.astype(np.int64)
            return (off * off).sum(1).tolist()
        exact = [sum((self.n * int(c) - s) ** 2 for c, s in zip(row, self.sums, strict=True)) for row in x]
        return [e if e < 1 << 63 else None for e in exact]


def _pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for d, rows, x in _by_length(_lists(column)):
        for k in range(0, len(rows), ROWS):
            yield d, rows[k : k + ROWS], x[k : k + ROWS]


def whiten(embeddings: DataFrame) -> DataFrame:
    """Whitened coordinates of every usable vector of (vec_id, embedding), one row per vector and component.

    Rows whose vector is null, empty, or holds null or non-finite entries are left out. Each entry c becomes
    the whole number x = floor(1024 * c) + 100000 (1024 * c is held within 2**52 on either side). With n, the
    sums S and the covariance V of all x (divisor n), components are the unit eigenvectors of V by falling
    eigenvalue e, at most COMPONENTS of them. Columns: vec_id; component, from 1; n; deviation, the sum over
    dimensions of (n * x - S) ** 2, null where that passes 64 bits; whitened, x - S/n projected on the
    component over sqrt(e); explained, e over the trace of V; identity_error, the largest absolute entry of
    the covariance of all whitened rows minus the identity, taken over components that have variance. A
    component without variance gives whitened = 0. Vectors of another length are a space of their own, fitted
    apart. Null or repeated vec_ids are carried; repeated rows count as often as they stand there. An empty
    table gives no rows; further columns are ignored.
    """
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    models = {d: Whitener.of(s) for d, s in _fitted(rows.select("embedding")).items()}

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per partition and length: the number of whitened rows, their mean and centred inner products."""
        found: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for d, _, x in _pieces(batch.column(0)):
                y = models[d].whitened(x)
                found[d] = _joined_spread(found.get(d), (len(y), y.mean(0), (y - y.mean(0)).T @ (y - y.mean(0))))
        if found:
            yield _spread_rows(found)

    sums = rows.select("embedding").mapInArrow(spread, _SPREAD).groupBy("dim").applyInArrow(_spread_of_all, _SPREAD)
    errors = {r.dim: (r.n, np.frombuffer(r.m2)) for r in sums.collect()}
    error = {}
    for d, (n, m2) in errors.items():
        varied = models[d].share > NOTHING
        error[d] = float(np.abs(m2.reshape(len(varied), -1) / n - np.eye(len(varied)))[np.ix_(varied, varied)].max(initial=0.0))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in _pieces(batch.column(1)):
                m = models[d]
                k, c = len(at), len(m.values)
                ids = batch.column(0).take(pa.array(np.repeat(at, c)))
                deviation = pa.array(m.deviations(x), pa.int64()).take(pa.array(np.repeat(np.arange(k), c)))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.tile(np.arange(1, c + 1, dtype=np.int32), k)), pa.array(np.full(k * c, m.n)), deviation, pa.array(m.whitened(x).ravel()), pa.array(np.tile(m.share, k)), pa.array(np.full(k * c, error[d]))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return rows.mapInArrow(result, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


_SPREAD = "dim int, n long, mean binary, m2 binary"


def _spread_rows(found: dict[int, tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    parts = (pa.array([f[k].tobytes() for f in found.values()], pa.binary()) for k in (1, 2))
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array([f[0] for f in found.values()], pa.int64()), *parts], names=["dim", "n", "mean", "m2"])


def _spread_of_all(group: pa.Table) -> pa.Table:
    """The spreads of all partitions, of at most COMPONENTS ** 2 numbers each, as one."""
    total = None
    for r in group.to_pylist():
        mean = np.frombuffer(r["mean"])
        total = _joined_spread(total, (r["n"], mean, np.frombuffer(r["m2"]).reshape(len(mean), -1)))
    return pa.Table.from_batches([_spread_rows({group.column("dim")[0].as_py(): total})])


def _joined_spread(a: tuple[int, np.ndarray, np.ndarray] | None, b: tuple[int, np.ndarray, np.ndarray]) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and centred inner products of two sets of rows together."""
    if a is None:
        return b
    n, apart = a[0] + b[0], b[1] - a[1]
    return n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart) * (a[0] / n * b[0])
