"""Removal of repeated byte strings with a content-defined difference cover of the suffixes.

A difference cover samples positions so that any two equal strings of the given length hold a sampled
position at the same offset. Here the sample is chosen by content: every window of ``LENGTH`` bytes
names the place of its least gram hash. Sampled suffixes are named by their gram and by the context
that all windows naming them span. Equal names settle whole contexts at once; what remains are the
contexts at the edges of a repeat. Their windows, the suffixes that start off the sample, are merged
in the order of their hashes and neighbours are compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import drop_written, small_batches, whole_groups, written
from quire.llm.words import mix, powers

LENGTH = 200
#: Bytes of a gram. Every window of LENGTH bytes has SPAN grams.
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Contexts of one name that one task compares; names with more are dealt to several tasks.
CROWD = 20_000
_BLOCK = 600_000
_LOW = np.uint64(0xFFFFFFFF)


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all strings of ``width`` bytes."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint64(1)) * up[: len(data)], out=total[1:])
    n = len(data) - width + 1
    return mix((total[width:] - total[:n]) * down[:n])


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(x)
    blocks = -(-n // width)
    grid = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    grid[:n] = x
    grid = grid.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def sample(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, place, first, last, gram hash) of the sampled places in texts data[bounds[k]:bounds[k+1]]:
    the windows that start at first..last, counted in data, name the place."""
    if len(data) < LENGTH:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),)
    grams = window_hashes(data, GRAM)
    key = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    place = (sliding_least(key, SPAN) & _LOW).astype(np.int64)
    starts = np.arange(len(place))
    text = np.searchsorted(bounds, starts, "right") - 1
    valid = starts + LENGTH <= bounds[text + 1]
    new = valid.copy()
    new[1:] &= ~valid[:-1] | (place[1:] != place[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(new)
    stop = valid.copy()
    stop[:-1] &= ~valid[1:] | new[1:]
    return text[first], place[first], first, np.flatnonzero(stop), grams[place[first]]


def _runs(data: np.ndarray, text: np.ndarray, first: np.ndarray, last: np.ndarray, gram: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal neighbouring contexts start, and how many each has.

    Text of a short period samples a place per period, all with one name and one context; such a run repeats
    itself, so it is one row, however long it is. Neighbours count as equal if their bytes are."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    near = np.flatnonzero((text[1:] == text[:-1]) & (gram[1:] == gram[:-1]) & (context[1:] == context[:-1]) & (first[1:] == last[:-1] + 1) & (last[1:] - first[1:] == last[:-1] - first[:-1]))
    view = memoryview(data)
    same = [view[first[k] : last[k] + LENGTH] == view[first[k + 1] : last[k + 1] + LENGTH] for k in near.tolist()]
    new = np.ones(len(first), bool)
    new[near[np.array(same, bool)] + 1] = False
    starts = np.flatnonzero(new)
    return starts, np.diff(np.append(starts, len(first)))


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, list[bytes]]]:
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        b = (t or "").encode("utf-8", "surrogatepass")
        if held and size + len(b) > _BLOCK:
            yield first, held
            first, held, size = k, [], 0
        held.append(b)
        size += len(b)
    if held:
        yield first, held


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_batches(batches, 2):
        docs, hashes = batch.column(0), batch.column(1)
        for at, held in _blocks(batch.column(2).to_pylist()):
            whole = b"".join(held)
            bounds = np.concatenate(([0], np.cumsum([len(b) for b in held])))
            text, place, first, last, gram = sample(np.frombuffer(whole, np.uint8), bounds)
            view, digest = memoryview(whole), xxhash.xxh3_64_intdigest
            context = np.fromiter((digest(view[i : j + LENGTH], p - i) for p, i, j in zip(place.tolist(), first.tolist(), last.tolist(), strict=True)), np.uint64, len(first))
            new, times = _runs(np.frombuffer(whole, np.uint8), text, first, last, gram, context)
            ends = last[np.append(new[1:], len(first)) - 1] if len(new) else last
            text, first, last, gram, context = (x[new] for x in (text, first, last, gram, context))
            row, base = pa.array(at + text), bounds[text]
            yield pa.RecordBatch.from_arrays(
                [docs.take(row), hashes.take(row), *(pa.array((x - base).astype(np.int32)) for x in (first, last, ends)), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(times)],
                names=["doc", "hash", "first", "last", "run_last", "gram", "context", "times"],
            )


def _context_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the wanted contexts of each document."""
    for batch in small_batches(batches, 1):
        rows: list[tuple] = []
        for doc, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            for w in wanted:
                cut = data[w["first"] : w["last"] + LENGTH]
                rows.append((doc, w["hash"], w["first"], w["gram"], w["edge"], w["crowd"], xxhash.xxh3_64_intdigest(cut) % -(-w["crowd"] // CROWD), cut))
            if len(rows) > 20_000:
                yield _rows(rows)
                rows = []
        yield _rows(rows)


_CONTEXT = "doc long, hash long, first int, gram long, edge boolean, crowd long, salt long, bytes binary"
_CONTEXT_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _CONTEXT_TYPES]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _CONTEXT_TYPES, strict=True)], names=[x.split()[0] for x in _CONTEXT.split(", ")])


def repeated_windows(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the windows at ``starts`` equal another one: sorted by hash, neighbours compared."""
    h = window_hashes(data, LENGTH)[starts]
    order = np.argsort(h, kind="stable")
    h = h[order]
    out = np.zeros(len(starts), bool)
    near = np.flatnonzero(h[1:] == h[:-1])
    windows = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    same = np.zeros(len(near), bool)
    for k in range(0, len(near), 20_000):
        part = near[k : k + 20_000]
        same[k : k + 20_000] = (windows[starts[order[part]]] == windows[starts[order[part + 1]]]).all(1)
    out[order[near[same]]] = True
    out[order[near[same] + 1]] = True
    return out


def _edge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated spans of edge contexts; for crowded names also the hashes of windows left open."""
    for table in whole_groups(batches, ["gram", "salt"]):
        parts = table.column("bytes").to_pylist()
        sizes = np.array([len(p) for p in parts])
        data = np.frombuffer(b"".join(parts), np.uint8)
        begin = np.cumsum(sizes) - sizes
        n = sizes - LENGTH + 1
        owner = np.repeat(np.arange(len(parts)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        starts = begin[owner] + inner
        hit = repeated_windows(data, starts)
        edge = table.column("edge").to_numpy(zero_copy_only=False)[owner]
        crowded = (table.column("crowd").to_numpy() > CROWD)[owner]
        at = table.column("first").to_numpy()[owner] + inner
        found = hit & edge
        cut = np.concatenate(([True], (owner[1:] != owner[:-1]) | ~found[:-1]))
        stop = np.concatenate(((owner[1:] != owner[:-1]) | ~found[1:], [True]))
        i, j = np.flatnonzero(found & cut), np.flatnonzero(found & stop)
        open_ = np.flatnonzero(crowded)
        h1 = window_hashes(data, LENGTH)[starts[open_]] if len(open_) else np.zeros(0, np.uint64)
        view = memoryview(data)
        h2 = np.fromiter((xxhash.xxh3_64_intdigest(view[s : s + LENGTH]) for s in starts[open_].tolist()), np.uint64, len(open_))
        rows = pa.array(np.concatenate((owner[i], owner[open_])))
        none = np.full(len(i), 0, np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                table.column("doc").combine_chunks().take(rows),
                table.column("hash").combine_chunks().take(rows),
                pa.array(np.concatenate((at[i], at[open_])).astype(np.int32)),
                pa.array(np.concatenate((at[j], at[open_])).astype(np.int32)),
                pa.array(np.concatenate((none, h1)).view(np.int64)),
                pa.array(np.concatenate((none, h2)).view(np.int64)),
                pa.array(np.concatenate((np.zeros(len(i), bool), np.ones(len(open_), bool)))),
                pa.array(np.concatenate((np.ones(len(i), bool), edge[open_]))),
            ],
            names=["doc", "hash", "first", "last", "h1", "h2", "open", "edge"],
        )


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in small_batches(batches, 1):
        sizes, spans, kept = [], [], []
        for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            sizes.append(len(data))
            if not found:
                spans.append([])
                kept.append(data)
                continue
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, [x["first"] for x in found], 1)
            np.add.at(depth, [x["last"] + LENGTH for x in found], -1)
            gone = np.cumsum(depth)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).view(np.int8)))
            spans.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
            kept.append(np.frombuffer(data, np.uint8)[~gone].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def _key(doc: Column, text: Column) -> tuple[Column, Column]:
    """A row by its doc_id and the hash of its text; rows equal in both have the same result."""
    return F.coalesce(doc, F.lit(-1)), F.xxhash64(text)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """Remove every byte covered by a string of LENGTH bytes that also starts anywhere else.

    Works on every whole text of (doc_id, text) as UTF-8; matches never cross texts; all occurrences
    go, overlaps count, and strings are judged on the input. Returns per row doc_id, n_bytes, spans
    (maximal removed runs, in bytes, end exclusive) and kept (the remaining bytes). Null and empty
    texts and those under LENGTH bytes keep all; null and repeated doc_ids are carried as they are,
    and a repeated row counts as another place; further columns are ignored.
    """
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    source = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    doc, text_hash = _key(F.col("doc_id"), F.col("text"))
    sampled = source.where(F.length("text") > 0).select(doc.alias("doc"), text_hash.alias("hash"), "text").mapInArrow(
        _sample_rows, "doc long, hash long, first int, last int, run_last int, gram long, context long, times long"
    )
    sampled = written(sampled, "sampled")
    names = sampled.groupBy("gram").agg(F.sum("times").alias("n"), F.min("context").alias("least"), F.max("context").alias("most")).where("n > 1")
    # Written first, so that both sides of the join are shuffled for it and a common gram can be split.
    names = written(names.select("gram", (F.col("least") == F.col("most")).alias("alike")), "names")
    shared = written(sampled.join(names.hint("merge"), "gram"), "shared")
    here = F.struct("doc", "hash", "first", "last")
    contexts = shared.where("not alike").groupBy("gram", "context").agg(F.sum("times").alias("n"), F.min(here).alias("at"))
    contexts = written(contexts, "contexts")
    drop_written(sampled)
    crowds = contexts.groupBy("gram").agg(F.count("*").alias("crowd"), F.count_if(F.col("n") == 1).alias("edges")).where("edges > 0")
    crowds = written(crowds, "crowds")
    wanted = contexts.join(crowds.hint("merge"), "gram").select(
        F.col("at.doc").alias("w_doc"), F.struct("at.hash", "at.first", "at.last", "gram", (F.col("n") == 1).alias("edge"), "crowd").alias("w")
    )
    by_doc = written(wanted.groupBy("w_doc", F.col("w.hash").alias("w_hash")).agg(F.collect_list("w").alias("wanted")), "wanted")
    settled = ("doc", "hash", "first", F.col("run_last").alias("last"))  # all contexts of a run, which has one row
    alike = shared.where("alike").select(*settled)
    equal = shared.where("not alike").join(contexts.where("n > 1").select("gram", "context").hint("merge"), ["gram", "context"]).select(*settled)
    taken = source.join(by_doc.hint("merge"), (doc == F.col("w_doc")) & (text_hash == F.col("w_hash"))).select(doc.alias("doc"), "text", "wanted")
    edges = written(
        taken.mapInArrow(_context_rows, _CONTEXT).repartition(n, "gram", "salt").sortWithinPartitions("gram", "salt").mapInArrow(
            _edge_rows, "doc long, hash long, first int, last int, h1 long, h2 long, open boolean, edge boolean"
        ),
        "edges",
    )
    still_open = edges.where("open")
    again = still_open.groupBy("h1", "h2").agg(F.count("*").alias("n")).where("n > 1").select("h1", "h2")
    late = still_open.where("edge").join(again.hint("merge"), ["h1", "h2"]).select("doc", "hash", "first", "last")
    spans = alike.unionByName(equal).unionByName(edges.where("not open").select("doc", "hash", "first", "last")).unionByName(late)
    found = spans.groupBy(F.col("doc").alias("s_doc"), F.col("hash").alias("s_hash")).agg(F.collect_set(F.struct("first", "last")).alias("found"))
    joined = source.join(found.hint("merge"), (doc == F.col("s_doc")) & (text_hash == F.col("s_hash")), "left").select("doc_id", "text", "found")
    return joined.mapInArrow(_remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
