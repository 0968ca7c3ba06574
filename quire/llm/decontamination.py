"""Benchmark decontamination with spaced seeds.

A seed hashes the words at fixed positions of a short span and ignores the others, so a substituted
word between them does no harm. Seeds of the benchmark are joined with those of the documents: a filter
of fixed size says which seeds of a document may be among them, so the documents are read once whatever
the benchmark's size and only what may meet is shuffled. Of every text and item that share a seed the
diagonals with hits are compared word by word, substitutions allowed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.jaccard_join import with_digest
from quire.llm.key_filter import key_filter, passes
from quire.llm.runtime import small_batches, written
from quire.llm.words import mix, word_blocks

#: An overlap is a window of WINDOW words of which EQUAL are equal, place by place.
WINDOW, EQUAL = 13, 11
#: Any window of 13 words with two substitutions holds a placement of one of these free of both.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 4, 5, 6, 7))
#: Bits of the filters of seeds and of texts that are broadcast, whatever the input: 4 MB.
FILTER_BITS = 1 << 25
#: Pairs of words that are compared at once.
CELLS = 1_000_000
SCHEMA = "doc_id long, item_id long, doc_start int, item_start int, n_words int, n_equal int"
_ODD = mix(np.arange(1, 2 * WINDOW)) | np.uint64(1)
_FOUND = pa.schema([("t1", pa.int64()), ("t2", pa.int64()), ("item_id", pa.int64())] + [(n, pa.int32()) for n in ("doc_start", "item_start", "n_words", "n_equal")])


def seeds(h: np.ndarray, at: tuple[int, ...], salt: int) -> np.ndarray:
    """Seed hashes of all placements of a mask in a run of words."""
    n = len(h) - at[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k, o in enumerate(at):
        out += h[o : o + n] * _ODD[k]
    return mix(out)


def masks_of(n_words: int) -> tuple[tuple[int, ...], ...]:
    """The masks by which an item of so many words is looked for; short items must occur whole."""
    return MASKS if n_words >= WINDOW else (tuple(range(n_words)),) if n_words else ()


def item_seeds(h: np.ndarray) -> np.ndarray:
    """The distinct seeds of one item."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(seeds(h, m, len(m)) for m in masks_of(len(h)))]))


class Text:
    """The words of one text, with its seeds in order, made when an item asks for them."""

    def __init__(self, h: np.ndarray) -> None:
        self.h = h
        self.sorted: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}

    def by_seed(self, mask: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        if mask not in self.sorted:
            s = seeds(self.h, mask, len(mask))
            order = np.argsort(s, kind="stable")
            self.sorted[mask] = s[order], order
        return self.sorted[mask]

    def diagonals(self, w: np.ndarray) -> np.ndarray:
        """Place in the text less place in the item, of all hits. Where there are more hits than diagonals,
        as repetitive texts have, it is all diagonals: hits are never multiplied out beyond that."""
        n, m = len(self.h), len(w)
        spans, total = [], 0
        for mask in masks_of(m):
            s, order = self.by_seed(mask)
            own = seeds(w, mask, len(mask))
            lo, hi = np.searchsorted(s, own, "left"), np.searchsorted(s, own, "right")
            spans.append((order, lo, hi))
            total += int((hi - lo).sum())
        if total > 2 * (n + m):
            return np.arange(1 - m, n)
        found = [np.zeros(0, np.int64)]
        for order, lo, hi in spans:
            size = hi - lo
            q = np.repeat(np.arange(len(lo)), size)
            p = order[np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            found.append(p - q)
        return np.unique(np.concatenate(found))

    def overlap(self, w: np.ndarray) -> tuple[int, int, int, int] | None:
        """(start in text, start in item, words, equal words) of the best diagonal, if one overlaps."""
        n, m = len(self.h), len(w)
        window, least = (WINDOW, EQUAL) if m >= WINDOW else (m, m)
        if not m or n < window:
            return None
        all_diagonals = self.diagonals(w)
        best, rows, q = None, max(1, CELLS // m), np.arange(m)
        starts = np.arange(m - window + 1)
        for k in range(0, len(all_diagonals), rows):
            d = all_diagonals[k : k + rows, None]
            at = d + q
            equal = (self.h[np.clip(at, 0, n - 1)] == w) & (at >= 0) & (at < n)
            sums = np.zeros((len(d), m + 1), np.int32)
            np.cumsum(equal, axis=1, out=sums[:, 1:])
            good = (sums[:, window:] - sums[:, :-window] >= least) & (starts >= -d) & (starts + window <= n - d)
            some = np.flatnonzero(good.any(1))
            if not len(some):
                continue
            good, equal, d = good[some], equal[some], d[some, 0]
            steps = np.zeros((len(some), m + 1), np.int32)
            steps[:, : m - window + 1] += good
            steps[:, window:] -= good
            inside = np.cumsum(steps, axis=1)[:, :m] > 0
            n_equal, first = (equal & inside).sum(1), good.argmax(1)
            order = np.lexsort((first, first + d, -n_equal))[0]
            row = (int(n_equal[order]), -int(first[order] + d[order]), -int(first[order]), int(inside[order].sum()))
            best = row if best is None or row > best else best
        return None if best is None else (-best[1], -best[2], best[3], best[0])


def _binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def _items(benchmark: DataFrame) -> DataFrame:
    """(item_no, item_id, words, seeds) of every different text of the benchmark that has words."""
    rows = benchmark.where("text is not null").groupBy(F.col("text").cast("string").alias("text")).agg(F.min(F.col("item_id").cast("long")).alias("item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            for first, last, h, counts in word_blocks(batch.column(1).to_pylist()):
                words = np.split(h, np.cumsum(counts)[:-1])
                found = pa.array([item_seeds(w).view(np.int64) for w in words], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), _binary(words), found], names=["item_id", "words", "seeds"])

    made = rows.select("item_id", "text").mapInArrow(run, "item_id long, words binary, seeds array<long>").where("size(seeds) > 0")
    return written(made.withColumn("item_no", F.monotonically_increasing_id()), "items")


def _touched(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, words, seeds) of the rows whose text has seeds that may be of an item; t1 and t2
    tell texts apart. One read of the documents."""
    context = documents.sparkSession.sparkContext
    bits = context.broadcast(key_filter(items.select(F.explode("seeds").alias("seed")), FILTER_BITS))
    # At most WINDOW - 1 different lengths are whole masks.
    lengths = [r["n"] for r in items.select((F.length("words") / 8).cast("int").alias("n")).where(F.col("n") < WINDOW).distinct().collect()]
    masks = [m for n in (WINDOW, *sorted(lengths)) for m in masks_of(n)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3):
            for first, _, h, counts in word_blocks(batch.column(3).to_pylist()):
                last = np.cumsum(counts)
                text_of = np.repeat(np.arange(len(counts)), counts)
                texts, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                for mask in masks:
                    own = seeds(h, mask, len(mask))
                    p = np.flatnonzero(passes(bits.value, own))
                    p = p[p + mask[-1] < last[text_of[p]]]
                    texts.append(text_of[p])
                    found.append(own[p])
                text, seed = np.concatenate(texts), np.concatenate(found)
                order = np.lexsort((seed, text))
                text, seed = text[order], seed[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (seed[1:] != seed[:-1])
                text, seed = text[new], seed[new]
                which, at = np.unique(text, return_index=True)
                if not len(which):
                    continue
                rows = batch.take(pa.array(first + which)).select([0, 1, 2])
                own_words = [h[last[t] - counts[t] : last[t]] for t in which]
                own_seeds = pa.array([s.view(np.int64) for s in np.split(seed, at[1:])], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, _binary(own_words), own_seeds], names=["doc_id", "t1", "t2", "words", "seeds"])

    source = with_digest(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), F.col("text").cast("string").alias("text"))
    return written(source.mapInArrow(run, "doc_id long, t1 long, t2 long, words binary, seeds array<long>"), "touched")


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The overlaps of a sorted stream in which the words of a text (item_no -1) go before those of the items
    it may overlap; one text is held at a time."""
    key, text = None, None
    for batch in batches:
        rows = []
        for t1, t2, item_no, item_id, words in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            h = np.frombuffer(words, np.uint64)
            if item_no < 0:
                key, text = (t1, t2), Text(h)
            elif key == (t1, t2) and (best := text.overlap(h)):
                rows.append((t1, t2, item_id, *best))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FOUND, strict=True)], schema=_FOUND)


def _overlaps(touched: DataFrame, items: DataFrame) -> DataFrame:
    """(t1, t2, item_id, doc_start, item_start, n_words, n_equal) of every different text and item."""
    n = int(touched.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = touched.select("t1", "t2", "words", "seeds").dropDuplicates(["t1", "t2"])
    met = texts.select("t1", "t2", F.explode("seeds").alias("seed")).join(items.select("item_no", F.explode("seeds").alias("seed")), "seed")
    pairs = met.select("t1", "t2", "item_no").distinct().join(items.select("item_no", "item_id", "words"), "item_no").select("t1", "t2", "item_no", "item_id", "words")
    own = texts.select("t1", "t2", F.lit(-1).cast("long").alias("item_no"), F.lit(None).cast("long").alias("item_id"), "words")
    # Dealt by an expression: a repartition by the columns by which both sides of the union lie already is left
    # out by Spark, and the sides' partitions, once merged by size, need not match; texts would lie apart from items.
    dealt = own.unionByName(pairs).repartition(n, F.xxhash64("t1", "t2"))
    return dealt.sortWithinPartitions("t1", "t2", "item_no").mapInArrow(
        _verified, "t1 long, t2 long, item_id long, doc_start int, item_start int, n_words int, n_equal int"
    )


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Overlaps of every whole text of (doc_id, text) with every item of (item_id, text).

    One row per row of ``documents`` and item with an overlap: doc_id, item_id, doc_start and
    item_start (in words), n_words (in windows of WINDOW words with at least EQUAL equal, one by one)
    and n_equal, for the diagonal with the most equal words. Items of fewer than WINDOW words must
    occur whole, down to those of one word; items without words (null, empty) overlap nothing; of equal
    items the least item_id is named. Null and empty texts have no overlap; null and repeated doc_ids
    are carried as they are; empty tables give no rows; further columns are ignored.
    """
    items = _items(benchmark)
    touched = _touched(documents, items)
    found = written(_overlaps(touched, items), "overlaps").withColumnsRenamed({"t1": "c1", "t2": "c2"})
    rows = touched.select("doc_id", "t1", "t2").join(found, (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")))
    return rows.select("doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal")


def decontaminate(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` without an overlap, with all their columns.

    Every row is judged by its text, whatever its doc_id; the cases of ``contaminated`` hold here too. A
    filter of fixed size lets most rows pass where they are read; only those whose text may be among the
    overlapping ones are joined with them."""
    columns = documents.columns
    items = _items(benchmark)
    bad = written(_overlaps(_touched(documents, items), items).select("t1", "t2").distinct(), "overlapping")
    bits = documents.sparkSession.sparkContext.broadcast(key_filter(bad.select("t1"), FILTER_BITS))

    def part(doubtful: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                t1 = batch.column(batch.num_columns - 2).to_numpy().view(np.uint64)
                yield batch.filter(pa.array(passes(bits.value, t1) == doubtful))

        return run

    marked = with_digest(documents)
    keyed = marked.select(*columns, F.col("_t1"), F.col("_t2"))
    clean = keyed.mapInArrow(part(False), keyed.schema).select(*columns)
    doubt = keyed.mapInArrow(part(True), keyed.schema)
    kept = doubt.join(bad, (F.col("_t1") == F.col("t1")) & (F.col("_t2") == F.col("t2")), "left_anti").select(*columns)
    return clean.unionByName(kept)
