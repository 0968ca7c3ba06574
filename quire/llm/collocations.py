"""Phrases of words that stand together far more often than chance, by suffix automata of shards.

A shard is a few million characters of one language. The states of its generalised suffix automaton
are built by naming: the strings of k words that end at a position are named by the name of the string
of k - 1 words before and the last word, so a name is a set of end positions, its size the endpos
count, and its suffix link the name of the string without its first word. Depth is bounded, and a
string is extended only along words, pairs and triples that may be frequent: a first round of automata of
depth two and a second of depth three, reduced over all shards, tell which are. What every shard counts in
the last round is added up over all shards, so nothing rare is written by it however large the input is. Its
tasks are as many as the cores ask for, not as the input has splits, and each adds up its own shards first:
what it writes follows the number of frequent strings, not that times the shards.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.key_filter import key_filter, passes
from quire.llm.runtime import drop_written, small_batches, written
from quire.llm.words import mix

DEPTH = 5
LEAST = 100
TOP = 2000
#: Bytes of text in a shard; a longer text is a shard of its own.
SHARD = 12_000_000
#: Bits of the filter of frequent words, pairs and triples, whatever the input, a multiple of 65536: 4 MB. Wrong hits only cost work.
FILTER_BITS = 1 << 25
#: Tasks of the last round for each core, and different strings that one of them holds before it writes their counts.
TASKS_PER_CORE, HELD = 2, 300_000
#: Parts of a language whose best phrases are told before those of all.
_PARTS = 32
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_ENDS = b".,;:!?\x0b\x0c\r"
_FOLD = bytes.maketrans(_UPPER + _ENDS, _UPPER.lower() + b"\n" * len(_ENDS))
_ODD = mix(np.arange(7, 12)) | np.uint64(1)


class Shard:
    """The words of texts of one language: distinct words, and per occurrence its word and whether the
    next one stands in the same piece."""

    def __init__(self, lang: str, texts: list[bytes]) -> None:
        self.lang = lang
        data = b"\n".join(texts).translate(_FOLD)
        words = np.array(data.split(), dtype=object)
        self.ids, self.words = pd.factorize(words)
        self.ids = self.ids.astype(np.int64)
        x = np.frombuffer(data, np.uint8)
        blank = (x == 10) | (x == 32) | (x == 9)
        starts = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
        if len(x) and not blank[0]:
            starts = np.concatenate(([0], starts))
        ends = np.flatnonzero(x == 10)
        piece = np.searchsorted(ends, starts)
        self.joined = piece[1:] == piece[:-1]

    def word_keys(self) -> np.ndarray:
        """64 bits of every distinct word of this language, the same in every process."""
        seed = xxhash.xxh3_64_intdigest(self.lang.encode("utf-8", "surrogatepass"))
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self.words), np.uint64, len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of neighbours within a piece: at which first words, the distinct pairs (first word times
        number of words plus second word), and which of them each is."""
        at = np.flatnonzero(self.joined)
        code, which = np.unique(self.ids[at] * len(self.words) + self.ids[at + 1], return_inverse=True)
        return at, code, which

    def keyed(self) -> tuple[np.ndarray, np.ndarray]:
        """The states of depth one and two: (key, endpos count) of every word and every pair."""
        words = self.word_keys()
        _, code, which = self.pairs()
        counts = np.bincount(self.ids, minlength=len(words)), np.bincount(which, minlength=len(code))
        return np.concatenate((words, pair_keys(words, code))), np.concatenate(counts)

    def linked(self, frequent: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The last words of the pairs whose two words stand together often enough to pass the filter."""
        at, code, which = self.pairs()
        return at[passes(frequent, pair_keys(words, code))[which]] + 1

    def triples(self, ends: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The states of depth three over pairs that pass, given by their last words: an end of each distinct
        triple, which of them every occurrence is, the ends of these, and the keys."""
        pair = np.zeros(len(self.ids) + 1, bool)
        pair[ends] = True
        ends = ends[pair[ends - 1]]
        # A pair within the shard by its place among the pairs that pass, then the third word.
        _, named = np.unique(self.ids[ends - 2] * len(words) + self.ids[ends - 1], return_inverse=True)
        _, first, which = np.unique(named * len(words) + self.ids[ends], return_index=True, return_inverse=True)
        at = ends[first]
        keys = mix(words[self.ids[at - 2]] * _ODD[2] + words[self.ids[at - 1]] * _ODD[3] + words[self.ids[at]] * _ODD[4])
        return at, which, ends, keys

    def keyed_triples(self, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(key, endpos count) of every triple of words whose pairs pass the filter."""
        words = self.word_keys()
        _, which, _, keys = self.triples(self.linked(frequent, words), words)
        return keys, np.bincount(which, minlength=len(keys))

    def states(self, frequent: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The states of depth 1 to DEPTH whose words, pairs and triples of words all pass the filter:
        (length, an end position of each, its endpos count)."""
        words = self.word_keys()
        used = passes(frequent, words)
        counts = np.bincount(self.ids, minlength=len(words))
        _, first = np.unique(self.ids, return_index=True)
        yield 1, first[used], counts[used]
        alive = self.linked(frequent, words)  # ends of strings of two words
        _, which, ends, keys = self.triples(alive, words)
        goes_on = np.zeros(len(self.ids) + 1, bool)
        goes_on[ends[passes(frequent, keys)[which]]] = True
        name = self.ids.copy()
        for length in range(2, DEPTH + 1):
            if not len(alive):
                return
            _, first, named, n = np.unique(name[alive - 1] * len(self.words) + self.ids[alive], return_index=True, return_inverse=True, return_counts=True)
            yield length, alive[first], n
            name[alive] = named  # read at the next length only where a string of this length ends
            nxt = alive + 1
            alive = nxt[goes_on[nxt]]

    def text(self, end: int, length: int) -> bytes:
        return b" ".join(self.words[self.ids[end - length + 1 : end + 1]])


def pair_keys(words: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(words[code // max(1, len(words))] * _ODD[0] + words[code % max(1, len(words))] * _ODD[1])


def shards(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[Shard]:
    """The (lang, text) of a task in shards of one language each; so many bytes are held at most, besides a
    text that is longer itself."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in small_batches(batches, 1):
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if not text:
                continue
            data = text.encode("utf-8", "surrogatepass")
            held.setdefault(lang, []).append(data)
            sizes[lang] = sizes.get(lang, 0) + len(data) + 1
            while sum(sizes.values()) > most_bytes:
                most = max(sizes, key=sizes.__getitem__)
                del sizes[most]
                yield Shard(most, held.pop(most))
    for lang in list(held):
        yield Shard(lang, held.pop(lang))


def _count_rows(held: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
    for lang, counts in held.items():
        phrase = list(counts)
        length = np.fromiter((p.count(b" ") + 1 if p else 0 for p in phrase), np.int32, len(phrase))
        columns = [pa.array([lang] * len(phrase), pa.string()), pa.array(phrase, pa.binary()).cast(pa.string()), pa.array(length), pa.array(counts.values(), pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "length", "f"])


def added_up(found: Iterator[Shard], frequent: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, length, f) of the states of all shards of a task together; phrase "" of length 0 is the
    number of words. Once more than ``most`` strings are held they are written and begun anew."""
    held: dict[str, dict[bytes, int]] = {}
    for shard in found:
        own = held.setdefault(shard.lang, {})
        own[b""] = own.get(b"", 0) + len(shard.ids)
        for length, ends, counts in shard.states(frequent):
            for end, n in zip(ends.tolist(), counts.tolist(), strict=True):
                phrase = shard.text(end, length)
                own[phrase] = own.get(phrase, 0) + n
        if sum(map(len, held.values())) > most:
            yield from _count_rows(held)
            held = {}
    yield from _count_rows(held)


def _phrases(frame: DataFrame, least: int, shard_bytes: int, filter_bits: int) -> DataFrame:
    """(lang, phrase, length, f): how often each phrase stands in all texts, exactly, of all phrases of up
    to DEPTH words that occur ``least`` times. Length 0 is the number of words."""

    def frequent(keyed: Callable[[Shard], tuple[np.ndarray, np.ndarray]], label: str) -> DataFrame:
        """The keys that occur often enough in all shards together."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard in shards(batches, shard_bytes):
                found, n = keyed(shard)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

        counted = frame.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return written(counted.where(F.col("n") >= least).select("key"), label)

    context = frame.sparkSession.sparkContext
    short = frequent(lambda shard: shard.keyed(), "frequent-pairs")
    first = context.broadcast(key_filter(short, filter_bits))
    longer = frequent(lambda shard: shard.keyed_triples(first.value), "frequent-triples")
    bits = context.broadcast(key_filter(short.union(longer), filter_bits))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return added_up(shards(batches, shard_bytes), bits.value, HELD)

    tasks = TASKS_PER_CORE * context.defaultParallelism
    counted = frame.coalesce(tasks).mapInArrow(rows, "lang string, phrase string, length int, f long").groupBy("lang", "phrase", "length").agg(F.sum("f").alias("f"))
    out = written(counted.where((F.col("f") >= least) | (F.col("length") == 0)), "phrases")
    drop_written(short)
    drop_written(longer)
    return out


def exact_score() -> Column:
    """floor(1000 * a * n / (l * r)) of whole numbers, whose products have up to 38 digits."""
    a, n, left, right = (f"CAST({c} AS DECIMAL(19, 0))" for c in ("a", "n", "l", "r"))
    return F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * {a} * {n}) div ({left} * {right})").alias("score")


def _joined(words: Column, first: int | Column, n: Column) -> Column:
    return F.array_join(F.slice(words, first, n), " ")


def _best(scored: DataFrame, by: list[str], top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def collocations(documents: DataFrame, least: int = LEAST, top: int = TOP, shard_bytes: int = SHARD, filter_bits: int = FILTER_BITS) -> DataFrame:
    """The ``top`` best phrases of two to DEPTH words of every language, of (lang, text).

    A-Z are lower-cased; pieces end at ``.,;:!?`` and at line ends, words at blanks and tabs. A phrase counts
    if it occurs ``least`` times within pieces, overlaps included. Its score is the least, over the places where
    it may be cut in two, of floor(1000 * a * n / (l * r)): a, l, r are how often it and its two parts occur
    and n is the number of words of the language; of equal cuts the first counts. A phrase that stands in a
    longer one (of at most DEPTH words) as often as by itself is left out: since counts fall along suffix
    links and from a string to what extends it, longer ones by one word tell that. One row per phrase: lang,
    rank, phrase, a, l, r, n, score. Counts and products are exact.

    Null and empty texts have no words, a null lang is ``und``; rows are not told apart by doc_id, and
    repeated rows count as often as they stand there. An empty table gives no rows. Further columns are
    ignored. Ties in score and a go by the UTF-8 bytes of the phrase.
    """
    frame = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string").alias("text"))
    found = _phrases(frame, least, shard_bytes, filter_bits)
    sums = found.where("length = 0").select("lang", F.col("f").alias("n"))
    phrases = found.where("length > 0")
    words = F.split("phrase", " ", -1)
    longer = phrases.where("length > 2").select("lang", F.col("f").alias("above"), F.col("length").alias("_n"), words.alias("_w"))
    inner = F.explode(F.array(_joined(F.col("_w"), 2, F.col("_n") - 1), _joined(F.col("_w"), 1, F.col("_n") - 1)))
    within = longer.select("lang", inner.alias("phrase"), "above").groupBy("lang", "phrase").agg(F.max("above").alias("above"))
    candidates = phrases.where("length > 1").join(within.hint("merge"), ["lang", "phrase"], "left").where(F.col("above").isNull() | (F.col("above") < F.col("f")))
    cuts = candidates.select("lang", "phrase", F.col("f").alias("a"), "length", words.alias("_w"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", _joined(F.col("_w"), 1, F.col("cut")).alias("left"), _joined(F.col("_w"), F.col("cut") + 1, F.col("length") - F.col("cut")).alias("right")
    )
    parts = phrases.select("lang", F.col("phrase").alias("part"), F.col("f"))
    both = cuts.join(parts.withColumnsRenamed({"part": "left", "f": "l"}).hint("merge"), ["lang", "left"]).join(parts.withColumnsRenamed({"part": "right", "f": "r"}).hint("merge"), ["lang", "right"])
    scored = both.join(sums, "lang").withColumn("score", exact_score())
    least = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("x")).select("lang", "phrase", "x.score", "x.a", "x.l", "x.r", "x.n")
    parted = _best(least.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))), ["lang", "_part"], top)
    return _best(parted.drop("rank", "_part"), ["lang"], top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
