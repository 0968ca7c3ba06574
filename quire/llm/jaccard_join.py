"""Similarity self-join on word shingles with Bayesian pruning of MinHash candidates.

Exact copies are one text. MinHash bands propose candidates; within a bucket signatures are compared a
few values at a time, and a pair is dropped as soon as the posterior probability that its similarity
reaches the threshold falls below a tolerance. What remains is gathered by connected component, where
every surviving pair is verified on the whole shingle sets. Large buckets and components are split
into pairs of blocks, so a task never holds more than two blocks; pairs stay inside the arrays of a
task and are counted, never emitted, so the rows between stages grow with the documents.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import components, drop_written, small_batches, whole_groups, written
from quire.llm.words import mix, word_blocks

SHINGLE, THRESHOLD = 5, 0.8
#: A pair at the threshold is missed by all bands with probability (1 - 0.8**4)**25 < 2e-6.
BANDS, ROWS = 25, 4
HASHES = BANDS * ROWS
TOLERANCE = 1e-6
STEP = 10
#: Members of a bucket or component that one task compares at once.
BLOCK = 1000

_rng = np.random.default_rng(20240229)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_ODD = mix(np.arange(1, SHINGLE + 1)) | np.uint64(1)
_BAND = mix(np.arange(100, 100 + ROWS)) | np.uint64(1)


def shingle_sets(h: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingles of each text; a text of one to four words has one, of none none."""
    if len(h) >= SHINGLE:
        n = len(h) - SHINGLE + 1
        s = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            s += h[k : k + n] * _ODD[k]
        s = mix(s)
    out, at = [], 0
    for c in counts.tolist():
        if c >= SHINGLE:
            out.append(np.unique(s[at : at + c - SHINGLE + 1]))
        else:
            out.append(mix((h[at : at + c] * _ODD[:c]).sum(keepdims=True, dtype=np.uint64)) if c else np.zeros(0, np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per (non-empty) set."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    if sets:
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], at)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band, different between bands."""
    s = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    return mix((s * _BAND).sum(2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


@functools.cache
def least_matches(threshold: float, tolerance: float) -> tuple[int, ...]:
    """For each number m of compared values, a multiple of STEP, the matches below which a pair goes.

    With a uniform prior the similarity after x matches of m is Beta(x + 1, m - x + 1), and the
    probability that it is at least t equals that of at most x successes in m + 1 trials of chance t."""
    out = []
    for m in range(STEP, HASHES + 1, STEP):
        below, x = 0.0, 0
        while x <= m:
            below += math.comb(m + 1, x) * threshold**x * (1 - threshold) ** (m + 1 - x)
            if below >= tolerance:
                break
            x += 1
        out.append(x)
    return tuple(out)


def likely_pairs(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs (a[k], b[k]) of signature rows survive the comparison, step by step."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int32)
    for step, least in enumerate(least_matches(THRESHOLD, TOLERANCE)):
        cut = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (sig[a[alive], cut] == sig[b[alive], cut]).sum(1)
        keep = matches >= least
        alive, matches = alive[keep], matches[keep]
        if not len(alive):
            break
    return alive


def pairs_of(block: np.ndarray, cross: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of members, or all pairs across two blocks, in pieces of bounded size."""
    n = len(block)
    left = np.flatnonzero(block == block.min()) if cross else np.arange(n)
    right = np.flatnonzero(block != block.min()) if cross else None
    rows = max(1, 100_000 // max(1, n))
    for k in range(0, len(left), rows):
        part = left[k : k + rows]
        a = np.repeat(part, len(right) if cross else n)
        b = np.tile(right if cross else np.arange(n), len(part))
        yield (a, b) if cross else (a[a < b], b[a < b])


def roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least label of each member's component when the links (a, b) are added to those that led to
    ``label``, which names each member's component by its least member."""
    members = np.arange(len(label))
    a, b = np.concatenate((members, a)), np.concatenate((label, b))
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def runs_of(table: pa.Table, keys: list[str]) -> list[tuple[int, int]]:
    n = table.num_rows
    new = np.zeros(n, bool)
    new[0] = True
    for k in keys:
        v = table.column(k).to_numpy()
        new[1:] |= v[1:] != v[:-1]
    starts = np.flatnonzero(new)
    return list(zip(starts.tolist(), [*starts[1:].tolist(), n], strict=True))


def _dealt(members: DataFrame, key: str, size: str) -> DataFrame:
    """Deal members (key, size of the key's group) to pairs of blocks: columns block and pair."""
    blocks = F.ceil(F.col(size) / BLOCK).cast("int")
    own = members.withColumn("_n", blocks).withColumn("block", F.pmod(F.xxhash64("class_id"), F.col("_n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    return own.withColumn("_o", other).withColumn("pair", F.least("block", "_o") * F.col("_n") + F.greatest("block", "_o")).withColumn("cross", F.col("_n") > 1).drop("_n", "_o", size)


def _inside(block: np.ndarray, cross: bool) -> bool:
    """Whether the pair is of two different blocks."""
    return cross and block.min() != block.max()


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signature of every row's text; null where it has no words."""
    for batch in small_batches(batches, 3):
        for first, last, h, counts in word_blocks(batch.column(3).to_pylist()):
            sets = shingle_sets(h, counts)
            sig = iter(signatures([s for s in sets if len(s)]))
            found = pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(3)), found], names=["doc_id", "t1", "t2", "sig"])


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(root, size, class_id, n_docs, text) with the shingles of each text in place of it."""
    for batch in small_batches(batches, 4):
        for first, last, h, counts in word_blocks(batch.column(4).to_pylist()):
            shingles = pa.array([s.tobytes() for s in shingle_sets(h, counts)], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(4)), shingles], names=["root", "size", "class_id", "n_docs", "shingles"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            keys = band_keys(sig)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(np.repeat(np.arange(len(sig)), BANDS))), pa.array(keys.reshape(-1))], names=["class_id", "key"]
            )


def _bucket_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Star edges of the likely pairs of each bucket."""
    for table in whole_groups(batches, ["key", "pair"]):
        ids = table.column("class_id").to_numpy()
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint32).reshape(-1, HASHES)
        block, cross = table.column("block").to_numpy(), table.column("cross").to_numpy(zero_copy_only=False)
        runs = runs_of(table, ["key", "pair"])
        src, dst = [], []
        two = np.array([i for i, j in runs if j - i == 2], np.int64)
        if len(two):
            ok = two[likely_pairs(sig, two, two + 1)]
            src.append(ids[ok])
            dst.append(ids[ok + 1])
        for i, j in runs:
            if j - i <= 2:
                continue
            root = np.arange(j - i)
            for x, y in pairs_of(block[i:j], _inside(block[i:j], bool(cross[i]))):
                ok = likely_pairs(sig[i:j], x, y)
                root = roots(root, x[ok], y[ok])
            other = np.flatnonzero(root != np.arange(j - i))
            src.append(ids[i + root[other]])
            dst.append(ids[i + other])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


def common_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of all pairs of sets, as a matrix."""
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = n[place] > 1
    member, place = member[common], np.cumsum(n > 1)[place[common]] - 1
    width, total = 1024, np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(place, kind="stable")
    member, place = member[order], place[order]
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        i, j = np.searchsorted(place, (low, low + width))
        m = np.zeros((len(sets), width), np.float32)
        m[member[i:j], place[i:j] - low] = 1
        total += m @ m.T
    return total


def intersections(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, total: np.ndarray | None) -> np.ndarray:
    """Sizes of the intersections of the sets a[k] and b[k], from the matrix where there is one."""
    if total is not None:
        return np.rint(total[a, b]).astype(np.int64)
    return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per member of a component, or of a pair of its blocks: its local root and verified links."""
    for table in whole_groups(batches, ["root", "pair"]):
        for i, j in runs_of(table, ["root", "pair"]):
            part = table.slice(i, j - i)
            ids, docs = part.column("class_id").to_numpy(), part.column("n_docs").to_numpy()
            block, cross = part.column("block").to_numpy(), bool(part.column("cross")[0].as_py())
            sets = [np.frombuffer(x, np.uint64) for x in part.column("shingles").to_pylist()]
            sig, size, n = signatures(sets), np.array([len(s) for s in sets]), j - i
            order = np.argsort(ids, kind="stable")  # the least id becomes the root
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            classes, linked, root, total, likely = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n), None, 0
            for x, y in pairs_of(block, _inside(block, cross)):
                ok = likely_pairs(sig, x, y)
                a, b = x[ok], y[ok]
                likely += len(a)
                if total is None and likely > 2 * n:
                    total = common_shingles(sets)
                both = intersections(sets, a, b, total)
                # inter / union >= 4/5 in whole numbers
                ok = 5 * both >= 4 * (size[a] + size[b] - both)
                a, b = a[ok], b[ok]
                classes += np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
                linked += (np.bincount(a, weights=docs[b], minlength=n) + np.bincount(b, weights=docs[a], minlength=n)).astype(np.int64)
                root = roots(root, rank[a], rank[b])
            root = ids[order][root][rank]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids), pa.array(root), pa.array(classes), pa.array(linked), pa.array(np.full(n, cross))],
                names=["class_id", "root", "n_links", "n_linked_docs", "split"],
            )


#: Texts without a doc_id of their own are numbered from here on by their hash.
OWN_NUMBER = 1 << 62


def with_digest(documents: DataFrame) -> DataFrame:
    """The rows with 128 bits that tell their texts apart, t1 and t2."""
    text = F.col("text").cast("string")
    return documents.withColumns({"_t1": F.xxhash64(text), "_t2": F.xxhash64(F.lit("second"), text)})


def numbered(copies: DataFrame) -> DataFrame:
    """(t1, t2, first_doc, n_docs) with class_id: the least doc_id of the text; where that names another
    text too, or is null, a number of the text's own, OWN_NUMBER and above."""
    naming = copies.groupBy("first_doc").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2")).alias("named")).where("n > 1 or first_doc is null")
    naming = naming.select(F.col("first_doc").alias("_doc"), "named")
    other = F.col("named").isNotNull() & (F.col("first_doc").isNull() | (F.col("named") != F.struct("t1", "t2")))
    joined = copies.join(naming.hint("merge"), F.col("first_doc").eqNullSafe(F.col("_doc")), "left")
    return joined.select("t1", "t2", "first_doc", "n_docs", F.when(other, F.col("t1").bitwiseAND(OWN_NUMBER - 1) + OWN_NUMBER).otherwise(F.col("first_doc")).alias("class_id"))


def _linked(source: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sketches, copies, links): the rows (doc_id, t1, t2, sig), the texts with class_id, and for the
    texts that share a likely component (class_id, local, n_links, n_linked_docs), local being the root."""
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sketches = written(source.mapInArrow(_sketch, "doc_id long, t1 long, t2 long, sig binary"), "sketches")
    filled = sketches.where("sig is not null")
    copies = filled.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_doc"), (F.count_distinct("doc_id") + F.count_if(F.col("doc_id").isNull())).alias("n_docs"))
    copies = written(numbered(written(copies, "copies")), "numbered")
    named = copies.select(F.col("t1").alias("c1"), F.col("t2").alias("c2"), "first_doc", "n_docs", "class_id")
    chosen = filled.join(named.hint("merge"), (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("first_doc")))
    texts = written(chosen.groupBy("class_id").agg(F.first("sig").alias("sig"), F.max("n_docs").alias("n_docs")), "texts")
    keyed = texts.select("class_id", "sig").mapInArrow(_bands, "class_id long, key long")
    repeated = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    hits = written(_dealt(keyed.join(repeated.hint("merge"), "key"), "key", "size"), "hits")
    with_sig = hits.join(texts.select("class_id", "sig").hint("merge"), "class_id")
    edges = with_sig.select("key", "pair", "block", "cross", "class_id", "sig").repartition(n, "key", "pair").sortWithinPartitions("key", "pair", "class_id").mapInArrow(_bucket_edges, "src long, dst long")
    likely = components(edges.distinct(), "likely")
    drop_written(hits)
    sizes = likely.groupBy("root").agg(F.count("*").alias("size"))
    members = likely.join(sizes.hint("merge"), "root").withColumnRenamed("node", "class_id").join(texts.select("class_id", "n_docs").hint("merge"), "class_id")
    # The text of a class is read from the row of its first document.
    of_class = members.join(copies.drop("n_docs").hint("merge"), "class_id")
    rows = source.select(F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1"), F.col("t2").alias("_t2"), "text")
    with_text = of_class.hint("merge").join(rows, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")) & F.col("first_doc").eqNullSafe(F.col("_doc")))
    shingles = with_text.select("root", "size", "class_id", "n_docs", "text").mapInArrow(_shingle_rows, "root long, size long, class_id long, n_docs long, shingles binary")
    dealt = _dealt(shingles.dropDuplicates(["class_id"]), "root", "size")
    verified = dealt.select("root", "pair", "block", "cross", "class_id", "n_docs", "shingles").repartition(n, "root", "pair").sortWithinPartitions("root", "pair", "class_id").mapInArrow(
        _verify, "class_id long, root long, n_links long, n_linked_docs long, split boolean"
    )
    verified = written(verified, "verified")
    links = verified.groupBy("class_id").agg(F.sum("n_links").alias("n_links"), F.sum("n_linked_docs").alias("n_linked_docs"), F.min("root").alias("local"), F.max("split").alias("split"))
    apart = verified.where("split and class_id <> root").select(F.col("class_id").alias("src"), F.col("root").alias("dst"))
    if apart.limit(1).count():
        joined = components(apart, "split").withColumnsRenamed({"node": "class_id", "root": "far"})
        links = links.join(joined, "class_id", "left").withColumn("local", F.when(F.col("split"), F.coalesce("far", "class_id")).otherwise(F.col("local"))).drop("far")
    return sketches, copies, links


def _source(documents: DataFrame) -> DataFrame:
    doc = F.col("doc_id").cast("long").alias("doc_id")
    return with_digest(documents).select(doc, F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), F.col("text").cast("string").alias("text"))


def jaccard_join(documents: DataFrame) -> DataFrame:
    """Group every whole text of (doc_id, text) by Jaccard similarity of word shingles.

    Shingles are SHINGLE words; two different texts are linked if the Jaccard similarity of their
    shingle sets is at least THRESHOLD. One row per row of ``documents``: doc_id; copy_id, the least
    doc_id with exactly this text; class_id, the least copy_id of all texts joined to it by links;
    n_links, the links of its text to different texts; n_linked_docs, the other documents that its
    links and its copies amount to. Texts without words (null, empty) are never linked: each row is its
    own class, named by its doc_id. Rows are told apart by doc_id and text, and those equal in both are
    one document. A text whose least doc_id also names another text, or that only has null doc_ids, is
    named by a number of its own, OWN_NUMBER and above. Further columns are ignored.
    """
    sketches, copies, links = _linked(_source(documents))
    found = copies.drop("first_doc").join(links.hint("merge"), "class_id", "left").select(
        F.col("t1").alias("c1"), F.col("t2").alias("c2"), F.col("class_id").alias("copy_id"), F.coalesce("local", "class_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        (F.coalesce("n_linked_docs", F.lit(0)) + F.col("n_docs") - 1).alias("n_linked_docs"),
    )
    rows = sketches.select("doc_id", F.when(F.col("sig").isNotNull(), F.col("t1")).alias("t1"), "t2")
    return rows.join(found.hint("merge"), (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")), "left").select(
        "doc_id", F.coalesce("copy_id", "doc_id").alias("copy_id"), F.coalesce("class_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_linked_docs", F.lit(0)).cast("long").alias("n_linked_docs"),
    )


def drop_near_duplicates(documents: DataFrame) -> DataFrame:
    """One document of each class stays, with all its columns: that of the least class_id's text with the
    least doc_id (null before all). Rows equal in doc_id and text are one document, of which any one row
    stays. Every row is judged by its text, whatever its doc_id; texts without words all stay."""
    sketches, copies, links = _linked(_source(documents))
    first = copies.join(links.select("class_id", "local").hint("merge"), "class_id", "left").where(F.coalesce("local", "class_id") == F.col("class_id")).select("first_doc", "t1", "t2")
    kept = first.unionByName(sketches.where("sig is null").select(F.col("doc_id").alias("first_doc"), "t1", "t2")).select(F.col("first_doc").alias("_k_doc"), F.col("t1").alias("_k1"), F.col("t2").alias("_k2"))
    keyed = with_digest(documents).withColumn("_doc", F.col("doc_id").cast("long"))
    same = (F.col("_t1") == F.col("_k1")) & (F.col("_t2") == F.col("_k2")) & F.col("_doc").eqNullSafe(F.col("_k_doc"))
    return keyed.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["_doc", "_t1", "_t2"]).select(*documents.columns)
