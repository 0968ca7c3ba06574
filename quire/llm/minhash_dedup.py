"""Near duplicates by MinHash with tensored tables.

Two collections of HALVES short keys of ROWS MinHash values each are computed; the key of table (i, j) is
the pair of the i-th key of one and the j-th of the other, so HALVES ** 2 tables of 2 * ROWS values take
2 * HALVES * ROWS MinHash values in place of 2 * HALVES ** 2 * ROWS.

Only components are asked for, so crowds need no pairs. Every text is first compared, on the whole sets,
with the text with which it shares most tables and which comes first there; that settles groups of near
copies with one comparison each. What is left are tables with texts of several components: there only
pairs across components are compared, by sketch and then on the whole sets, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.jaccard_join import SHINGLE, intersections, numbered, common_shingles, roots, runs_of, shingle_sets, with_digest
from quire.llm.runtime import components, drop_written, small_batches, whole_groups, written
from quire.llm.words import blank_split_words, mix, word_blocks

#: Texts are linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
#: A pair at the threshold meets in no table with probability of at most 2 * (1 - 0.85**2)**12 < 5e-7.
HALVES, ROWS = 12, 2
HASHES = 2 * HALVES * ROWS
#: Equal values of the sketch below which a pair is not verified: at a similarity of 0.85 fewer occur with
#: probability 5e-7.
LEAST_EQUAL = 27
#: Members of one side that a task compares at once.
BLOCK = 1000

_rng = np.random.default_rng(20240612)
_MULTIPLY = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_HALF = mix(np.arange(200, 200 + ROWS)) | np.uint64(1)


def sketches_of(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values, one row per (non-empty) set."""
    out = np.zeros((len(sets), HASHES), np.uint32)
    if sets:
        x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
        at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
        for k in range(HASHES):
            out[:, k] = np.minimum.reduceat(x * _MULTIPLY[k] + _ADD[k], at)
    return out


def half_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per half; the first HALVES columns are the one collection, the rest the other."""
    s = sig.reshape(len(sig), 2 * HALVES, ROWS).astype(np.uint64)
    return mix((s * _HALF).sum(2, dtype=np.uint64) + np.arange(2 * HALVES, dtype=np.uint64)).view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, t1, t2, text) with the size and the sketch of the set in place of the text."""
    for batch in small_batches(batches, 3):
        for first, last, h, counts in word_blocks(batch.column(3).to_pylist(), blank_split_words):
            sets = shingle_sets(h, counts)
            sig = iter(sketches_of([s for s in sets if len(s)]))
            found = pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())
            size = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(first, last - first) for k in range(3)), size, found], names=["doc_id", "t1", "t2", "n_shingles", "sig"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, text) with the sorted set in place of the text."""
    for batch in small_batches(batches, 1):
        for first, last, h, counts in word_blocks(batch.column(1).to_pylist(), blank_split_words):
            sets = pa.array([s.tobytes() for s in shingle_sets(h, counts)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), sets], names=["class_id", "content"])


def _half_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, HASHES)
            at = np.repeat(np.arange(len(sig)), 2 * HALVES)
            half = np.tile(np.arange(2 * HALVES, dtype=np.int32), len(sig))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(half), pa.array(half_keys(sig).reshape(-1))], names=["class_id", "half", "value"])


def _linked(size_a: np.ndarray, size_b: np.ndarray, both: np.ndarray) -> np.ndarray:
    return 100 * both >= PERCENT * (size_a + size_b - both)


def _star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, first) of the members of each (first, salt) that are linked with the group's first text."""
    for table in whole_groups(batches, ["first", "salt"]):
        ids, first = table.column("class_id").to_numpy(), table.column("first").to_numpy()
        content = table.column("content")
        src, dst = [], []
        for i, j in runs_of(table, ["first", "salt"]):
            own = np.frombuffer(content[i].as_py(), np.uint64)
            for a in range(i + 1, j, 64):
                b = min(j, a + 64)
                sets = [np.frombuffer(x, np.uint64) for x in content.slice(a, b - a).to_pylist()]
                flat, sizes = np.concatenate(sets), np.array([len(s) for s in sets])
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat((own[at] == flat).astype(np.int64), np.concatenate(([0], np.cumsum(sizes)[:-1])))
                ok = _linked(sizes, len(own), both)
                src.append(ids[a:b][ok])
                dst.append(first[a:b][ok])
        if src:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


def _cross_pairs(core: np.ndarray, side: np.ndarray, block: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of different cores, of different sides or blocks where there are several, in
    pieces of bounded size."""
    n = len(core)
    spot = side.astype(np.int64) * (1 << 32) + block
    several = (spot != spot[0]).any()
    left = np.flatnonzero(spot == spot.min()) if several else np.arange(n)
    right = np.flatnonzero(spot != spot.min()) if several else left
    rows = max(1, 200_000 // max(1, len(right)))
    for k in range(0, len(left), rows):
        part = left[k : k + rows]
        a, b = np.repeat(part, len(right)), np.tile(right, len(part))
        ok = (core[a] != core[b]) & (several | (a < b))
        yield a[ok], b[ok]


def _likely(sig: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs have LEAST_EQUAL equal sketch values; a pair goes as soon as it cannot get there."""
    alive, equal, step = np.arange(len(a)), np.zeros(len(a), np.int32), 12
    for k in range(0, HASHES, step):
        equal = equal + (sig[a[alive], k : k + step] == sig[b[alive], k : k + step]).sum(1)
        keep = equal + (HASHES - k - step) >= LEAST_EQUAL
        alive, equal = alive[keep], equal[keep]
    return alive


def _compare(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    """Links between members of different cores in every (team, pair), as edges to the least member that
    is reached: likely links, by the sketches in ``content``, or links of the whole sets there."""
    for table in whole_groups(batches, ["team", "pair"]):
        src, dst = [], []
        for i, j in runs_of(table, ["team", "pair"]):
            part = table.slice(i, j - i)
            ids, core, side, block = (part.column(c).to_numpy() for c in ("class_id", "core", "side", "block"))
            content = part.column("content").to_pylist()
            if whole:
                sets = [np.frombuffer(x, np.uint64) for x in content]
                sig, sizes = sketches_of(sets), np.array([len(s) for s in sets])
            else:
                sig = np.frombuffer(b"".join(content), np.uint32).reshape(-1, HASHES)
            n = j - i
            order = np.argsort(ids, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.arange(n)
            root, total, likely = np.arange(n), None, 0
            for x, y in _cross_pairs(core, side, block):
                ok = _likely(sig, x, y)
                x, y = x[ok], y[ok]
                if whole:
                    apart = root[rank[x]] != root[rank[y]]
                    x, y = x[apart], y[apart]
                    likely += len(x)
                    if total is None and likely > 2 * n:
                        total = common_shingles(sets)
                    ok = _linked(sizes[x], sizes[y], intersections(sets, x, y, total))
                    x, y = x[ok], y[ok]
                root = roots(root, rank[x], rank[y])
            least = ids[order][root][rank]
            src.append(ids[least != ids])
            dst.append(least[least != ids])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(src)), pa.array(np.concatenate(dst))], names=["src", "dst"])


def _likely_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _compare(batches, whole=False)


def _link_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _compare(batches, whole=True)


def _pairs_of_blocks(members: DataFrame) -> DataFrame:
    """(team, class_id, core) dealt to pairs of blocks of at most about BLOCK members.

    The largest core of a team is one side, since its members are not compared with each other; the rest
    are the other, compared with both. A team that fits is one pair."""
    counted = members.groupBy("team", "core").agg(F.count("*").alias("n"))
    largest = F.max(F.struct("n", "core"))
    teams = counted.groupBy("team").agg(F.sum("n").alias("all"), largest.alias("m")).where(F.col("all") > F.col("m.n"))
    teams = teams.select("team", F.col("m.core").alias("main"), F.ceil(F.col("m.n") / BLOCK).cast("int").alias("na"), F.ceil((F.col("all") - F.col("m.n")) / BLOCK).cast("int").alias("nr"), "all")
    sided = members.join(teams.hint("merge"), "team").withColumn("one", F.col("all") <= BLOCK).withColumn("side", F.when(F.col("one"), F.lit(0)).otherwise((F.col("core") != F.col("main")).cast("int")))
    block = F.pmod(F.xxhash64("class_id"), F.when(F.col("side") == 0, F.col("na")).otherwise(F.col("nr")))
    sided = sided.withColumn("block", F.when(F.col("one"), F.lit(0)).otherwise(block).cast("int"))
    across = F.col("na") * F.col("nr")

    def row(a: Column, r: Column) -> Column:
        return (a * F.col("nr") + r).cast("long")

    rest = F.sequence(F.lit(0), F.col("nr") - 1)
    of_main = F.transform(rest, lambda r: row(F.col("block"), r))
    with_main = F.transform(F.sequence(F.lit(0), F.col("na") - 1), lambda a: row(a, F.col("block")))
    with_rest = F.transform(rest, lambda r: across + row(F.least(r, F.col("block")), F.greatest(r, F.col("block"))))
    pairs = F.when(F.col("one"), F.array(F.lit(0).cast("long"))).when(F.col("side") == 0, of_main).otherwise(F.concat(with_main, with_rest))
    return sided.select("team", "class_id", "core", "side", "block", F.explode(pairs).alias("pair"))


def _compared(dealt: DataFrame, content: DataFrame, whole: bool, n: int) -> DataFrame:
    rows = dealt.join(content.hint("merge"), "class_id").select("team", "pair", "class_id", "core", "side", "block", "content")
    return rows.repartition(n, "team", "pair").sortWithinPartitions("team", "pair", "class_id").mapInArrow(_link_rows if whole else _likely_rows, "src long, dst long")


def _tables(texts: DataFrame) -> DataFrame:
    """(class_id, key) of the tables in which a text may meet another: only halves that occur twice are
    combined, since a pair of halves occurs twice only if both do."""
    halves = written(texts.mapInArrow(_half_rows, "class_id long, half int, value long"), "halves")
    twice = halves.groupBy("value").agg(F.count("*").alias("n")).where("n > 1").select("value")
    own = halves.join(twice.hint("merge"), "value", "left_semi").groupBy("class_id").agg(F.collect_list(F.struct("half", "value")).alias("h"))
    one, other = F.filter("h", lambda x: x["half"] < HALVES), F.filter("h", lambda x: x["half"] >= HALVES)
    keys = F.flatten(F.transform(one, lambda x: F.transform(other, lambda y: F.xxhash64(x["value"], y["value"]))))
    return own.select("class_id", F.explode(keys).alias("key"))


def _links(source: DataFrame, copies: DataFrame, texts: DataFrame) -> DataFrame:
    """Verified links (src, dst) between texts, enough of them to tell the components."""
    n = int(source.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tables = written(_tables(texts.select("class_id", "sig")), "tables")
    shared = tables.groupBy("key").agg(F.count("*").alias("n"), F.min("class_id").alias("first")).where("n > 1").select("key", "first")
    hits = written(tables.join(shared.hint("merge"), "key"), "hits")
    drop_written(tables)
    # The texts that meet another one, with their sets.
    met = hits.select("class_id").distinct()
    named = copies.join(met.hint("merge"), "class_id", "left_semi").select("class_id", F.col("t1").alias("c1"), F.col("t2").alias("c2"), "first_doc")
    same = (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2")) & F.col("doc_id").eqNullSafe(F.col("first_doc"))
    sets = source.join(named.hint("merge"), same).select("class_id", "text").mapInArrow(_set_rows, "class_id long, content binary")
    sets = written(sets.dropDuplicates(["class_id"]), "sets")
    star = hits.where("class_id <> first").groupBy("class_id", "first").agg(F.count("*").alias("n")).groupBy("class_id").agg(F.max(F.struct(F.col("n"), (-F.col("first")).alias("less"))).alias("m"))
    star = written(star.select("class_id", (-F.col("m.less")).alias("first")), "star")
    salts = star.groupBy("first").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("salts"))
    member = star.join(salts.hint("merge"), "first").select("first", F.pmod(F.xxhash64("class_id"), F.col("salts")).cast("int").alias("salt"), "class_id", F.lit(1).alias("later"))
    head = salts.select("first", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("first").alias("class_id"), F.lit(0).alias("later"))
    meeting = member.unionByName(head).join(sets.hint("merge"), "class_id").select("first", "salt", "later", "class_id", "content")
    linked = meeting.repartition(n, "first", "salt").sortWithinPartitions("first", "salt", "later").mapInArrow(_star_links, "src long, dst long")
    linked = written(linked, "star-links")
    cores = components(linked, "cores").withColumnsRenamed({"node": "class_id", "root": "core"})
    # Tables in which texts of several cores meet; a team is what meets the least of those cores.
    placed = written(hits.select("class_id", "key").join(cores.hint("merge"), "class_id", "left").select("class_id", "key", F.coalesce("core", "class_id").alias("core")), "placed")
    open_keys = placed.groupBy("key").agg(F.min("core").alias("team"), F.max("core").alias("most")).where("team < most").select("key", "team")
    members = written(placed.join(open_keys.hint("merge"), "key").select("team", "class_id", "core").distinct(), "members")
    drop_written(hits)
    drop_written(placed)
    likely = _compared(_pairs_of_blocks(members), texts.select("class_id", F.col("sig").alias("content")), False, n)
    teams = components(likely, "likely").withColumnsRenamed({"node": "class_id", "root": "team"})
    again = teams.join(members.select("class_id", "core").distinct().hint("merge"), "class_id")
    across = written(_compared(_pairs_of_blocks(again), sets, True, n), "across-links")
    return linked.union(across)


def near_duplicates(documents: DataFrame) -> DataFrame:
    """Components of near-duplicate whole texts of (doc_id, text), one row per row of ``documents``.

    A-Z are lower-cased; words stand between ASCII blanks (U+0020, U+0009 to U+000D). The set of a text are
    its distinct shingles of SHINGLE words, or, with fewer words, all of them as one. Two documents are
    linked if 100 * intersection >= PERCENT * union of their sets. Columns: doc_id; n_shingles, the size of
    the set; component_id, the least doc_id that links reach, its own included; kept, whether that is its
    own. Texts without words (null, empty, blank) have an empty set and are linked with nothing. Rows are
    told apart by their text: rows of one text are one document, whatever their doc_id; of rows that repeat
    doc_id and text all are kept or none. A null doc_id is reached through others and named null only where
    no row of its component has one. An empty table gives no rows; further columns are ignored.
    """
    source = with_digest(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_t1").alias("t1"), F.col("_t2").alias("t2"), F.col("text").cast("string").alias("text"))
    sketches = written(source.mapInArrow(_sketch, "doc_id long, t1 long, t2 long, n_shingles long, sig binary"), "sketches")
    filled = sketches.where("sig is not null")
    copies = filled.groupBy("t1", "t2").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"), F.min("sig").alias("sig"))
    copies = written(copies, "copies")
    texts = written(numbered(copies.drop("sig")).join(copies.select("t1", "t2", "sig").hint("merge"), ["t1", "t2"]), "texts")
    links = _links(source, texts, texts)
    found = components(links, "links").withColumnsRenamed({"node": "class_id"})
    placed = texts.select("t1", "t2", "class_id", "first_doc").join(found.hint("merge"), "class_id", "left").withColumn("root", F.coalesce("root", "class_id"))
    named = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    of_text = placed.join(named.hint("merge"), "root").select(F.col("t1").alias("c1"), F.col("t2").alias("c2"), "component_id")
    same = (F.col("t1") == F.col("c1")) & (F.col("t2") == F.col("c2"))
    rows = sketches.select("doc_id", F.when(F.col("sig").isNotNull(), F.col("t1")).alias("t1"), "t2", "n_shingles").join(of_text.hint("merge"), same, "left")
    component = F.when(F.col("c1").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))
