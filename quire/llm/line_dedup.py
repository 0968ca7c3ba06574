"""Line dedup by content-defined line chunks and exact short repeats, with DataFrame functions only.

Each line is hashed; a rolling hash over two neighbouring line hashes is computed at every line, and a
chunk starts where that value is a local minimum. Boundaries depend on nearby lines only, so a block
of lines that several documents share is cut alike whatever stands around it, and two boundaries are
at least two lines apart. A repeat of a few lines need not hold two boundaries, so ``short_repeats``
also takes every two neighbouring lines and every long single line; repeated pairs that touch make up
the maximal repeated run. Units that occur more than once in the whole table are found by hash counts;
the texts of those alone are then compared byte by byte with the first occurrence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.runtime import written


#: A single line is a repeat of its own if it has more words than this.
LONG_LINE_WORDS = 50


def _bound(value: Column, f) -> Column:
    """f(value), where a lambda that needs the value again and again has it computed once."""
    return F.transform(F.array(value), f)[0]


def _starts(lines: Column) -> Column:
    """array<int>: where the chunks of an array of lines start."""

    def minima(r: Column) -> Column:
        n = F.size(r)
        inner = F.when(n >= 4, F.sequence(F.lit(2), F.greatest(n - 2, F.lit(2)))).otherwise(F.array().cast("array<int>"))
        return F.concat(F.array(F.lit(0)), F.filter(inner, lambda i: (F.get(r, i) < F.get(r, i - 1)) & (F.get(r, i) <= F.get(r, i + 1))))

    return _bound(F.transform(lines, lambda line: F.xxhash64(line)), lambda hashes: _bound(F.transform(hashes, lambda h, i: F.xxhash64(F.get(hashes, i - 1), h)), minima))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _joined(lines: Column, a: Column, b: Column) -> Column:
    return F.array_join(F.slice(lines, a + 1, b - a), "\n")


def line_chunks(text: Column) -> Column:
    """array<struct<k, chunk, n_lines>>: the chunks of a text in order; joined by newlines they give the text."""

    def cut(lines: Column, at: Column) -> Column:
        end = lambda k: F.coalesce(F.get(at, k + 1), F.size(lines))
        return F.transform(at, lambda s, k: F.struct(k.alias("k"), _joined(lines, s, end(k)).alias("chunk"), (end(k) - s).alias("n_lines")))

    return _bound(_lines(text), lambda lines: _bound(_starts(lines), lambda at: cut(lines, at)))


def _units(text: Column, short_repeats: bool) -> Column:
    """array<struct<a, b, h>>: what may be a repeat, lines a to b (exclusive) with the hash of their text.

    Chunks of two lines or more that are not blank; with short_repeats also two neighbouring lines that
    are not blank, with the blank ones between them, and single lines of over LONG_LINE_WORDS words.
    """
    shown = lambda line: line.rlike(r"\S")
    unit = lambda a, b: F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    def found(lines: Column) -> Column:
        n = F.size(lines)
        chunks = _bound(_starts(lines), lambda at: F.transform(at, lambda s, k: unit(s, F.coalesce(F.get(at, k + 1), n))))
        chunks = F.filter(chunks, lambda c: (c["b"] - c["a"] >= 2) & shown(_joined(lines, c["a"], c["b"])))
        if not short_repeats:
            return chunks

        def short(at: Column) -> Column:
            pairs = F.transform(F.filter(at, lambda _, k: k < F.size(at) - 1), lambda i, k: unit(i, F.get(at, k + 1) + 1))
            long = F.filter(at, lambda i: F.size(F.split(F.get(lines, i), r"\S+", LONG_LINE_WORDS + 2)) > LONG_LINE_WORDS + 1)
            return F.concat(chunks, pairs, F.transform(long, lambda i: unit(i, i + 1)))

        return _bound(F.filter(F.sequence(F.lit(0), n - 1), lambda i: shown(F.get(lines, i))), short)

    hashed = lambda lines, u: F.struct(u["a"].alias("a"), u["b"].alias("b"), F.xxhash64(_joined(lines, u["a"], u["b"])).alias("h"))
    return _bound(_lines(text), lambda lines: F.transform(found(lines), lambda u: hashed(lines, u)))


def repeated_units(documents: DataFrame, short_repeats: bool) -> DataFrame:
    """(doc_id, text_hash, a, b): the units that equal an earlier one, byte by byte.

    Earlier means smaller (doc_id, hash of the text, place); a unit that overlaps the first of its kind
    stays. Units whose 64-bit hash alone agrees stay. The counting shuffles hashes; only texts of units
    with a repeated hash are compared.
    """
    # Merge joins at every size: what is joined grows with the documents.
    source = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).where("text is not null")
    # Written, as cutting the texts is most of the work and the hashes are read twice.
    every = written(source.select("doc_id", "text_hash", F.explode(_units(F.col("text"), short_repeats)).alias("u")).select("doc_id", "text_hash", "u.*"), "line-units")
    here = F.struct("doc_id", "text_hash", "a", "b")
    counted = every.groupBy("h").agg(F.count("*").alias("n"), F.min(here).alias("first")).where("n > 1").drop("n")
    counted = written(counted, "line-counts")  # so that the join can split a common unit
    same_text = F.col("first.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("first.text_hash") == F.col("text_hash"))
    hits = every.join(counted.hint("merge"), "h").withColumn("is_first", F.col("first").eqNullSafe(here)).where(F.col("is_first") | ~(same_text & (F.col("first.b") > F.col("a"))))
    by_doc = hits.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b", "h", "is_first")).alias("hits"))
    b = written(by_doc, "line-hits").select(F.col("doc_id").alias("b_doc"), F.col("text_hash").alias("b_hash"), "hits")
    texts = source.join(b.hint("merge"), F.col("doc_id").eqNullSafe(F.col("b_doc")) & (F.col("text_hash") == F.col("b_hash"))).select(
        "doc_id", "text_hash", F.explode(_bound(_lines(F.col("text")), lambda lines: F.transform("hits", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["h"].alias("h"), x["is_first"].alias("is_first"), _joined(lines, x["a"], x["b"]).alias("unit"))))).alias("c")
    ).select("doc_id", "text_hash", "c.*")
    texts = written(texts, "line-texts")
    firsts = texts.where("is_first").groupBy("h").agg(F.first("unit").alias("first_unit"))
    return written(texts.where("not is_first").join(firsts.hint("merge"), "h").where("unit = first_unit").select("doc_id", "text_hash", "a", "b"), "line-repeats")


def line_dedup(documents: DataFrame, short_repeats: bool = False) -> DataFrame:
    """Remove globally repeated lines from every whole text; their first occurrence stays.

    Repeats are equal multi-line chunks; with short_repeats also all other runs of two lines or more, and
    single lines of over LONG_LINE_WORDS words. No text of a line is lost: its first line always stays.

    Returns every row with all its columns, ``text`` without the removed lines, and n_lines (before),
    n_removed_lines, n_removed_chunks (runs of removed lines). A null text stays null with no lines; an
    empty text is one line. Rows with equal doc_id and text count as one occurrence and get the same
    result; a null doc_id sorts first. Blank lines alone are no repeat. Columns named like those added
    are replaced.
    """
    added = ("n_lines", "n_removed_lines", "n_removed_chunks")
    removed = repeated_units(documents, short_repeats).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("units"))
    lines_of = F.array_distinct(F.flatten(F.transform("units", lambda u: F.sequence(u["a"], u["b"] - 1))))
    r = removed.select(F.col("doc_id").alias("_r_doc"), F.col("text_hash").alias("_r_hash"), lines_of.alias("_gone"))
    joined = documents.drop(*added).withColumn("_hash", F.xxhash64("text")).join(r.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_r_doc")) & (F.col("_hash") == F.col("_r_hash")), "left")
    out = joined.withColumn("_gone", F.coalesce(F.col("_gone"), F.array().cast("array<int>")))
    # Set differences, so that the cost stays in proportion to the lines however many go.
    left = _bound(_lines(F.col("text")), lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_gone")), lambda i: F.get(lines, i)), "\n"))
    kept = [F.when(F.size("_gone") > 0, left).otherwise(F.col("text")).alias("text") if c == "text" else F.col(c) for c in documents.columns if c not in added]
    return out.select(
        *kept,
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_removed_lines"),
        F.size(F.array_except("_gone", F.transform("_gone", lambda i: i + 1))).cast("long").alias("n_removed_chunks"),
    )
