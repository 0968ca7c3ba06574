"""Queries on packing, splitting and ordering of segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions.text import batch_key, heading, is_blank
from quire.operators import checks, folds, segments
from quire.session import table

LINES = """lines AS (
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS i, line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents
    ) WHERE regexp_matches(line, '\\S'))"""


def long(c: str, name: str | None = None):
    return F.col(c).cast("long").alias(name or c)


def _sized(x):
    return F.length(x)


def _packed_lines(spark: SparkSession, sf_dir: str, budget: int) -> DataFrame:
    items = F.transform(F.filter(F.split("text", r"\R", -1), lambda x: ~is_blank(x)), lambda x: x)
    one = table(spark, sf_dir, "documents").select("doc_id", items.alias("items"))
    return folds.explode_batches(one, ["doc_id"], folds.batch_starts(F.transform("items", _sized), budget))


def pack_batches(spark, sf_dir):
    chars = F.aggregate(F.transform("items", _sized), F.lit(0), lambda a, b: a + b)
    return _packed_lines(spark, sf_dir, 1800).select("doc_id", long("batch"), long("start"), F.size("items").cast("long").alias("n_items"), chars.cast("long").alias("chars"))


def review_chunks(spark, sf_dir):
    packed = _packed_lines(spark, sf_dir, 3 * 1800).withColumn("n", F.size("items"))
    base = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("batch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return packed.select("doc_id", long("batch", "chunk"), base.cast("long").alias("base"), long("n", "n_items"), batch_key(base, F.col("n")).alias("batch_key"))


def _walk(items: str, group: str, budget: int, extra: str = "FALSE", separator: int = 0) -> str:
    """Greedy packing as a recursive query over items(group, i, n)."""
    new = f"(w.cur + t.n > {budget} OR {extra})"
    return f"""walk AS (
        SELECT {group}, i, n, n + {separator} AS cur, 1 AS cnt, 0 AS batch FROM {items} WHERE i = 0
        UNION ALL
        SELECT t.{group}, t.i, t.n, CASE WHEN {new} THEN t.n + {separator} ELSE w.cur + t.n + {separator} END,
               CASE WHEN {new} THEN 1 ELSE w.cnt + 1 END, w.batch + CASE WHEN {new} THEN 1 ELSE 0 END
        FROM walk w JOIN {items} t ON t.{group} = w.{group} AND t.i = w.i + 1)"""


def _turns(spark, sf_dir):
    return folds.pack(table(spark, sf_dir, "conversations"), ["conv_id"], ["turn"], F.struct("turn", "role", "text"), lambda x: F.length(x["text"]), 600)


def resume_batches(spark, sf_dir):
    out = folds.resume_batches(_turns(spark, sf_dir), ["conv_id"], lambda x: x["role"] == "assistant")
    return out.select("conv_id", long("batch"), long("start"), F.size("items").cast("long").alias("n_items"), "done")


def progress_counts(spark, sf_dir):
    out = folds.resume_batches(_turns(spark, sf_dir), ["conv_id"], lambda x: x["role"] == "assistant")
    return checks.progress(out).select(long("done"), long("total"))


def title_batches(spark, sf_dir):
    books = table(spark, sf_dir, "part").withColumn("book", F.floor(F.col("p_partkey") / 10000))
    packed = folds.pack(books, ["p_brand", "book"], ["p_partkey"], F.col("p_name"), _sized, 500, most_items=40)
    return packed.select("p_brand", "book", long("batch"), long("start"), F.size("items").cast("long").alias("n_items"))


def synopsis_groups(spark, sf_dir):
    # A book is what one fold holds: a source's documents of one thousand ids, however many a source has.
    books = table(spark, sf_dir, "documents").withColumn("book", F.floor(F.col("doc_id") / 1000))
    packed = folds.pack(books, ["source", "book"], ["doc_id"], F.length("text"), lambda n: n, 12000, separator=1)
    return packed.select("source", "book", long("batch"), long("start"), F.size("items").cast("long").alias("n_items"))


def split_long_segments(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("seg"), F.col("text").alias("source"), F.lit("text").alias("kind"), F.lit("a0").alias("anchor"))
    out = segments.split_long_segments(docs, ["doc_id"], 1200)
    return out.select("doc_id", long("seg"), F.length("source").cast("long").alias("chars"), F.md5(F.col("source").cast("binary")).alias("digest"), "cont", F.coalesce("anchor", F.lit("")).alias("anchor"))


_END = "。．.!！？?…\\n"
_SPLIT = f"""sents AS (
        SELECT doc_id, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM (
            SELECT doc_id, regexp_extract_all(text, '[^{_END}]*[{_END}]|[^{_END}]+') AS s FROM documents WHERE length(text) > 1200)),
    peel(doc_id, k, j, piece, rest) AS (
        SELECT doc_id, k, 0, NULL::VARCHAR, s FROM sents WHERE length(s) > 1200
        UNION ALL
        SELECT doc_id, k, j + 1, CASE WHEN length(rest) > 1200 THEN left(rest, cut) ELSE rest END, CASE WHEN length(rest) > 1200 THEN substr(rest, cut + 1) ELSE '' END
        FROM (SELECT *, CASE WHEN sp > 0 THEN sp WHEN tb > 0 THEN tb WHEN nl > 0 THEN nl ELSE 1200 END AS cut FROM (
            SELECT *, length(regexp_replace(left(rest, 1201), '[^ ]*$', '')) - 1 AS sp, length(regexp_replace(left(rest, 1201), '[^\\t]*$', '')) - 1 AS tb,
                   length(regexp_replace(left(rest, 1201), '[^\\n]*$', '')) - 1 AS nl FROM peel WHERE rest <> ''))),
    pieces AS (
        SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) - 1 AS i, piece, solo FROM (
            SELECT doc_id, k, 0 AS j, s AS piece, FALSE AS solo FROM sents WHERE length(s) <= 1200
            UNION ALL SELECT doc_id, k, j, piece, TRUE FROM peel WHERE piece IS NOT NULL)),
    walk AS (
        SELECT doc_id, i, piece, solo, length(piece) AS cur, 0 AS seg FROM pieces WHERE i = 0
        UNION ALL
        SELECT t.doc_id, t.i, t.piece, t.solo, CASE WHEN t.solo OR w.solo OR w.cur + length(t.piece) > 1200 THEN length(t.piece) ELSE w.cur + length(t.piece) END,
               w.seg + CASE WHEN t.solo OR w.solo OR w.cur + length(t.piece) > 1200 THEN 1 ELSE 0 END
        FROM walk w JOIN pieces t ON t.doc_id = w.doc_id AND t.i = w.i + 1),
    cut AS (SELECT doc_id, seg, string_agg(piece, '' ORDER BY i) AS source FROM walk GROUP BY doc_id, seg
        UNION ALL SELECT doc_id, 0, text FROM documents WHERE length(text) <= 1200)"""


def merged_paragraphs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seg"), F.lit("text").alias("kind"), F.col("text").alias("source"), (F.col("role") == "assistant").alias("cont"))
    out = segments.merged_paragraphs(turns, ["conv_id"])
    return out.select("conv_id", long("paragraph"), long("n_parts"), F.md5(F.col("text").cast("binary")).alias("digest"))


def rolling_context(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").withColumn("target", F.when(F.col("role") == "assistant", F.col("text")))
    out = checks.rolling_context(turns, "conv_id", ["turn"], "target", 3)
    return out.select("conv_id", "turn", F.size("context").cast("long").alias("n_context"), F.md5(F.array_join("context", "|").cast("binary")).alias("digest"))


def _headed(text):
    return F.concat(F.lit("# Book\n\n"), F.replace(text, F.lit(".\n"), F.lit(".\n\n## Part\n\n")))


def text_chapters(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("book", _headed(F.col("text")))
    cut = segments.text_segments(segments.chapters(docs, "doc_id", "book", F.lit("stem")), "doc_id")
    return cut.groupBy("doc_id", long("chapter")).agg(
        F.count("*").alias("n_segments"), F.count_if(F.col("kind") == "heading").alias("n_headings"), F.max_by("source", "seg").alias("last"), F.sum(F.length("source")).cast("long").alias("chars")
    )


def heading_lines(spark, sf_dir):
    marks = F.array(*(F.lit(x) for x in ("# ", "## ", "### ", "#### ", "#", "", "第3章 ", "  序章 ", "あとがき")))
    lines_ = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.get(marks, (F.col("p_partkey") % 9).cast("int")), "p_name").alias("line"))
    return lines_.withColumn("h", heading(F.col("line"))).where("h is not null").select("p_partkey", F.col("h.title").alias("title"), F.col("h.level").cast("long").alias("level"))


QUERIES = {
    f.__name__: f
    for f in (pack_batches, review_chunks, resume_batches, progress_counts, title_batches, synopsis_groups, split_long_segments, merged_paragraphs, rolling_context, text_chapters, heading_lines)
}

_TURN_WALK = f"""items AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, length(text) AS n, role = 'assistant' AS done FROM conversations),
    {_walk("items", "conv_id", 600)},
    flip AS (SELECT w.conv_id, w.i, w.batch, t.done, CASE WHEN lag(t.done) OVER (PARTITION BY w.conv_id, w.batch ORDER BY w.i) IS DISTINCT FROM t.done THEN 1 ELSE 0 END AS new
        FROM walk w JOIN items t ON t.conv_id = w.conv_id AND t.i = w.i),
    runs AS (SELECT *, sum(new) OVER (PARTITION BY conv_id, batch ORDER BY i) AS run FROM flip)"""

ORACLE = {
    "pack_batches": f"""WITH RECURSIVE {LINES}, items AS (SELECT doc_id, i, length(line) AS n FROM lines), {_walk("items", "doc_id", 1800)}
        SELECT doc_id, CAST(batch AS BIGINT) AS batch, CAST(min(i) AS BIGINT) AS start, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS chars FROM walk GROUP BY doc_id, batch""",
    "review_chunks": f"""WITH RECURSIVE {LINES}, items AS (SELECT doc_id, i, length(line) AS n FROM lines), {_walk("items", "doc_id", 5400)}
        SELECT doc_id, CAST(batch AS BIGINT) AS chunk, CAST(min(i) AS BIGINT) AS base, count(*) AS n_items, min(i) || ':' || count(*) AS batch_key FROM walk GROUP BY doc_id, batch""",
    "resume_batches": f"""WITH RECURSIVE {_TURN_WALK}
        SELECT conv_id, CAST(batch AS BIGINT) AS batch, CAST(min(i) AS BIGINT) AS start, count(*) AS n_items, any_value(done) AS done FROM runs GROUP BY conv_id, batch, run""",
    "progress_counts": "SELECT count(*) FILTER (role = 'assistant') AS done, count(*) AS total FROM conversations",
    "title_batches": f"""WITH RECURSIVE items AS (SELECT p_brand || '|' || (p_partkey // 10000) AS book, row_number() OVER (PARTITION BY p_brand, p_partkey // 10000 ORDER BY p_partkey) - 1 AS i, length(p_name) AS n FROM part), {_walk("items", "book", 500, "w.cnt >= 40")}
        SELECT string_split(book, '|')[1] AS p_brand, CAST(string_split(book, '|')[2] AS BIGINT) AS book, CAST(batch AS BIGINT) AS batch, CAST(min(i) AS BIGINT) AS start, count(*) AS n_items FROM walk GROUP BY ALL""",
    "synopsis_groups": f"""WITH RECURSIVE items AS (SELECT source || '|' || (doc_id // 1000) AS book, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) - 1 AS i, length(text) AS n FROM documents), {_walk("items", "book", 12000, separator=1)}
        SELECT string_split(book, '|')[1] AS source, CAST(string_split(book, '|')[2] AS BIGINT) AS book, CAST(batch AS BIGINT) AS batch, CAST(min(i) AS BIGINT) AS start, count(*) AS n_items FROM walk GROUP BY ALL""",
    "split_long_segments": f"""WITH RECURSIVE {_SPLIT}
        SELECT doc_id, CAST(seg AS BIGINT) AS seg, length(source) AS chars, md5(source) AS digest, seg > 0 AS cont, CASE WHEN seg = 0 THEN 'a0' ELSE '' END AS anchor FROM cut""",
    "merged_paragraphs": """WITH heads AS (SELECT *, CASE WHEN role <> 'assistant' OR row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 THEN 1 ELSE 0 END AS head FROM conversations),
        numbered AS (SELECT *, sum(head) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS p FROM heads)
        SELECT conv_id, CAST(p AS BIGINT) AS paragraph, count(*) AS n_parts, md5(string_agg(text, '' ORDER BY turn)) AS digest FROM numbered GROUP BY conv_id, p""",
    "rolling_context": """WITH seen AS (SELECT conv_id, turn, coalesce(list(text) FILTER (role = 'assistant' AND regexp_matches(text, '\\S')) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []) AS l FROM conversations),
        last AS (SELECT conv_id, turn, l[greatest(1, len(l) - 2):] AS l FROM seen)
        SELECT conv_id, turn, len(l) AS n_context, md5(coalesce(array_to_string(l, '|'), '')) AS digest FROM last""",
    "text_chapters": """WITH parts AS (SELECT doc_id, unnest(string_split(replace(text, '.' || chr(10), '.' || chr(10) || '<cut>'), '<cut>')) AS body, generate_subscripts(string_split(replace(text, '.' || chr(10), '.' || chr(10) || '<cut>'), '<cut>'), 1) - 1 AS c FROM documents),
        stripped AS (SELECT doc_id, c, CASE WHEN c = 0 THEN 'Book' ELSE 'Part' END AS head, regexp_replace(body, '^\\n+|\\n+$', '', 'g') AS body FROM parts)
        SELECT doc_id, CAST(c AS BIGINT) AS chapter, 1 + CASE WHEN regexp_matches(body, '\\S') THEN 1 ELSE 0 END AS n_segments, CAST(1 AS BIGINT) AS n_headings, CASE WHEN regexp_matches(body, '\\S') THEN body ELSE head END AS last,
            CAST(length(head) + CASE WHEN regexp_matches(body, '\\S') THEN length(body) ELSE 0 END AS BIGINT) AS chars FROM stripped""",
    "heading_lines": """SELECT p_partkey, CASE p_partkey % 9 WHEN 6 THEN '第3章 ' || p_name WHEN 7 THEN '序章 ' || p_name WHEN 8 THEN 'あとがき' || p_name ELSE p_name END AS title,
        CAST(CASE p_partkey % 9 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 1 END AS BIGINT) AS level FROM part WHERE p_partkey % 9 IN (0, 1, 2, 6, 7, 8)""",
}
