"""Queries on checks, reports, reviews and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import checks, memory
from quire.plans.packing import long
from quire.session import table


def _pairs(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    a = t.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("source"))
    b = t.where("role = 'assistant'").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.col("text").alias("target"))
    return a.join(b, (F.col("conv_id") == F.col("c")) & (F.col("turn") + 1 == F.col("t")), "left")


def length_flags(spark, sf_dir):
    flagged = _pairs(spark, sf_dir).withColumn("f", checks.length_flag(F.col("source"), F.col("target"))).where("f is not null")
    return flagged.select("conv_id", "turn", F.round("f.ratio", 9).alias("ratio"), F.col("f.reason").alias("reason"))


def accepted_fixes(spark, sf_dir):
    return _pairs(spark, sf_dir).where(checks.accepts_fix(F.col("source"), F.col("target"))).select("conv_id", "turn")


def _chapters(spark, sf_dir):
    d, l = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    state = d.select("doc_id", "text", "source").join(l, "doc_id", "left")
    return state.select(
        F.col("doc_id").alias("chapter"), "text", "source", F.when(F.col("quality") == 1, "done").otherwise("pending").alias("status"),
        F.when(F.col("toxic") == 0, "done").otherwise("pending").alias("review_status"), (F.col("doc_id") % 4).alias("n_issues"), (F.col("doc_id") % 3).alias("n_empty"),
    )


def report_summary(spark, sf_dir):
    return checks.report_summary(_chapters(spark, sf_dir))


def pending_chapters(spark, sf_dir):
    return memory.pending(_chapters(spark, sf_dir)).select("chapter")


def empty_targets(spark, sf_dir):
    segs = _chapters(spark, sf_dir).select("chapter", F.lit(0).alias("seg"), F.col("text").alias("source"), "status", F.when(F.col("chapter") % 7 != 0, F.col("text")).alias("target"))
    return checks.empty_targets(segs).select("chapter", long("seg"), "head")


def review_index_map(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    chunk = (F.col("l_linenumber") % 2).alias("chunk")
    index = F.when(F.col("l_partkey") % 5 == 0, F.lit("x")).otherwise(F.concat(F.lit(" "), (F.col("l_linenumber") - 1).cast("string"))).alias("index")
    issues = l.select(F.col("l_orderkey").alias("chapter"), chunk, index, "l_suppkey")
    sizes = l.select(F.col("l_orderkey").alias("chapter"), chunk).distinct().withColumn("n", F.lit(3))
    return checks.remap_issues(issues, sizes).select("chapter", long("chunk"), long("index"), "l_suppkey")


def _issues(spark, sf_dir):
    kind = F.get(F.array(*(F.lit(x) for x in ("missing", "style", "mistranslation", "term"))), (F.col("l_suppkey") % 4).cast("int"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("chapter"), (F.col("l_linenumber") % 3).cast("long").alias("seg"), kind.alias("type"), F.concat("l_returnflag", F.lit("-"), "l_partkey").alias("detail"), F.col("l_linenumber").alias("seq"))


def severe_feedback(spark, sf_dir):
    return checks.severe_feedback(_issues(spark, sf_dir), ["chapter", "seg"])


def neighbour_context(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seg"), "role")
    out = checks.neighbours(t, ["conv_id"], "role")
    return out.select("conv_id", F.col("seg").alias("turn"), F.array_join("before", ",").alias("before"), F.array_join("after", ",").alias("after"))


def _book():
    return F.concat_ws("/", "source", F.floor(F.col("doc_id") / 1000))


def sample_text(spark, sf_dir):
    """A book is a thousand ids of a source, so that no group grows with the table."""
    out = checks.sample_text(table(spark, sf_dir, "documents").withColumn("book", _book()), "book", "doc_id", "text")
    return out.select("book", "place", F.md5(F.col("sample").cast("binary")).alias("digest"), F.length("sample").cast("long").alias("chars"))


def qa_digest(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("seg"), F.when(F.col("role") != "system", F.col("text")).alias("target"))
    return checks.qa_digest(t, ["conv_id"], "target").select("conv_id", F.md5(F.col("digest").cast("binary")).alias("digest"))


def numbered_lines(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("t"))
    return t.select("conv_id", F.md5(checks.numbered(F.col("t")).cast("binary")).alias("digest"))


def _digests(spark, sf_dir, version: str):
    d = table(spark, sf_dir, "documents").groupBy("source", _book().alias("book")).agg(F.sort_array(F.collect_list(F.concat(F.lit("doc"), "doc_id"))).alias("s"), F.sort_array(F.collect_set("lang")).alias("l"))
    return d.select("book", "source", checks.review_digest(F.col("s"), F.when(F.col("source") > "src5", F.array(F.lit(version))).otherwise(F.col("l")), src="en", tgt="zh", version=1).alias("digest"))


def review_digest(spark, sf_dir):
    return _digests(spark, sf_dir, "b").drop("source")


def review_reuse(spark, sf_dir):
    stored = _digests(spark, sf_dir, "a").withColumn("review_status", F.when(F.col("source") == "src1", "failed").otherwise("done"))
    return checks.to_review(_digests(spark, sf_dir, "b"), stored, ["book"]).select("book")


QUERIES = {
    f.__name__: f
    for f in (length_flags, accepted_fixes, report_summary, pending_chapters, empty_targets, review_index_map, severe_feedback, neighbour_context, sample_text, qa_digest, numbered_lines, review_digest, review_reuse)
}

_PAIRS = """pairs AS (SELECT a.conv_id, a.turn, length(regexp_replace(a.text, '^\\s+|\\s+$', '', 'g')) AS n, length(regexp_replace(coalesce(b.text, ''), '^\\s+|\\s+$', '', 'g')) AS m
        FROM (SELECT * FROM conversations WHERE role = 'user') a LEFT JOIN (SELECT * FROM conversations WHERE role = 'assistant') b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)"""
_CHAPTERS = """chapters AS (SELECT d.doc_id AS chapter, d.text, CASE WHEN l.quality = 1 THEN 'done' ELSE 'pending' END AS status, CASE WHEN l.toxic = 0 THEN 'done' ELSE 'pending' END AS review_status,
        d.doc_id % 4 AS n_issues, d.doc_id % 3 AS n_empty FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
_SQL_BOOK = "source || '/' || (doc_id // 1000)"
_DIGEST = f"""SELECT {_SQL_BOOK} AS book, sha256('{{"src":"en","tgt":"zh","version":1,"segments":[' || string_agg('"doc' || doc_id || '"', ',' ORDER BY 'doc' || doc_id) || '],"terms":['
        || CASE WHEN source > 'src5' THEN '"%s"' ELSE array_to_string(list_sort(list_distinct(list('"' || lang || '"'))), ',') END || ']}}') AS digest FROM documents GROUP BY source, doc_id // 1000"""
ORACLE = {
    "length_flags": f"""WITH {_PAIRS} SELECT conv_id, turn, round(CASE WHEN m = 0 THEN 0.0 ELSE m / n END, 9) AS ratio, CASE WHEN m = 0 THEN 'empty' WHEN m / n < 0.3 THEN 'too_short' ELSE 'too_long' END AS reason
        FROM pairs WHERE n > 0 AND (m = 0 OR m / n < 0.3 OR m / n > 3.0)""",
    "accepted_fixes": f"WITH {_PAIRS} SELECT conv_id, turn FROM pairs WHERE m > 0 AND (n = 0 OR m / n BETWEEN 0.3 AND 3.0)",
    "report_summary": f"""WITH {_CHAPTERS} SELECT count(*) AS chapters, count(*) FILTER (status = 'done') AS done, count(*) FILTER (status <> 'done') AS pending, count(*) FILTER (status = 'done' AND review_status = 'done') AS reviewed,
        CAST(coalesce(sum(n_issues) FILTER (status = 'done' AND review_status = 'done'), 0) AS BIGINT) AS issues, CAST(coalesce(sum(n_empty) FILTER (status = 'done'), 0) AS BIGINT) AS empty FROM chapters""",
    "pending_chapters": f"WITH {_CHAPTERS} SELECT chapter FROM chapters WHERE status <> 'done'",
    "empty_targets": f"WITH {_CHAPTERS} SELECT chapter, CAST(0 AS BIGINT) AS seg, left(text, 60) AS head FROM chapters WHERE status = 'done' AND chapter % 7 = 0 AND regexp_matches(text, '\\S')",
    "review_index_map": """WITH first AS (SELECT l_orderkey, min(l_linenumber % 2) AS lo, count(DISTINCT l_linenumber % 2) AS k FROM lineitem GROUP BY 1)
        SELECT l.l_orderkey AS chapter, CAST(l_linenumber % 2 AS BIGINT) AS chunk, CAST(l_linenumber - 1 + CASE WHEN l_linenumber % 2 > f.lo THEN 3 ELSE 0 END AS BIGINT) AS index, l_suppkey
        FROM lineitem l JOIN first f ON l.l_orderkey = f.l_orderkey WHERE l_partkey % 5 <> 0 AND l_linenumber - 1 BETWEEN 0 AND 2""",
    "severe_feedback": """SELECT l_orderkey AS chapter, CAST(l_linenumber % 3 AS BIGINT) AS seg, count(*) AS n, string_agg(l_returnflag || '-' || l_partkey, '; ' ORDER BY l_linenumber, l_returnflag || '-' || l_partkey) AS feedback
        FROM lineitem WHERE l_suppkey % 4 IN (0, 2) GROUP BY 1, 2""",
    "neighbour_context": """SELECT conv_id, turn, coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '') AS before,
        coalesce(string_agg(role, ',') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING), '') AS after FROM conversations""",
    "sample_text": f"""WITH r AS (SELECT {_SQL_BOOK} AS book, text, row_number() OVER (PARTITION BY source, doc_id // 1000 ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY source, doc_id // 1000) AS n FROM documents WHERE length(text) > 200),
        p AS (SELECT *, CASE WHEN i = 0 THEN 'first' WHEN i = n // 2 THEN 'middle' WHEN i = n - 1 THEN 'last' END AS place FROM r)
        SELECT book, place, md5(s) AS digest, length(s) AS chars FROM (SELECT book, place, CASE WHEN place = 'last' THEN right(text, 2800) ELSE left(text, 2800) END AS s FROM p WHERE place IS NOT NULL)""",
    "qa_digest": """WITH t AS (SELECT conv_id, list(CASE WHEN role <> 'system' THEN text ELSE '' END ORDER BY turn) AS t FROM conversations GROUP BY conv_id)
        SELECT conv_id, md5(left(array_to_string(list_filter(list_concat(t[1:3], CASE WHEN len(t) > 3 THEN t[len(t) - 1:] ELSE [] END), lambda x: x <> ''), '……'), 600)) AS digest FROM t""",
    "numbered_lines": "WITH t AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) SELECT conv_id, md5(string_agg('[' || i || '] ' || text, chr(10) ORDER BY i)) AS digest FROM t GROUP BY conv_id",
    "review_digest": _DIGEST % "b",
    "review_reuse": f"SELECT DISTINCT {_SQL_BOOK} AS book FROM documents WHERE source > 'src5' OR source = 'src1'",
}
