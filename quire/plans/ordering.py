"""Queries on ordered rows, titles and extracted records."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import extraction, ordered, segments
from quire.plans.packing import long
from quire.session import table


def _turns(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select(
        "conv_id", F.col("turn").alias("seg"), F.when(F.col("turn") % 3 == 0, "heading").otherwise("text").alias("kind"), F.when(F.col("turn") % 3 == 0, F.concat(F.lit("a"), "turn")).alias("anchor"),
        (F.col("turn") % 3 == 1).alias("cont"), F.col("text").alias("source"), F.when((F.col("conv_id") + F.col("turn")) % 5 > 0, F.concat(F.lit("T"), "text")).alias("target"),
    )


def anchor_merge(spark, sf_dir):
    out = segments.anchored_texts(_turns(spark, sf_dir), ["conv_id"])
    return out.select("conv_id", "anchor", F.md5(F.col("source").cast("binary")).alias("source"), F.coalesce(F.md5(F.col("target").cast("binary")), F.lit("-")).alias("target"))


def first_headings(spark, sf_dir):
    out = ordered.first_headings(_turns(spark, sf_dir).where("seg > 0"), ["conv_id"])
    return out.select("conv_id", F.md5(F.col("source").cast("binary")).alias("digest"))


def chapter_titles(spark, sf_dir):
    heads = ordered.first_headings(_turns(spark, sf_dir), ["conv_id"])
    chapters = table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit(" "), F.replace("text", F.lit(" "), F.lit("  ")))).otherwise("other").alias("title"))
    return ordered.chapter_titles(chapters, heads, ["conv_id"]).select("conv_id", F.coalesce(F.md5(F.col("title_translated").cast("binary")), F.lit("-")).alias("digest"))


def tail_targets(spark, sf_dir):
    return ordered.tail(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", 2).select("conv_id", "turn", "role")


def distinct_in_order(spark, sf_dir):
    return ordered.distinct_in_order(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id").select("user_id", "event_type", long("position"))


def positional_pairs(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("role") == "user", F.struct("turn", "text")))).alias("u"), F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("turn", "text")))).alias("a"))
    pairs = t.select("conv_id", F.posexplode(ordered.zipped(F.col("u"), F.col("a"))).alias("k", "p"))
    return pairs.select("conv_id", long("k"), F.col("p.left.turn").alias("user_turn"), F.col("p.right.turn").alias("assistant_turn"))


def back_translation_sample(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where(ordered.sampled(F.concat_ws("-", "conv_id", "turn"), 0.2)).select("conv_id", "turn")


def internal_titles(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.upper("p_brand"), F.lit(" "))).when(F.col("p_partkey") % 3 == 1, F.col("p_type")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", ordered.internal_title(title, F.col("p_brand"), F.col("p_type")).alias("internal"))


def style_briefs(spark, sf_dir):
    brief = ordered.style_brief({"tone": F.when(F.col("p_partkey") % 2 == 0, F.col("p_type")), "voice": F.concat(F.lit(" "), "p_name"), "notes": F.lit("  ")})
    return table(spark, sf_dir, "part").select("p_partkey", brief.alias("brief"))


_REPLY = """CASE event_id % 6 WHEN 0 THEN '[{"source": " a' || event_id || ' ", "target": 5, "gender": "Unknown", "reading": true}, 3, {"source": "x"}]'
    WHEN 1 THEN '{"source": "a", "target": "b"}' WHEN 2 THEN '[broken' WHEN 3 THEN '[{"source": "", "target": "b"}, {"source": "s", "target": "t", "note": {"a": 1}, "type": "' || event_type || '"}]'
    WHEN 4 THEN '[]' ELSE NULL END"""


def extracted_terms(spark, sf_dir):
    replies = table(spark, sf_dir, "events").select("event_id", F.expr(_REPLY).alias("reply"))
    return extraction.extracted_terms(replies, ["event_id"]).withColumn("position", long("position"))


QUERIES = {
    f.__name__: f
    for f in (anchor_merge, first_headings, chapter_titles, tail_targets, distinct_in_order, positional_pairs, back_translation_sample, internal_titles, style_briefs, extracted_terms)
}

_T = """t AS (SELECT conv_id, turn AS seg, turn % 3 = 0 AS head, turn % 3 = 1 AS cont, text AS source, CASE WHEN (conv_id + turn) % 5 > 0 THEN 'T' || text END AS target FROM conversations)"""
ORACLE = {
    "anchor_merge": f"""WITH {_T}, a AS (SELECT *, max(CASE WHEN head THEN seg END) OVER (PARTITION BY conv_id ORDER BY seg ROWS UNBOUNDED PRECEDING) AS owner FROM t)
        SELECT conv_id, 'a' || owner AS anchor, md5(string_agg(source, '' ORDER BY seg)) AS source, CASE WHEN bool_and(coalesce(regexp_matches(target, '\\S'), FALSE)) THEN md5(string_agg(target, '' ORDER BY seg)) ELSE '-' END AS target
        FROM a WHERE (head OR cont) AND owner IS NOT NULL GROUP BY conv_id, owner""",
    "first_headings": f"WITH {_T} SELECT conv_id, md5(arg_min(source, seg)) AS digest FROM t WHERE head AND seg > 0 GROUP BY conv_id",
    "chapter_titles": "SELECT conv_id, CASE WHEN conv_id % 2 = 0 AND conv_id % 5 > 0 THEN md5('T' || text) ELSE '-' END AS digest FROM conversations WHERE turn = 0",
    "tail_targets": "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 2",
    "distinct_in_order": "SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY a) - 1 AS position FROM (SELECT user_id, event_type, min(event_id) AS a FROM events GROUP BY 1, 2)",
    "positional_pairs": """WITH n AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS k FROM conversations)
        SELECT u.conv_id, u.k, u.turn AS user_turn, a.turn AS assistant_turn FROM n u JOIN n a ON a.conv_id = u.conv_id AND a.k = u.k WHERE u.role = 'user' AND a.role = 'assistant'""",
    "back_translation_sample": "SELECT conv_id, turn FROM conversations WHERE CAST('0x' || substr(md5(conv_id || '-' || turn), 1, 8) AS UINTEGER) < 858993459",
    "internal_titles": "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN TRUE WHEN 1 THEN TRUE ELSE lower(trim(p_name)) IN (lower(p_brand), lower(trim(p_type))) END AS internal FROM part",
    "style_briefs": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'tone: ' || p_type || chr(10) ELSE '' END || 'voice: ' || p_name AS brief FROM part",
    "extracted_terms": """SELECT event_id, CAST(0 AS BIGINT) AS position, 'a' || event_id AS source, '5' AS target, '' AS reading, '' AS type, '' AS gender, '' AS note FROM events WHERE event_id % 6 = 0
        UNION ALL SELECT event_id, 1, 's', 't', '', event_type, '', '' FROM events WHERE event_id % 6 = 3""",
}
