"""Queries on tables of contents: a tree of regions, nations and customers over a stream of positions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import toc
from quire.plans.packing import long
from quire.session import table


def _doc(nation, key):
    """A document is a thousand ids of a nation, so that no group grows with the table."""
    return (F.col(nation).cast("long") * 10**12 + F.floor(F.col(key) / 1000)).alias("doc")


def _marks(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        _doc("c_nationkey", "c_custkey"), F.col("c_custkey").alias("seq"), (F.col("c_custkey") % 3 - 1).cast("int").alias("depth"), (F.col("c_custkey") % 41 - 2).alias("pos"),
        (F.col("c_custkey") % 5 == 0).alias("anchored"), F.when(F.col("c_custkey") % 17 == 0, True).alias("external"),
    )


def toc_boundaries(spark, sf_dir):
    return toc.boundaries(_marks(spark, sf_dir), "doc").select("doc", "pos", "seq")


def toc_boundaries_deep(spark, sf_dir):
    """Chapters begin at entries of the first two levels."""
    return toc.strategy("second-level-toc")(_marks(spark, sf_dir), "doc").select("doc", "pos", "seq")


def toc_slices(spark, sf_dir):
    marks = toc.boundaries(_marks(spark, sf_dir), "doc").withColumn("size", F.lit(36).cast("long"))
    return toc.slices(marks, "doc", "size").select("doc", long("start"), long("end"))


def toc_chapters(spark, sf_dir):
    stream = table(spark, sf_dir, "supplier").select(_doc("s_nationkey", "s_suppkey"), (F.col("s_suppkey") % 45).alias("pos"))
    return toc.assign(stream, toc.boundaries(_marks(spark, sf_dir), "doc"), "doc").select("doc", "pos", long("chapter"))


def _tree(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    region = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("doc"), (F.col("r_regionkey").cast("long") * 10**14).alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(None).cast("long").alias("pos"))
    nation_node = F.col("n_regionkey").cast("long") * 10**14 + 1 + F.col("n_nationkey").cast("long") * 10**12
    nation = n.select(F.col("n_regionkey").alias("doc"), nation_node.alias("node"), (F.col("n_regionkey").cast("long") * 10**14).alias("parent"), F.when(F.col("n_nationkey") % 6 == 5, F.col("n_nationkey").cast("long")).alias("pos"))
    leaf = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("n_regionkey").alias("doc"), (nation_node + 1 + F.col("c_custkey")).alias("node"), nation_node.alias("parent"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).alias("pos"))
    return region.unionAll(nation).unionAll(leaf)


def toc_inherit(spark, sf_dir):
    return toc.inherit(_tree(spark, sf_dir), "doc").select("node", F.coalesce("pos", F.lit(-1)).alias("pos"))


def toc_locate(spark, sf_dir):
    entries = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("href"), F.when(F.col("p_partkey") % 3 > 0, F.concat(F.lit("f"), F.col("p_size") % 30)).alias("fragment"))
    resources = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("href")).agg(F.min("p_partkey").alias("pos")).where("href <> 'Brand#11'")
    fragments = table(spark, sf_dir, "part").where("p_size < 20").groupBy(F.col("p_brand").alias("href"), F.concat(F.lit("f"), "p_size").alias("fragment")).agg(F.max("p_partkey").alias("pos"))
    return toc.locate(entries, resources, fragments).select("p_partkey", F.coalesce("pos", F.lit(-1)).alias("pos"))


def _anchors(t):
    ids = t.where("l_linenumber % 2 = 1").select(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 100).alias("pos"), F.concat(F.lit("i"), F.col("l_suppkey") % 5).alias("id"))
    blocks = t.where("l_linenumber % 2 = 0").groupBy(F.col("l_orderkey").alias("doc"), (F.col("l_partkey") % 100).alias("pos")).agg(F.concat(F.lit("b"), F.min("l_linenumber")).alias("anchor"))
    return toc.anchors_after(ids, blocks, "doc")


def fragment_anchors(spark, sf_dir):
    return _anchors(table(spark, sf_dir, "lineitem"))


def toc_titles(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    entries = c.select(F.lit(0).alias("doc"), "c_custkey", F.col("c_name").alias("anchor"), F.concat(F.lit(" "), "c_mktsegment", F.lit("  x")).alias("title"))
    headings = c.where("c_custkey % 3 > 0").select(F.lit(0).alias("doc"), F.col("c_name").alias("anchor"), F.concat("c_mktsegment", F.when(F.col("c_custkey") % 2 == 0, F.lit("\n x")).otherwise(" y")).alias("source"), F.lower("c_mktsegment").alias("target"))
    return toc.toc_titles(entries, headings, "doc").select("c_custkey", "title_translated")


QUERIES = {f.__name__: f for f in (toc_boundaries, toc_boundaries_deep, toc_slices, toc_chapters, toc_inherit, toc_locate, fragment_anchors, toc_titles)}

_DEEP = """SELECT doc, pos, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY anchored DESC, CASE WHEN anchored THEN seq ELSE -seq END) AS r FROM m WHERE depth IN (0, 1) AND pos >= 0) WHERE r = 1"""
_B = """m AS (SELECT CAST(c_nationkey AS BIGINT) * 1000000000000 + c_custkey // 1000 AS doc, c_custkey AS seq, c_custkey % 3 - 1 AS depth, c_custkey % 41 - 2 AS pos, c_custkey % 5 = 0 AS anchored FROM customer WHERE c_custkey % 17 <> 0),
    b AS (SELECT doc, pos, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc, pos ORDER BY anchored DESC, CASE WHEN anchored THEN seq ELSE -seq END) AS r FROM m WHERE depth = 0 AND pos >= 0) WHERE r = 1)"""
ORACLE = {
    "toc_boundaries": f"WITH {_B} SELECT doc, pos, seq FROM b",
    "toc_boundaries_deep": f"WITH {_B} {_DEEP}",
    "toc_slices": f"WITH {_B}, s AS (SELECT doc, pos AS start, coalesce(lead(pos) OVER (PARTITION BY doc ORDER BY pos), 36) AS \"end\" FROM b) SELECT doc, start, CAST(\"end\" AS BIGINT) AS \"end\" FROM s WHERE \"end\" > start",
    "toc_chapters": f"WITH {_B}, s AS (SELECT CAST(s_nationkey AS BIGINT) * 1000000000000 + s_suppkey // 1000 AS doc, s_suppkey % 45 AS pos FROM supplier) SELECT doc, pos, (SELECT count(*) FROM b WHERE b.doc = s.doc AND b.pos <= s.pos) AS chapter FROM s",
    "toc_inherit": """WITH n AS (SELECT n_nationkey, CAST(n_regionkey AS BIGINT) * 100000000000000 + 1 + CAST(n_nationkey AS BIGINT) * 1000000000000 AS node, CAST(n_regionkey AS BIGINT) * 100000000000000 AS parent, CASE WHEN n_nationkey % 6 = 5 THEN CAST(n_nationkey AS BIGINT) END AS pos FROM nation),
        l AS (SELECT n.node + 1 + c_custkey AS node, n.node AS parent, CASE WHEN c_custkey % 4 = 0 THEN c_custkey END AS pos FROM customer JOIN n ON c_nationkey = n_nationkey),
        n2 AS (SELECT node, parent, pos, coalesce(pos, (SELECT arg_min(l.pos, l.node) FROM l WHERE l.parent = n.node AND l.pos IS NOT NULL)) AS got FROM n),
        own AS (SELECT node, parent, pos FROM n UNION ALL SELECT l.node, n.parent, l.pos FROM l JOIN n ON l.parent = n.node)
        SELECT node, coalesce(pos, -1) AS pos FROM l UNION ALL SELECT node, coalesce(got, -1) FROM n2
        UNION ALL SELECT CAST(r_regionkey AS BIGINT) * 100000000000000, coalesce((SELECT arg_min(own.pos, own.node) FROM own WHERE own.parent = CAST(r_regionkey AS BIGINT) * 100000000000000 AND own.pos IS NOT NULL), -1) FROM region""",
    "toc_locate": """WITH r AS (SELECT p_brand AS href, min(p_partkey) AS pos FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1), f AS (SELECT p_brand AS href, 'f' || p_size AS fragment, max(p_partkey) AS pos FROM part WHERE p_size < 20 GROUP BY 1, 2)
        SELECT p.p_partkey, coalesce(CASE WHEN p.p_partkey % 3 > 0 THEN f.pos ELSE r.pos END, -1) AS pos FROM part p LEFT JOIN r ON r.href = p.p_brand LEFT JOIN f ON f.href = p.p_brand AND f.fragment = 'f' || (p.p_size % 30)""",
    "fragment_anchors": """WITH i AS (SELECT l_orderkey AS doc, 'i' || (l_suppkey % 5) AS id, min(l_partkey % 100) AS pos FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1, 2),
        b AS (SELECT l_orderkey AS doc, l_partkey % 100 AS pos, 'b' || min(l_linenumber) AS anchor FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1, 2)
        SELECT i.doc, i.id, b.anchor FROM i ASOF LEFT JOIN b ON i.doc = b.doc AND i.pos <= b.pos""",
    "toc_titles": "SELECT c_custkey, CASE WHEN c_custkey % 3 > 0 AND c_custkey % 2 = 0 THEN lower(c_mktsegment) END AS title_translated FROM customer",
}
