"""Tables of contents: boundaries in an ordered stream, inheritance in a tree, titles."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchors_after(ids: DataFrame, blocks: DataFrame, doc: str) -> DataFrame:
    """The block at or after each id (doc, id, pos): (doc, id, anchor), anchor null after the last block.

    ``blocks`` has (doc, pos, anchor). Of equal ids the first counts. One sort per document: blocks and
    ids share a stream, and each id takes the first block that follows."""
    stream = ids.select(doc, "pos", F.lit(1).alias("_kind"), "id", F.lit(None).cast("string").alias("anchor")).unionByName(blocks.select(doc, "pos", F.lit(0).alias("_kind"), F.lit(None).cast("string").alias("id"), "anchor"))
    ahead = Window.partitionBy(doc).orderBy(F.desc("pos"), "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = stream.withColumn("anchor", F.last("anchor", ignorenulls=True).over(ahead)).where("_kind = 1")
    once = F.row_number().over(Window.partitionBy(doc, "id").orderBy("pos")) == 1
    return seen.withColumn("_once", once).where("_once").select(doc, "id", "anchor")


def locate(entries: DataFrame, resources: DataFrame, fragments: DataFrame) -> DataFrame:
    """Entries with ``pos``: the start of their resource, or of the block of their fragment.

    A fragment that is not there gives no position, not the start of the resource."""
    r = resources.select(F.col("href").alias("_href"), F.col("pos").alias("_start"))
    f = fragments.select(F.col("href").alias("_fh"), F.col("fragment").alias("_ff"), F.col("pos").alias("_at"))
    named = F.coalesce(F.length("fragment"), F.lit(0)) > 0
    joined = entries.join(r, F.col("href") == F.col("_href"), "left").join(f, (F.col("href") == F.col("_fh")) & (F.col("fragment") == F.col("_ff")), "left")
    return joined.withColumn("pos", F.when(named, F.col("_at")).otherwise(F.col("_start"))).drop("_href", "_start", "_fh", "_ff", "_at")


def inherit(entries: DataFrame, doc: str) -> DataFrame:
    """Entries (doc, node, parent, pos) in pre-order, where those without a position take that of their
    first descendant in order that has one.

    In pre-order the descendants of a node follow it directly, and each of them has a parent no smaller
    than the node. So the first located node that follows is a descendant just if no parent between is
    smaller, which takes two sorts and no walk through the tree. Other columns are carried."""
    back = Window.partitionBy(doc).orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = lambda value: F.last(F.when(F.col("pos").isNotNull(), value), ignorenulls=True).over(back)
    ahead = entries.withColumns({"_at": located(F.col("node")), "_found": located(F.col("pos"))})
    between = Window.partitionBy(doc, "_at").orderBy(F.desc("node")).rowsBetween(Window.unboundedPreceding, -1)
    least = F.min(F.coalesce("parent", F.lit(-(1 << 62)))).over(between)
    return ahead.withColumn("_least", least).withColumn("pos", F.when(F.col("pos").isNotNull(), F.col("pos")).when(F.col("_least") >= F.col("node"), F.col("_found"))).drop("_at", "_found", "_least")


def boundaries(entries: DataFrame, doc: str, deepest: int | None = 0) -> DataFrame:
    """One boundary per position from entries (doc, seq, depth, pos, anchored, external) of the top level, or down
    to a depth; null: of any.

    Anchored entries win over others; of the anchored the first, of the others the last."""
    level = (F.col("depth") >= 0) if deepest is None else F.col("depth").between(0, deepest)
    kept = entries.where(level & ~F.coalesce("external", F.lit(False)) & (F.col("pos") >= 0))
    anchored = F.coalesce("anchored", F.lit(False))
    order = F.struct(~anchored, F.when(anchored, F.col("seq")).otherwise(-F.col("seq")))
    # One is taken per position before anything is shuffled, however many entries share it.
    return kept.groupBy(doc, "pos").agg(F.min_by(F.struct(*kept.columns), order).alias("_b")).select("_b.*")


#: Which entries of a table of contents begin a chapter: functions of (entries, doc) that keep one per position.
STRATEGIES = {"top-level-toc": boundaries, "second-level-toc": partial(boundaries, deepest=1), "whole-toc": partial(boundaries, deepest=None)}


def strategy(name: str) -> Callable[[DataFrame, str], DataFrame]:
    """A way of cutting books into chapters; ValueError for an unknown name."""
    if name not in STRATEGIES:
        raise ValueError(f"unknown way of cutting chapters {name!r}; known: {', '.join(STRATEGIES)}")
    return STRATEGIES[name]


def slices(marks: DataFrame, doc: str, size: str) -> DataFrame:
    """Half-open ranges between boundaries (doc, pos) up to the size of the document; empty ones go."""
    end = F.coalesce(F.lead("pos").over(Window.partitionBy(doc).orderBy("pos")), F.col(size))
    return marks.withColumn("start", F.col("pos")).withColumn("end", end).where(F.col("end") > F.col("start"))


def assign(stream: DataFrame, marks: DataFrame, doc: str) -> DataFrame:
    """Segments (doc, pos) with ``chapter``: the boundaries at or before them; 0 is the front matter."""
    both = stream.select(doc, "pos", F.lit(1).alias("_k")).unionByName(marks.select(doc, "pos", F.lit(0).alias("_k")))
    running = Window.partitionBy(doc).orderBy("pos", "_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("chapter", F.sum((F.col("_k") == 0).cast("int")).over(running)).where("_k = 1").select(doc, "pos", "chapter")


def toc_titles(entries: DataFrame, headings: DataFrame, doc: str) -> DataFrame:
    """Entries with ``title_translated``: that of the heading with their anchor, if both texts are one
    when flattened."""
    from quire.functions.text import flat

    h = headings.select(F.col(doc).alias("_d"), F.col("anchor").alias("_a"), F.col("source").alias("_s"), F.col("target").alias("_t"))
    same = flat(F.col("title")) == flat(F.col("_s"))
    return entries.join(h, (F.col(doc) == F.col("_d")) & (F.col("anchor") == F.col("_a")), "left").withColumn("title_translated", F.when(same, F.col("_t"))).drop("_d", "_a", "_s", "_t")
