"""Rendering of documents: ordered joins of titles, texts and translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import fallback, html_escape, is_blank, strip


def shown(source: Column, target: Column) -> Column:
    """The target, or the source where the target is blank."""
    return fallback(target, source)


def shown_title(translated: Column, title: Column) -> Column:
    return strip(fallback(translated, title, F.lit("")))


def bilingual_source(source: Column, target: Column, kind: Column) -> Column:
    """The source to print beside a translation; null for headings, blanks and what equals it."""
    return F.when((kind != "heading") & ~is_blank(source) & ~strip(source).eqNullSafe(strip(target)), source)


def blocks(segments: DataFrame, key: list[str], bilingual: bool = False, source_first: bool = False, markdown: bool = False) -> DataFrame:
    """Rows (key..., seg, part, text) of what is printed, blank texts left out.

    ``segments`` has (key..., seg, kind, source, target[, level]); markdown puts # marks before headings,
    one where the level is not 1 to 6."""
    text = shown(F.col("source"), F.col("target"))
    if markdown:
        level = F.col("level") if "level" in segments.columns else F.lit(None).cast("int")
        marks = F.repeat(F.lit("#"), F.when(level.between(1, 6), level).otherwise(1))
        text = F.when(F.col("kind") == "heading", F.concat(marks, F.lit(" "), text)).otherwise(text)
    both = F.array(text)
    if bilingual:
        other = bilingual_source(F.col("source"), text, F.col("kind"))
        both = F.array(other, text) if source_first else F.array(text, other)
    each = segments.select(*key, "seg", F.posexplode(both).alias("part", "text"))
    return each.where(~is_blank(F.col("text")))


def joined(printed: DataFrame, key: list[str], order: list[str], separator: str = "\n\n") -> DataFrame:
    """One text per key: the printed blocks in order, with a newline at the end."""
    parts = F.array_sort(F.collect_list(F.struct(*order, "text")))
    return printed.groupBy(*key).agg(F.concat(F.array_join(F.transform(parts, lambda x: x["text"]), separator), F.lit("\n")).alias("text"))


def html_blocks(segments: DataFrame, key: list[str]) -> DataFrame:
    """Chapters without a template as HTML: escaped headings and paragraphs, one after another."""
    text = html_escape(shown(F.col("source"), F.col("target")))
    tag = F.when(F.col("kind") == "heading", "h2").otherwise("p")
    made = segments.withColumn("text", F.concat(F.lit("<"), tag, F.lit(">"), text, F.lit("</"), tag, F.lit(">")))
    return joined(made.where(~is_blank(F.col("source"))), key, ["seg"], "\n")


def image_offsets(offset: Column, source: Column, target: Column) -> Column:
    """Where an inline image of the source goes in the target: in proportion, rounded half to even."""
    n, m = F.length(source), F.length(target)
    at = F.bround(offset.cast("double") * m / F.nullif(n, F.lit(0)), 0).cast("int")
    return F.coalesce(F.least(F.greatest(at, F.lit(0)), m), F.lit(0))


def restored_offsets(images: DataFrame, key: list[str]) -> DataFrame:
    """Images (key..., node, offset, source, target) with ``at``, which never goes back within a text."""
    running = Window.partitionBy(*key).orderBy("node").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return images.withColumn("at", F.max(image_offsets(F.col("offset"), F.col("source"), F.col("target"))).over(running))


def state_mismatches(stored: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Stored segments whose anchor is gone or whose source has changed: key..., reason."""
    f = fresh.select(*key, F.col("source").alias("_now"), F.lit(True).alias("_there"))
    both = stored.join(f, key, "left")
    reason = F.when(F.col("_there").isNull(), "missing").when(~F.col("source").eqNullSafe(F.col("_now")), "changed")
    return both.withColumn("reason", reason).where("reason is not null").select(*key, "reason")


def bilingual_path(path: Column) -> Column:
    """The path with -bi before its extension."""
    return F.regexp_replace(path, r"^(.*?)(\.[^./\\]*)?$", "$1-bi$2")
