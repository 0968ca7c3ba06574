"""Small operators on ordered rows: tails, first occurrences, positional pairs, seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import flat, strip


def tail(df: DataFrame, key: list[str], order: str, k: int) -> DataFrame:
    """The last ``k`` rows of each key."""
    last = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))
    return df.withColumn("_r", last).where(F.col("_r") <= k).drop("_r")


def distinct_in_order(df: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """Each value of a key once, at its first place, renumbered from 0 as ``position``."""
    first = df.groupBy(*key, value).agg(F.min(order).alias("_at"))
    return first.withColumn("position", F.row_number().over(Window.partitionBy(*key).orderBy("_at")) - 1).drop("_at")


def zipped(left: Column, right: Column) -> Column:
    """Pairs of two arrays by position, as long as the shorter one."""
    n = F.least(F.size(left), F.size(right))
    return F.slice(F.zip_with(left, right, lambda a, b: F.struct(a.alias("left"), b.alias("right"))), 1, n)


def first_headings(segments: DataFrame, key: list[str]) -> DataFrame:
    """The first heading of each chapter: key..., source, target. Without one there is no row."""
    heads = segments.where("kind = 'heading'")
    return heads.groupBy(*key).agg(F.min_by("source", "seg").alias("source"), F.min_by("target", "seg").alias("target"))


def chapter_titles(chapters: DataFrame, headings: DataFrame, key: list[str]) -> DataFrame:
    """Chapters (key..., title) with ``title_translated`` of their first heading, if both texts are one
    when flattened."""
    h = headings.withColumnsRenamed({"source": "_s", "target": "_t"})
    return chapters.join(h, key, "left").withColumn("title_translated", F.when(flat(F.col("title")) == flat(F.col("_s")), F.col("_t"))).drop("_s", "_t")


def internal_title(title: Column, stem: Column, book: Column) -> Column:
    """Whether a title only repeats the name of its file or of the book."""
    t = F.lower(strip(title))
    return (t == F.lower(strip(stem))) | (t == F.lower(strip(book)))


def sampled(key: Column, rate: float) -> Column:
    """Whether a row is in a sample of about ``rate``; the same rows on every run."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") < int(rate * (1 << 32))


def style_brief(fields: dict[str, Column]) -> Column:
    """One line "name: text" for each field that is not blank."""
    return F.concat_ws("\n", *(F.when(F.length(strip(c)) > 0, F.concat(F.lit(f"{name}: "), strip(c))) for name, c in fields.items()))
