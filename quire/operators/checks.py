"""Checks of translated segments and the reports on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import is_blank, strip

TOO_SHORT, TOO_LONG = 0.30, 3.0
SEVERE = ("missing", "mistranslation")


def length_flag(source: Column, target: Column, too_short: float = TOO_SHORT, too_long: float = TOO_LONG) -> Column:
    """struct(ratio, reason) of stripped lengths, null where nothing is wrong or the source is blank."""
    n, m = F.length(strip(source)), F.length(strip(F.coalesce(target, F.lit(""))))
    ratio = m / F.nullif(n, F.lit(0))
    flag = lambda r, why: F.struct(r.alias("ratio"), F.lit(why).alias("reason"))
    return F.when(F.coalesce(n, F.lit(0)) == 0, None).when(m == 0, flag(F.lit(0.0), "empty")).when(ratio < too_short, flag(ratio, "too_short")).when(ratio > too_long, flag(ratio, "too_long"))


def accepts_fix(source: Column, fixed: Column) -> Column:
    """Whether a new text may replace the old one: not blank and without a length flag."""
    return ~is_blank(fixed) & length_flag(source, fixed).isNull()


def remap_issues(issues: DataFrame, sizes: DataFrame) -> DataFrame:
    """Map issue indexes of review chunks to their chapter.

    ``issues`` has (chapter, chunk, index as text, type, ...), ``sizes`` (chapter, chunk, n). Indexes
    that are no integers or out of range are dropped."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("chapter").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select("chapter", "chunk", "n", before.alias("_base"))
    number = F.expr("try_cast(trim(`index`) AS int)")
    return issues.withColumn("_i", number).join(base, ["chapter", "chunk"]).where((F.col("_i") >= 0) & (F.col("_i") < F.col("n"))).withColumn("index", F.col("_i") + F.col("_base")).drop("_i", "_base", "n")


def severe_feedback(issues: DataFrame, key: list[str]) -> DataFrame:
    """Feedback on severe issues by segment: key columns, n, feedback in order of ``seq``."""
    kept = issues.where(F.col("type").isin(*SEVERE))
    parts = F.array_sort(F.collect_list(F.struct("seq", "detail")))
    return kept.groupBy(*key).agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["detail"]), "; ").alias("feedback"))


def neighbours(segments: DataFrame, key: list[str], text: str, reach: int = 2) -> DataFrame:
    """Each segment with the texts of up to ``reach`` segments before and after it."""
    w = Window.partitionBy(*key).orderBy("seg")
    return segments.withColumn("before", F.collect_list(text).over(w.rowsBetween(-reach, -1))).withColumn("after", F.collect_list(text).over(w.rowsBetween(1, reach)))


def rolling_context(segments: DataFrame, doc: str, order: list[str], target: str, n: int = 6) -> DataFrame:
    """Each segment with the last ``n`` non-blank targets before it, across chapters.

    Blank targets are no context but see what came before them."""
    w = Window.partitionBy(doc).orderBy(*order)
    filled = ~is_blank(F.col(target))
    running = w.rowsBetween(Window.unboundedPreceding, -1)
    seen = segments.withColumn("_seen", F.count(F.when(filled, 1)).over(running))
    # The frame of the non-blank rows alone holds exactly the last n; blank rows look it up by count.
    dense = seen.where(filled).select(doc, F.col("_seen").alias("_at"), F.collect_list(target).over(w.rowsBetween(-(n - 1), 0)).alias("context"))
    b = dense.select(F.col(doc).alias("_d"), (F.col("_at") + 1).alias("_after"), "context")
    joined = seen.join(b, (F.col(doc) == F.col("_d")) & (F.col("_seen") == F.col("_after")), "left")
    return joined.withColumn("context", F.coalesce("context", F.array().cast("array<string>"))).drop("_seen", "_d", "_after")


def progress(batches: DataFrame) -> DataFrame:
    """One row (done, total): items in fully done batches and all items, from resume batches."""
    n = F.size("items")
    return batches.agg(F.coalesce(F.sum(F.when(F.col("done"), n)), F.lit(0)).alias("done"), F.coalesce(F.sum(n), F.lit(0)).alias("total"))


def empty_targets(segments: DataFrame, target: str = "target") -> DataFrame:
    """Segments of done chapters without a target: chapter, seg, the first 60 characters."""
    return segments.where((F.col("status") == "done") & ~is_blank(F.col("source")) & is_blank(F.col(target))).select("chapter", "seg", F.substring("source", 1, 60).alias("head"))


def report_summary(chapters: DataFrame) -> DataFrame:
    """One row of totals over chapters (status, review_status, n_issues, n_empty).

    Issues count for chapters that are done and reviewed, empty targets for those that are done."""
    done = F.col("status") == "done"
    reviewed = done & (F.col("review_status") == "done")
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    return chapters.agg(
        F.count("*").alias("chapters"), F.count_if(done).alias("done"), F.count_if(~done).alias("pending"), F.count_if(reviewed).alias("reviewed"),
        total("n_issues", reviewed).alias("issues"), total("n_empty", done).alias("empty"),
    )


def sample_text(chapters: DataFrame, book: str, order: str, text: str, least: int = 200, most: int = 2800) -> DataFrame:
    """Samples of each book: the heads of its first and middle and the tail of its last long chapter.

    A chapter is taken once, under the first place it fills. Rows (book, place, sample); books without
    a long chapter have no rows."""
    long = chapters.where(F.length(text) > least)
    w = Window.partitionBy(book)
    ranked = long.withColumn("_i", F.row_number().over(w.orderBy(order)) - 1).withColumn("_n", F.count("*").over(w))
    place = F.when(F.col("_i") == 0, "first").when(F.col("_i") == F.floor(F.col("_n") / 2), "middle").when(F.col("_i") == F.col("_n") - 1, "last")
    sample = F.when(F.col("place") == "last", F.right(text, F.lit(most))).otherwise(F.substring(text, 1, most))
    return ranked.withColumn("place", place).where("place is not null").select(book, "place", sample.alias("sample"))


def qa_digest(segments: DataFrame, key: list[str], target: str, most: int = 600) -> DataFrame:
    """Per chapter its first three and, if there are more than three, last two targets, without blanks,
    joined and cut to ``most`` characters."""
    items = segments.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("seg", F.coalesce(target, F.lit("")).alias("t")))), lambda x: x["t"]).alias("t"))
    tail = F.when(F.size("t") > 3, F.slice("t", -2, 2)).otherwise(F.array().cast("array<string>"))
    picked = F.filter(F.concat(F.slice("t", 1, 3), tail), lambda x: F.length(x) > 0)
    return items.select(*key, F.substring(F.array_join(picked, "……"), 1, most).alias("digest"))


def numbered(items: Column) -> Column:
    """One line "[i] text" for each item of an array."""
    return F.array_join(F.transform(items, lambda x, i: F.concat(F.lit("["), i.cast("string"), F.lit("] "), x)), "\n")


def review_digest(segments: Column, terms: Column, **settings) -> Column:
    """sha256 of a canonical JSON of settings, segments and terms: equal inputs, equal digest."""
    fields = [F.lit(v).alias(k) for k, v in sorted(settings.items())]
    return F.sha2(F.to_json(F.struct(*fields, segments.alias("segments"), terms.alias("terms")), {"ignoreNullFields": "false"}), 256)


def to_review(current: DataFrame, stored: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Chapters whose review cannot be reused: all if forced, else those without a done review of the
    same digest."""
    if force:
        return current
    return current.join(stored.where("review_status = 'done'").select(*key, "digest"), [*key, "digest"], "left_anti")
