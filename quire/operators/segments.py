"""From texts to chapters, paragraphs and segments, and back to logical paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.gathering import all_gathered, gathered, nothing_gathered
from quire.functions.text import heading, is_blank, sentences, strip


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (key, i, line) of the non-blank lines of a text, numbered densely from 0."""
    each = df.select(key, F.explode(F.transform(F.filter(F.split(text, r"\R", -1), lambda x: ~is_blank(x)), lambda x, i: F.struct(i.alias("i"), x.alias("line")))).alias("x"))
    return each.select(key, "x.i", "x.line")


def paragraphs(block: Column) -> Column:
    """The paragraphs of a block: cut at blank lines, blank parts dropped, outer newlines removed."""
    parts = F.filter(F.split(block, r"\n(?U)\s*\n", -1), lambda p: ~is_blank(p))
    return F.transform(parts, lambda p: F.regexp_replace(p, r"^\n+|\n+$", ""))


def chapters(df: DataFrame, key: str, text: str, stem: Column) -> DataFrame:
    """Cut a text at its heading lines.

    Rows (key, chapter, title, level, body). What stands before the first heading is a chapter
    without a heading of its own (level null), titled by ``stem``, and only kept if it is not blank."""
    each = df.select(key, stem.alias("_stem"), F.posexplode(F.split(text, r"\R", -1)).alias("_k", "_line")).withColumn("_h", heading(F.col("_line")))
    running = Window.partitionBy(key).orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = each.withColumn("_c", F.count("_h").over(running))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_h").isNull(), F.struct("_k", "_line")))), lambda x: x["_line"]), "\n")
    grouped = cut.groupBy(key, "_c").agg(F.first("_stem").alias("_stem"), F.max("_h").alias("_h"), body.alias("body"))
    kept = grouped.where((F.col("_c") > 0) | ~is_blank(F.col("body")))
    dense = F.row_number().over(Window.partitionBy(key).orderBy("_c")) - 1
    return kept.select(key, dense.alias("chapter"), F.coalesce("_h.title", "_stem").alias("title"), F.col("_h.level").alias("level"), "body")


def text_segments(chapters_: DataFrame, key: str) -> DataFrame:
    """Segments of chapters: the heading, if the chapter has one, and then its paragraphs."""
    body = F.transform(paragraphs(F.col("body")), lambda p: F.struct(p.alias("source"), F.lit("text").alias("kind")))
    head = F.when(F.col("level").isNotNull(), F.array(F.struct(F.col("title").alias("source"), F.lit("heading").alias("kind")))).otherwise(F.array().cast("array<struct<source:string,kind:string>>"))
    return chapters_.select(key, "chapter", "title", "level", F.posexplode(F.concat(head, body)).alias("seg", "s")).select(key, "chapter", "title", "level", "seg", "s.source", "s.kind")


def cut_sentence(sentence: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters of one sentence: cut before the last space, tab or newline
    that leaves a piece of that size, else hard. Pieces join to the sentence.

    The sentence is taken in stretches of ``most`` characters, so that no cut copies what is far ahead."""

    def last(window: Column, mark: str) -> Column:
        tail = F.substring_index(window, mark, -1)
        return F.when(F.length(tail) < F.length(window), F.length(window) - F.length(tail) - 1).otherwise(-1)

    def one(state: Column) -> Column:
        rest = state["rest"]
        window = F.substring(rest, 1, most + 1)
        spots = [last(window, mark) for mark in (" ", "\t", "\n")]
        cut = F.when(spots[0] > 0, spots[0]).when(spots[1] > 0, spots[1]).when(spots[2] > 0, spots[2]).otherwise(most)
        more = F.length(rest) > most
        return F.struct(*gathered(state, F.substr(rest, F.lit(1), cut), more), F.when(more, F.substr(rest, cut + 1)).otherwise(rest).alias("rest"))

    def step(state: Column, stretch: Column) -> Column:
        grown = F.array(F.struct(state["runs"].alias("runs"), state["run"].alias("run"), F.concat(state["rest"], stretch).alias("rest")))
        # Two cuts in a row take more than ``most`` characters together, so that two are enough for a stretch.
        return F.transform(F.transform(grown, one), one)[0]

    stretches = F.regexp_extract_all(sentence, F.lit(f"(?s).{{1,{most}}}"), F.lit(0))
    start = F.struct(*nothing_gathered("string"), F.lit("").alias("rest"))
    return F.aggregate(stretches, start, step, lambda s: F.filter(F.concat(all_gathered(s), F.array(s["rest"])), lambda x: F.length(x) > 0))


def split_text(text: Column, most: int) -> Column:
    """Pieces of at most ``most`` characters: whole sentences packed greedily, longer ones cut alone."""

    def packed(parts: Column) -> Column:
        """A fold over sentences (s, alone): pieces that stand alone close the piece under way."""

        def step(state: Column, x: Column) -> Column:
            flush = x["alone"] | state["alone"] | (F.length(state["cur"]) + F.length(x["s"]) > most)
            kept = flush & (F.length(state["cur"]) > 0)
            return F.struct(*gathered(state, state["cur"], kept), F.when(flush, x["s"]).otherwise(F.concat(state["cur"], x["s"])).alias("cur"), x["alone"].alias("alone"))

        start = F.struct(*nothing_gathered("string"), F.lit("").alias("cur"), F.lit(False).alias("alone"))
        return F.aggregate(parts, start, step, lambda s: F.filter(F.concat(all_gathered(s), F.array(s["cur"])), lambda x: F.length(x) > 0))

    each = F.transform(sentences(text), lambda s: F.when(F.length(s) > most, F.transform(cut_sentence(s, most), lambda p: F.struct(p.alias("s"), F.lit(True).alias("alone")))).otherwise(F.array(F.struct(s.alias("s"), F.lit(False).alias("alone")))))
    return F.when((F.length(text) > most) & (F.lit(most) > 0), packed(F.flatten(each))).otherwise(F.array(text))


def split_long_segments(segments: DataFrame, key: list[str], most: int) -> DataFrame:
    """Split segments (key..., seg, source, kind, anchor) longer than ``most`` and renumber them.

    The first piece keeps kind and anchor; the others continue it (cont), are text and have none."""
    each = segments.select(*key, F.col("seg").alias("_seg"), "kind", "anchor", F.posexplode(split_text(F.col("source"), most)).alias("_k", "source"))
    first = F.col("_k") == 0
    dense = F.row_number().over(Window.partitionBy(*key).orderBy("_seg", "_k")) - 1
    return each.select(*key, dense.alias("seg"), "source", F.when(first, F.col("kind")).otherwise("text").alias("kind"), F.when(first, F.col("anchor")).alias("anchor"), (~first).alias("cont"))


def merged_paragraphs(segments: DataFrame, key: list[str], text: str = "source") -> DataFrame:
    """Join continuations to what they continue: rows (key..., paragraph, kind, text, n_parts).

    The kind is that of the head; a leading continuation opens a paragraph of its own."""
    running = Window.partitionBy(*key).orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    first = Window.partitionBy(*key).orderBy("seg")
    head = (~F.coalesce("cont", F.lit(False))) | (F.row_number().over(first) == 1)
    marked = segments.withColumn("_head", head).withColumn("_p", F.sum(F.col("_head").cast("int")).over(running) - 1)
    parts = F.array_sort(F.collect_list(F.struct("seg", "kind", F.coalesce(text, F.lit("")).alias("t"))))
    return marked.groupBy(*key, F.col("_p").alias("paragraph")).agg(parts.alias("_x")).select(
        *key, "paragraph", F.col("_x")[0]["kind"].alias("kind"), F.array_join(F.transform("_x", lambda x: x["t"]), "").alias("text"), F.size("_x").alias("n_parts")
    )


def anchored_texts(segments: DataFrame, key: list[str]) -> DataFrame:
    """Merge the translated parts of each anchored heading: rows (key..., anchor, source, target).

    target is null if any part lacks one."""
    owner = F.last("anchor", ignorenulls=True).over(Window.partitionBy(*key).orderBy("seg").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = segments.withColumn("_a", F.when(F.col("anchor").isNotNull() | F.col("cont"), owner)).where("_a is not null")
    parts = F.array_sort(F.collect_list(F.struct("seg", "source", F.coalesce("target", F.lit("")).alias("t"))))
    grouped = kept.groupBy(*key, F.col("_a").alias("anchor")).agg(parts.alias("_x"), F.bool_and(~is_blank(F.col("target"))).alias("_ok"))
    join = lambda f: F.array_join(F.transform("_x", lambda x: x[f]), "")
    return grouped.select(*key, "anchor", join("source").alias("source"), F.when(F.col("_ok"), join("t")).alias("target"))
