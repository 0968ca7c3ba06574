"""Punctuation of Chinese text, in the order in which the rules must apply.

All of it is a chain of built-in functions. The apostrophe depends on whether a quotation is open, which a
pattern over the kinds of a text's quotes tells.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.gathering import all_gathered, gathered, nothing_gathered

# The characters that count as Chinese context.
CJK = "一-鿿぀-ヿ＀-￯“”‘’（）《》【】、，。！？：；…—"
_MARK = "\ue000"


def japanese_quotes(c: Column) -> Column:
    return F.translate(c, "「」『』", "“”‘’")


def double_quotes(c: Column, open_first: Column | None = None) -> Column:
    """ASCII double quotes, opening and closing in turn."""
    start = F.when(F.coalesce(open_first, F.lit(True)), 0).otherwise(1) if open_first is not None else F.lit(0)
    parts = F.transform(F.split(c, '"', -1), lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.when((i + start) % 2 == 1, "“").otherwise("”"), p)))
    return F.array_join(parts, "")


def double_open_after(c: Column, open_first: Column) -> Column:
    """Whether the next double quote opens, after the quotes of this text."""
    n = F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))
    return F.when(n % 2 == 0, open_first).otherwise(~open_first)


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it stands there."""
    return F.transform(F.array(value), then)[0]


def single_quotes(c: Column, open_first: Column | None = None) -> Column:
    """ASCII apostrophes and single quotes: struct(text, open).

    Between two ASCII letters it is an apostrophe and changes nothing. After a letter it closes an open
    quotation, else it is an apostrophe. Elsewhere it opens and closes in turn.

    Each quote has a kind that its neighbours tell: a (between letters), b (after one), c (elsewhere). Those
    of kind c go in pairs from the start, and anew from every b on, whatever stands between them; so the
    kinds, written as one string, are paired by a pattern, which takes one pass over any number of quotes.
    Where a quotation is open at the start, a c before the first quote stands for it."""

    def kind(parts: Column, i: Column) -> Column:
        before, after = F.get(parts, i).rlike(r"[A-Za-z]\z"), F.get(parts, i + 1).rlike("^[A-Za-z]")
        return F.when(before & after, "a").when(before, "b").otherwise("c")

    def paired(kinds: Column) -> Column:
        return F.regexp_replace(F.regexp_replace(kinds, "c(a*)c", "o$1e"), "c", "o")

    def told(parts: Column) -> Column:
        kinds = F.array_join(F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda _, i: kind(parts, i)), "")
        lead = F.lit("") if open_first is None else F.when(open_first, F.lit("")).otherwise(F.lit("c"))
        put = lambda shown: F.array_join(F.transform(parts, lambda p, i: F.when(i == 0, p).otherwise(F.concat(F.get(shown, i - 1), p))), "")

        def written(marks: Column) -> Column:
            shown = F.split(F.translate(F.substring(marks, F.length(lead) + 1, F.length(marks)), "oeab", "‘’’’"), "")
            # What was open last: an o, or what was open at the start.
            return F.struct(_once(shown, put).alias("text"), (F.regexp_extract(marks, "([^a])a*$", 1) != "o").alias("open"))

        return _once(paired(F.concat(lead, kinds)), written)

    return _once(F.split(c, "'", -1), told)


# Writings of ellipsis and dash, in order.
ELLIPSIS_DASH = ((r"。{3,}", "……"), (r"・{2,}", "……"), (r"\.{3,}", "……"), (r"…+", "……"), (r"-{2,}", "——"), (r"—+", "——"))


def ellipsis_dash(c: Column) -> Column:
    for pattern, mark in ELLIPSIS_DASH:
        c = F.regexp_replace(c, pattern, mark)
    return c


def full_width(c: Column) -> Column:
    """Half-width marks beside Chinese become full-width, judged on the original neighbours.

    A mark after an ASCII letter or digit stays. One pass puts a sentinel before the marks to change,
    so a changed mark never counts as Chinese context for its neighbour."""
    hit = F.regexp_replace(c, rf"(?<=[{CJK}])([,.!?:;])|(?<![A-Za-z0-9])([,.!?:;])(?=[{CJK}])", _MARK + "$1$2")
    for half, full in zip(",.!?:;", "，。！？：；", strict=True):
        hit = F.replace(hit, F.lit(_MARK + half), F.lit(full))
    return hit


# Marks behind which white space goes, always and before Chinese.
GAP_AFTER, GAP_BEFORE_CHINESE = "，。！？：；、", "”’》】"


def close_gaps(c: Column) -> Column:
    """No white space after full-width marks, nor after closing marks before Chinese."""
    c = F.regexp_replace(c, rf"([{GAP_AFTER}])(?U)\s+", "$1")
    return F.regexp_replace(c, rf"([{GAP_BEFORE_CHINESE}])(?U)\s+(?=[{CJK}])", "$1")


def normalize(c: Column) -> Column:
    """All rules on one text, starting outside any quotation."""
    quoted = single_quotes(double_quotes(japanese_quotes(c)))["text"]
    return close_gaps(full_width(ellipsis_dash(quoted)))


def normalize_segments(texts: Column, continues: Column) -> Column:
    """All rules on an array of texts in order; a text that continues the one before inherits its
    open quotations. Null texts become empty."""
    start = F.struct(*nothing_gathered("string"), F.lit(True).alias("double"), F.lit(True).alias("single"))

    def step(state: Column, item: Column) -> Column:
        raw = japanese_quotes(F.coalesce(item["text"], F.lit("")))
        goes_on = F.coalesce(item["cont"], F.lit(False)) & (F.size(state["run"]) > 0)
        d, s = F.when(goes_on, state["double"]).otherwise(True), F.when(goes_on, state["single"]).otherwise(True)
        return _once(
            single_quotes(double_quotes(raw, d), s),
            lambda single: F.struct(
                *gathered(state, close_gaps(full_width(ellipsis_dash(single["text"]))), F.lit(True)), double_open_after(raw, d).alias("double"), single["open"].alias("single")
            ),
        )

    items = F.zip_with(texts, continues, lambda t, k: F.struct(t.alias("text"), k.alias("cont")))
    return F.aggregate(items, start, step, all_gathered)
