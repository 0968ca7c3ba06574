"""Greedy packing of ordered items into batches: folds whose running size is reset by the data.

No window frame can express such a reset, so a fold walks the ordered sizes of one group and records
where batches start. Only the starts are collected, and a batch is then a slice of the items. Appending
copies an array, so the starts are gathered in short runs that are joined at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.gathering import all_gathered, gathered, nothing_gathered


def batch_starts(sizes: Column, budget: int, separator: int = 0, most_items: int | None = None) -> Column:
    """Where batches start: a batch ends before the item that would take it over ``budget``.

    An item over the budget is a batch of its own. ``separator`` is added to the running size with each
    item but not to the size under test. ``most_items`` closes a batch that has so many items."""
    start = F.struct(*nothing_gathered("int"), F.lit(0).cast("long").alias("size"), F.lit(0).alias("count"), F.lit(0).alias("i"))

    def step(state: Column, size: Column) -> Column:
        full = state["size"] + size > budget
        if most_items is not None:
            full = full | (state["count"] >= most_items)
        new = (state["count"] == 0) | full
        return F.struct(
            *gathered(state, state["i"], new),
            (F.when(new, 0).otherwise(state["size"]) + size + separator).cast("long").alias("size"),
            (F.when(new, 0).otherwise(state["count"]) + 1).alias("count"),
            (state["i"] + 1).alias("i"),
        )

    return F.aggregate(sizes, start, step, all_gathered)


def ordered_items(df: DataFrame, group: list[str], order: list[str], item: Column) -> DataFrame:
    """One row per group with ``items``, its items in order."""
    packed = F.struct(*(F.col(c).alias(f"_{k}") for k, c in enumerate(order)), item.alias("item"))
    return df.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(packed)), lambda x: x["item"]).alias("items"))


def explode_batches(df: DataFrame, group: list[str], starts: Column) -> DataFrame:
    """Rows (group, batch, start, items) from rows with ``items`` and where their batches start."""
    bounds = df.withColumn("_starts", starts)
    each = bounds.select(*group, "items", "_starts", F.posexplode("_starts").alias("batch", "start"))
    end = F.coalesce(F.get("_starts", F.col("batch") + 1), F.size("items"))
    return each.select(*group, "batch", "start", F.slice("items", F.col("start") + 1, end - F.col("start")).alias("items"))


def pack(df: DataFrame, group: list[str], order: list[str], item: Column, size, budget: int, **limits) -> DataFrame:
    """Pack the items of each group in order; ``size`` maps an item to its size.

    Returns group columns, batch and start (from 0), items."""
    one = ordered_items(df, group, order, item)
    return explode_batches(one, group, batch_starts(F.transform("items", size), budget, **limits))


def islands(flags: Column) -> Column:
    """Starts of the runs of equal values in an array."""
    return F.filter(F.sequence(F.lit(0), F.size(flags) - 1), lambda i: (i == 0) | ~F.get(flags, i).eqNullSafe(F.get(flags, i - 1)))


def resume_batches(packed: DataFrame, group: list[str], done) -> DataFrame:
    """Split every batch wherever its items flip between done and not done; ``done`` maps an item.

    Returns group columns, batch (the batch it was part of), start (in the group), done, items."""
    flags = packed.withColumn("_f", F.transform("items", lambda x: done(x)))
    each = flags.select(*group, "batch", F.col("start").alias("_base"), "items", "_f", islands(F.col("_f")).alias("_s"))
    run = each.select(*group, "batch", "_base", "items", "_f", "_s", F.posexplode("_s").alias("_k", "_at"))
    end = F.coalesce(F.get("_s", F.col("_k") + 1), F.size("items"))
    return run.select(*group, "batch", (F.col("_base") + F.col("_at")).alias("start"), F.get("_f", F.col("_at")).alias("done"), F.slice("items", F.col("_at") + 1, end - F.col("_at")).alias("items"))
