"""Token usage: facts per call, roll-ups, and the algebra of summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("calls", "prompt", "completion", "total", "cache_hit", "cache_miss")


def whole(c: Column) -> Column:
    """A count read from anything: 0 where it is no integer."""
    return F.coalesce(c.cast("string").try_cast("long"), F.lit(0).cast("long"))


def usage_facts(calls: DataFrame) -> DataFrame:
    """Facts (tier, stage, six counts) from raw calls: a missing or zero total is prompt plus
    completion, negative cache counts are 0."""
    prompt, completion, total = (whole(F.col(c)) for c in ("prompt", "completion", "total"))
    return calls.select(
        "tier", "stage", F.lit(1).cast("long").alias("calls"), prompt.alias("prompt"), completion.alias("completion"),
        F.when(total > 0, total).otherwise(prompt + completion).alias("total"),
        F.greatest(F.lit(0), whole(F.col("cache_hit"))).alias("cache_hit"), F.greatest(F.lit(0), whole(F.col("cache_miss"))).alias("cache_miss"),
    )


def cached_counts(prompt: Column, details: Column) -> Column:
    """struct(cache_hit, cache_miss) from nested cached counts; without them both are 0."""
    hit = F.greatest(F.lit(0), whole(details))
    return F.when(details.isNull(), F.struct(F.lit(0).cast("long").alias("cache_hit"), F.lit(0).cast("long").alias("cache_miss"))).otherwise(
        F.struct(hit.cast("long").alias("cache_hit"), F.greatest(F.lit(0), prompt - hit).cast("long").alias("cache_miss"))
    )


def hit_rate(hit: Column, miss: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(hit.cast("double"), (hit + miss).cast("double")), 4), F.lit(0.0))


def rolled_up(facts: DataFrame) -> DataFrame:
    """Sums by tier, by stage and in all, in one pass: (scope, slot, six counts, cache_hit_rate).

    Calls without a stage count for their tier and in all."""
    sums = [F.coalesce(F.sum(f), F.lit(0)).cast("long").alias(f) for f in FIELDS]
    level = F.grouping_id()
    cube = facts.groupingSets([[F.col("tier")], [F.col("stage")], []], F.col("tier"), F.col("stage")).agg(level.alias("_g"), *sums)
    scope = F.when(F.col("_g") == 1, "tier").when(F.col("_g") == 2, "stage").otherwise("totals")
    slot = F.when(F.col("_g") == 1, F.col("tier")).when(F.col("_g") == 2, F.col("stage")).otherwise("")
    named = cube.select(scope.alias("scope"), slot.alias("slot"), *FIELDS).where("scope <> 'stage' or slot is not null")
    return named.withColumn("cache_hit_rate", hit_rate(F.col("cache_hit"), F.col("cache_miss")))


def delta(current: DataFrame, previous: DataFrame, key: list[str]) -> DataFrame:
    """What came since: per slot and field the increase, not below 0; slots without any are dropped."""
    p = previous.select(*key, *(F.col(f).alias(f"_{f}") for f in FIELDS))
    grown = current.join(p, key, "left").select(*key, *(F.greatest(F.lit(0), F.col(f) - F.coalesce(f"_{f}", F.lit(0))).cast("long").alias(f) for f in FIELDS))
    some = None
    for f in FIELDS:
        some = F.col(f) > 0 if some is None else some | (F.col(f) > 0)
    return grown.where(some)


def merge(accumulated: DataFrame, increment: DataFrame, key: list[str]) -> DataFrame:
    """The sum of two summaries slot by slot, with the rate anew."""
    both = accumulated.select(*key, *FIELDS).unionByName(increment.select(*key, *FIELDS))
    return both.groupBy(*key).agg(*(F.sum(f).cast("long").alias(f) for f in FIELDS)).withColumn("cache_hit_rate", hit_rate(F.col("cache_hit"), F.col("cache_miss")))


def tier_for(available: list[str], wanted: Column) -> Column:
    """The tier that serves a request: the wanted one, else a cheaper-to-dearer fallback."""
    chain = {"fast": ("fast", "cheap", "strong"), "cheap": ("cheap", "strong"), "strong": ("strong",)}
    out = None
    for name, options in chain.items():
        got = next((o for o in options if o in available), None)
        out = F.when(wanted == name, F.lit(got)) if out is None else out.when(wanted == name, F.lit(got))
    return F.coalesce(out, F.lit("strong" if "strong" in available else None))
