"""Translation memory, checkpoints and status: keyed state with the last writer winning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.text import content_key


def remember(writes: DataFrame) -> DataFrame:
    """Memory after writes (source_text, target_text, chapter, seq): target and chapter of the last
    write of each key, the source text of the first."""
    return writes.withColumn("source_hash", content_key(F.col("source_text"))).groupBy("source_hash").agg(
        F.min_by("source_text", "seq").alias("source_text"), F.max_by("target_text", "seq").alias("target_text"), F.max_by("chapter", "seq").alias("chapter"), F.max("seq").alias("seq")
    )


def recall(memory: DataFrame, probes: DataFrame, text: str) -> DataFrame:
    """Probes with ``target_text`` of the memory, null where the stripped text is not known."""
    known = memory.select("source_hash", "target_text")
    return probes.withColumn("source_hash", content_key(F.col(text))).join(known, "source_hash", "left")


def latest(events: DataFrame, key: list[str], value: str, seq: str = "seq") -> DataFrame:
    """The last value of each key."""
    return events.groupBy(*key).agg(F.max_by(value, seq).alias(value))


def pending(chapters: DataFrame) -> DataFrame:
    return chapters.where(F.coalesce("status", F.lit("")) != "done")


def not_done(items: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Items without a checkpoint: work is done once however often it is resumed."""
    return items.join(done.select(*key).distinct(), key, "left_anti")
