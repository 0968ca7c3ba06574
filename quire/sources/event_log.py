"""The append-only event log: JSON lines, written in sorted key order, read with tolerance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def append(events: DataFrame, path: str) -> None:
    """Append events as JSON lines, keys in alphabetical order."""
    events.select(F.to_json(F.struct(*(F.col(c) for c in sorted(events.columns)))).alias("value")).write.mode("append").text(path)


def parsed(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines with ``data``, their JSON as a variant; lines that are no JSON objects are dropped."""
    return lines.withColumn("data", F.try_parse_json(F.col(value))).where(F.col("data").isNotNull() & F.schema_of_variant("data").startswith("OBJECT"))


def read(spark: SparkSession, path: str) -> DataFrame:
    return parsed(spark.read.text(path))


def text_field(data: Column, name: str) -> Column:
    return F.try_variant_get(data, f"$.{name}", "string")


def completed_keys(events: DataFrame, event: str) -> DataFrame:
    """Distinct (chapter, key) of the events of one kind; wrong types are passed over."""
    chapter = F.try_variant_get("data", "$.chapter", "int")
    kept = events.where(text_field(F.col("data"), "event") == event)
    return kept.select(chapter.alias("chapter"), text_field(F.col("data"), "key").alias("key")).where("chapter is not null and key is not null").distinct()
