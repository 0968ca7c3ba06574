"""Rows from what a model has extracted: untrusted JSON becomes typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TERM_FIELDS = ("source", "target", "reading", "type", "gender", "note")


def scalar_text(v: Column) -> Column:
    """A variant's text: strings stripped, numbers as written, anything else (and booleans) empty."""
    kind = F.schema_of_variant(v)
    readable = kind.isin("STRING", "BIGINT", "DOUBLE", "FLOAT") | kind.startswith("DECIMAL")
    return F.coalesce(F.when(readable, F.trim(F.try_variant_get(v, "$", "string"))), F.lit(""))


def records(replies: DataFrame, key: list[str], reply: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows (key..., position, fields as text) of the objects of the JSON arrays in ``reply``.

    What is no JSON array gives no rows; items that are no objects are dropped."""
    # The columns that an exploded variant brings, pos, key and value, may be names of the caller's too.
    own = [F.col(c).alias(f"_key{k}") for k, c in enumerate(key)]
    parsed = replies.select(*own, F.try_parse_json(F.col(reply)).alias("_v")).where(F.col("_v").isNotNull() & F.schema_of_variant("_v").startswith("ARRAY"))
    each = parsed.lateralJoin(replies.sparkSession.tvf.variant_explode(F.col("_v").outer()))
    items = each.select(*(F.col(f"_key{k}").alias(c) for k, c in enumerate(key)), F.col("pos").alias("position"), F.col("value").alias("_item"))
    objects = items.where(F.schema_of_variant("_item").startswith("OBJECT"))
    return objects.select(*key, "position", *(scalar_text(F.coalesce(F.try_variant_get("_item", f"$.{f}", "variant"), F.parse_json(F.lit("null")))).alias(f) for f in fields))


def extracted_terms(replies: DataFrame, key: list[str], reply: str = "reply") -> DataFrame:
    """Terms of the JSON arrays in ``reply``: key..., position, and the fields as text.

    Items without source or target are dropped; the gender "unknown" is no gender."""
    fields = records(replies, key, reply, TERM_FIELDS)
    return fields.where("source <> '' and target <> ''").withColumn("gender", F.when(F.lower("gender") == "unknown", "").otherwise(F.col("gender")))
