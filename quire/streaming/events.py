"""Streams over the event log: windowed counts with a watermark, and glossary state by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counts(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events (ts, event_type, value) per tumbling window and type; later events than the watermark go."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("window.start").alias("start"), "event_type", "n", "total"
    )


def glossary(proposals: DataFrame) -> DataFrame:
    """A stream of proposals (source, target, seq) to a stream of outcomes (source, target, proposed,
    outcome): the first target of a source stays; others are conflicts, equal ones unchanged."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("seq")
        kept = state.get[0] if state.exists else None
        out = []
        for target in rows["target"]:
            outcome = "inserted" if kept is None else "unchanged" if target == kept else "conflict"
            kept = kept if kept is not None else target
            out.append((key[0], kept, target, outcome))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["source", "target", "proposed", "outcome"])

    return proposals.groupBy("source").applyInPandasWithState(
        step, "source string, target string, proposed string, outcome string", "target string", "append", GroupStateTimeout.NoTimeout
    )
