"""Status as a state machine: which state a thing is in after its events, and which events it refused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The states of a chapter, and what leads from one to another.
STATES = ("pending", "running", "done", "failed")
TRANSITIONS = {
    "start": {"pending": "running", "failed": "running", "done": "running"},
    "finish": {"running": "done"},
    "fail": {"running": "failed"},
    "fall_back": {"running": "pending"},
}
#: Events that are composed into one map of states before the maps of a thing are composed.
RUN = 1000


def _table(states: tuple[str, ...], transitions: dict[str, dict[str, str]]) -> Column:
    """action -> place of the next state by place of the state, null where it is refused."""
    rows = [x for action, moves in transitions.items() for x in (F.lit(action), F.array(*(F.lit(states.index(moves[s]) if s in moves else None).cast("int") for s in states)))]
    return F.create_map(*rows)


def _composed(maps: Column, n: int) -> Column:
    """struct(next, refused) by first state, of an ordered array of such structs, one after another."""
    start = F.struct(F.array(*(F.lit(i) for i in range(n))).alias("next"), F.array(*(F.lit(0).cast("long") for _ in range(n))).alias("refused"))
    step = lambda a, m: F.struct(
        F.transform(a["next"], lambda s: F.get(m["next"], s)).alias("next"),
        F.transform(a["next"], lambda s, i: F.get(a["refused"], i) + F.get(m["refused"], s)).alias("refused"),
    )
    return F.aggregate(maps, start, step)


def after_events(
    events: DataFrame, key: list[str], order: str, action: str = "action", transitions: dict[str, dict[str, str]] = TRANSITIONS, states: tuple[str, ...] = STATES, first: str = "pending"
) -> DataFrame:
    """(key..., status, n_events, n_refused): the state of each key after its events in order, from ``first``.

    An event that the state does not allow, or of no known action, is refused and changes nothing. Every event
    is a map of states and maps compose, so the events of a key are composed in runs of RUN by their rank
    before the runs are: no task holds more than a run, or one map for each run, of a key."""
    n = len(states)
    same = F.array(*(F.lit(None).cast("int") for _ in states))
    moves = F.coalesce(F.try_element_at(_table(states, transitions), F.col(action)), same)
    one = F.struct(
        F.transform(moves, lambda to, s: F.coalesce(to, s)).alias("next"),
        F.transform(moves, lambda to: to.isNull().cast("long")).alias("refused"),
    )
    # Ranks by ranges of the order, so that a key with many events is not ranked in one task.
    spread = events.select(*key, F.col(order).alias("_order"), one.alias("_map"))
    bounds = spread.groupBy(*key).agg(F.min("_order").alias("_low"), F.max("_order").alias("_high"), F.count("*").alias("_n"))
    share = (F.col("_order").cast("double") - F.col("_low").cast("double")) / F.nullif(F.col("_high").cast("double") - F.col("_low").cast("double"), F.lit(0.0))
    runs = F.ceil(F.col("_n") / RUN)
    placed = spread.join(bounds, key).withColumn("_run", F.floor(F.coalesce(share, F.lit(0.0)) * runs))
    parts = placed.groupBy(*key, "_run").agg(F.array_sort(F.collect_list(F.struct("_order", "_map"))).alias("_x"))
    composed = parts.select(*key, "_run", F.size("_x").alias("_n"), _composed(F.transform("_x", lambda x: x["_map"]), n).alias("_map"))
    whole = composed.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_run", "_map"))).alias("_x"), F.sum("_n").alias("n_events"))
    end = whole.select(*key, "n_events", _composed(F.transform("_x", lambda x: x["_map"]), n).alias("_end"))
    at = states.index(first)
    named = F.get(F.array(*(F.lit(s) for s in states)), F.get(F.col("_end.next"), at))
    return end.select(*key, named.alias("status"), F.col("n_events").cast("long").alias("n_events"), F.get(F.col("_end.refused"), at).alias("n_refused"))
