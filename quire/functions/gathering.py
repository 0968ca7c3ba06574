"""Arrays that grow within a fold. Appending copies an array, so values are gathered in short runs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a run; a fold copies one run per value and the list of runs once per run.
RUN = 256


def nothing_gathered(kind: str) -> tuple[Column, Column]:
    """The fields runs and run that a fold starts with."""
    return F.array().cast(f"array<array<{kind}>>").alias("runs"), F.array().cast(f"array<{kind}>").alias("run")


def gathered(state: Column, value: Column, when: Column) -> tuple[Column, Column]:
    """Fields runs and run of a fold's state with ``value`` appended where ``when`` holds."""
    full = when & (F.size(state["run"]) >= RUN)
    runs = F.when(full, F.array_append(state["runs"], state["run"])).otherwise(state["runs"])
    run = F.when(full, F.array(value)).when(when, F.array_append(state["run"], value)).otherwise(state["run"])
    return runs.alias("runs"), run.alias("run")


def all_gathered(state: Column) -> Column:
    """What ``gathered`` has appended, in order."""
    return F.concat(F.flatten(state["runs"]), state["run"])
