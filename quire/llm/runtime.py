"""Shared plumbing of the training-data operators: written intermediate tables and components."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Whether Spark deletes the shuffle files of a query once it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only a session that runs in one process makes do with a
    temporary folder where the setting is absent; on a cluster that would scatter the parts of a table."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not known:
        known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="quire-")
        spark.sparkContext.setCheckpointDir(known)
    return known.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a DataFrame as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a re-read of this table, not a recomputation. The tables
    of an application lie in one folder, which ``drop_all_written`` deletes. The shuffle files of the write
    go with its end, as nothing will read them again; otherwise a chain of steps would keep those of all.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by ``written`` once no later plan reads it."""
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        if "/quire-" in folder:
            _delete(df.sparkSession, folder)


def drop_all_written(spark: SparkSession) -> None:
    """Delete every table that this application has written; for when all results have been saved."""
    _delete(spark, f"{shared_folder(spark)}/quire-{spark.sparkContext.applicationId}")


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """Connected components of an undirected graph given as rows (src long, dst long).

    Returns (node, root) for every node that occurs in an edge; root is the smallest node of its
    component. Each round every node takes the smallest label among itself and its neighbours and
    then jumps to that label's own label, so the rounds grow with the logarithm of the longest path.
    The state lives in written tables; only one changed-row count per round reaches the driver.
    Nulls and self loops are ignored; an empty input gives an empty result.
    """
    clean = edges.where("src is not null and dst is not null and src <> dst").select(
        F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")
    )
    both = written(clean.union(clean.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), f"{label}-edges")
    state = written(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("root")), f"{label}-0")
    for k in itertools.count(1):
        heard = both.join(state.withColumnsRenamed({"node": "dst", "root": "near"}), "dst").groupBy("src").agg(F.min("near").alias("near"))
        nearer = state.join(heard.withColumnRenamed("src", "node"), "node", "left").select(
            "node", F.col("root").alias("old"), F.least("root", F.coalesce("near", "root")).alias("root")
        )
        jump = state.select(F.col("node").alias("root"), F.col("root").alias("far"))
        following = nearer.join(jump, "root", "left").select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root"))
        new = written(following, f"{label}-{k}")
        changed = new.where("old <> root").limit(1).count()
        drop_written(state)
        state = new.select("node", "root")
        if not changed:
            break
    drop_written(both)
    return state


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys in a sorted stream, in tables that hold whole groups only."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        same = np.ones(max(0, batch.num_rows - 1), bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            same &= v[1:] == v[:-1]
        cut = np.flatnonzero(~same)
        last = int(cut[-1]) + 1 if len(cut) else 0
        if held and any(held[-1].column(k)[held[-1].num_rows - 1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def small_batches(batches: Iterator[pa.RecordBatch], column: int | str, most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of one text column (or one row), so that what a
    task turns into Python objects stays small however long the texts are."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.cumsum(sizes + 64) // most
        cuts = np.flatnonzero(np.diff(part)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            yield batch.slice(i, j - i)
