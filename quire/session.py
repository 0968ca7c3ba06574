"""Session helpers shared by tests, bench and the entry module."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "quire", cores: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below a data directory."""
    return spark.read.parquet(f"{sf_dir.rstrip(os.sep)}/{name}.parquet")


def lineage_cut(df: DataFrame) -> DataFrame:
    """The same rows from a checkpoint in the folder of spark.checkpoint.dir. Only a session that runs in one
    process makes do with a temporary folder where the setting is absent."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        known = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not known and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(known or "file://" + tempfile.mkdtemp(prefix="quire-"))
    return df.checkpoint()
