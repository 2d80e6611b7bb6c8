"""Cutting lineage in the folder that all executors share; dealing rows out for costly columns."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset on one machine (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="timeweave-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def cut(df: DataFrame) -> DataFrame:
    """The same rows, read from the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame, *key: str) -> DataFrame:
    """The same rows dealt out by a key to spark.sql.shuffle.partitions tasks, which stay as many however few bytes they read."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)
