"""Cutting lineage in the folder that the session's executors share."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that are sent to every task at most.
SMALL = 1 << 16

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def durable(df: DataFrame) -> DataFrame:
    """A checkpoint of df in spark.checkpoint.dir; a local session without that setting gets a folder of its own."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def released(df: DataFrame) -> DataFrame:
    """As durable, without keeping the shuffle files behind df. Checkpoints that nothing refers to go before it is made
    (if spark.cleaner.referenceTracking.cleanCheckpoints is set)."""
    spark = df.sparkSession
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        return durable(df.select("*"))  # a plan of its own takes the setting
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def small(df: DataFrame) -> DataFrame:
    """df, to be broadcast if it has SMALL rows at most: they are counted. A larger one is joined as Spark sees fit."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df
