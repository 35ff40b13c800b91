"""Cutting lineage where rows must stay the same between two uses, the folder that all executors share, and dealing rows to
all cores."""

from __future__ import annotations

import gc
import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder. A session that names none gets one of its own in local mode, as in tests; on a cluster
    that is an error, since executors do not share the driver's disk."""
    context = spark.sparkContext
    there = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not there:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        there = tempfile.mkdtemp(prefix="siltstone-")
        context.setCheckpointDir(there)
    return there


def fresh_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """The rows, written once to the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def swept(spark: SparkSession) -> None:
    """Let go of what earlier steps have left on disk. Spark deletes a shuffle's files, and a checkpoint's where it may, when the
    driver's JVM finds that nothing refers to them: between the large steps of a long job that is soon enough only if asked."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Tasks a core that long work on each row is dealt to.
TASKS_A_CORE = 8


def dealt(rows: DataFrame) -> DataFrame:
    """The rows, dealt evenly to several tasks a core, for work on each row that is long beside reading it.

    A scan's own partitions do not say where its rows are: a file has a split for every few megabytes, and all rows of a row
    group are in one of them."""
    return rows.repartition(max(TASKS_A_CORE * rows.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions()))
