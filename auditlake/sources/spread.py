"""Small inputs over all cores, and plans cut between jobs."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


#: Tasks that a table is dealt to at most; beyond, its files have partitions enough.
TASKS = 4096


def spread(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """``df`` dealt over all cores where its files give fewer partitions, as a file of one row group does.

    Tables of a cluster's size have more partitions than cores and stay as they are, unless ``task_bytes`` is given:
    narrow rows that long expressions follow go to a task for so many bytes of files, so that no task grows with the table.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if task_bytes is not None:
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))  # from the listing of files
        tasks = max(tasks, min(-(-size // task_bytes), TASKS))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs, ``spark.checkpoint.dir``; a ``local`` session without it gets a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None and not (context.master == "local" or context.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="auditlake-checkpoint-"))
    return named or context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` as it is now, written to the shared folder, so that later jobs don't repeat or depend on what made it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
