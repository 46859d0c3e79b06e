"""Shared scratch tables: where lineage is cut and lost executors can reread.

The folder is the one the session names in ``spark.checkpoint.dir``.  Only a
``local[*]`` session without that setting (tests) gets a temporary folder.
"""

from __future__ import annotations

import atexit
import logging
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: dict[str, SparkSession] = {}
_SCOPES: ContextVar[tuple[list[str], ...]] = ContextVar("scratch tables of the open scopes", default=())


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for scratch tables; raises where a cluster names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL_DIR:
        _LOCAL_DIR.append("file://" + tempfile.mkdtemp(prefix="auditlake-scratch-"))
    return _LOCAL_DIR[0]


def materialize(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the reread table.

    Unlike ``localCheckpoint`` the files survive lost executors, and unlike
    ``cache`` they hold no executor memory.  The shuffle files of the write go
    when it ends, as nothing reads them again.  ``kept``: beyond the scope it is written in.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/auditlake-{name}-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.option("compression", "zstd").parquet(path)
    register(path, spark, kept)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Writes within drop their shuffle files when they end."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read any more."""
    for table in tables:
        release(getattr(table, "_scratch_path", ""))


def register(path: str, spark: SparkSession, kept: bool = False) -> None:
    """Take a folder as a scratch table: it goes with its scope (``kept``: the one around), or with the process."""
    _WRITTEN[path] = spark
    scopes = _SCOPES.get()
    if len(scopes) > kept:
        scopes[-1 - kept].append(path)


@contextmanager
def scratch_scope() -> Iterator[None]:
    """Scratch tables that this thread writes within go at the end; results built on them must be written by then."""
    mark = _SCOPES.set((*_SCOPES.get(), []))
    try:
        yield
    finally:
        paths = _SCOPES.get()[-1]
        _SCOPES.reset(mark)
        for path in paths:
            release(path)


def release_scratch() -> None:
    """Delete all scratch tables of this process; results built on them end here."""
    for path in list(_WRITTEN):
        release(path)


def release(path: str) -> None:
    """Delete a folder of this process's scratch."""
    spark = _WRITTEN.pop(path, None)
    if spark is not None:
        delete_folder(spark, path)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder in whatever store it is."""
    try:
        hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.delete(hadoop_path, True)
    except Exception as e:  # at exit the session may have ended; the folder's owner cleans up then
        logging.getLogger(__name__).info("scratch table %s stays: %s", path, e)


atexit.register(release_scratch)
