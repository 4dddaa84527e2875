"""Cutting lineage in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made in each open ``scope``, the innermost last.
_SCOPES: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where it is unset and the master is local."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    sc = spark.sparkContext
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="gristmill-"))
    return sc.getCheckpointDir()


def stable(df: DataFrame) -> DataFrame:
    """The same rows with lineage cut: a reliable checkpoint in the shared folder.

    Rows and partitions do not change when an executor is lost later, and nothing upstream runs twice.
    Spark's context cleaner removes the files once the frame is unreachable, if it is configured to.
    """
    spark = df.sparkSession
    folder, sc = shared_dir(spark), spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """The same rows from a Parquet table written to the shared folder; for wide rows, as files are compressed."""
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder; an open ``scope`` removes what is there at its end."""
    path = f"{shared_dir(spark).rstrip('/')}/gristmill-{uuid.uuid4().hex}"
    if _SCOPES:
        _SCOPES[-1].append(path)
    return path


def removed(spark: SparkSession, path: str) -> bool:
    """Deletes a folder or file of any file system that Spark knows; whether it was there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True))


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What ``stored`` and ``scratch`` make inside is removed at the end, so results must be written before.

    Scopes may lie in each other, each with its own tables; the shared folder is then the same size after any number of runs.
    """
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            removed(spark, path)
