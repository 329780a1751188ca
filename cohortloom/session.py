"""Session helpers: shared scratch space and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of at most this many rows and about this many bytes are broadcast on demand; beyond it, Spark decides from what
#: it measures.
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 64 << 20

_local_dirs: list[tempfile.TemporaryDirectory] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``, or that the program has set.

    A machine-local folder is made only where the setting is absent and the session is a local one (tests).
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if not _local_dirs:
        _local_dirs.append(tempfile.TemporaryDirectory(prefix="cohortloom-"))
    return _local_dirs[0].name


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has used; the application has a folder of its own there."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/cohortloom/{spark.sparkContext.applicationId}"


def remove_scratch(spark: SparkSession) -> bool:
    """Delete what this application has written under ``scratch_path``, once its results are no longer read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_rows(df: DataFrame, rows: int, cell_bytes: int = 20) -> DataFrame:
    """Broadcast a table that is known to hold at most ``rows`` rows, if that and their width are small enough."""
    small = rows <= BROADCAST_ROWS and rows * len(df.columns) * cell_bytes <= BROADCAST_BYTES
    return F.broadcast(df) if small else df


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a table that several jobs read; the copy outlives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()
