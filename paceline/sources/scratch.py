"""The shared folder for checkpoints and intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a session in local mode, one process, gets a temporary folder of its own if the
    setting is missing.  On a cluster the folder must be one that all executors share; also
    a ``file:`` path may be (a shared mount), so that is the caller's to know.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not _one_process(context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        named = tempfile.mkdtemp(prefix="paceline-")
        context.setCheckpointDir(named)
    elif not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def _one_process(master: str) -> bool:
    """Local mode, where driver and executor are one process (``local-cluster`` isn't)."""
    return master == "local" or master.startswith("local[")


@contextmanager
def scratch(spark: SparkSession, label: str = "scratch") -> Iterator[str]:
    """A folder for intermediate tables that is removed with all it has when the caller is done."""
    path = new_folder(spark, label)
    try:
        yield path
    finally:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path for an intermediate table inside the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def pin(df: DataFrame) -> DataFrame:
    """Write the rows once to the shared folder and read them back.

    All later readers see the same rows, survive the loss of executors, and read only
    the columns they need.
    """
    path = new_folder(df.sparkSession, "pinned")
    df.write.option("compression", "snappy").parquet(path)
    return df.sparkSession.read.parquet(path)
