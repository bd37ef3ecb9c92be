"""Intermediate tables that cut lineage, kept in the folder all executors share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession

_FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local folder only where it is unset and all tasks run in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: intermediate tables need a folder that all executors share")
        found = tempfile.mkdtemp(prefix="loomwork-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scratch:
    """Parquet tables under the shared folder: written once, read by later stages.

    A lost executor only costs the tasks that ran on it: finished tables are in
    the shared folder. Shuffle files of a finished write are dropped at once, as
    the table replaces them; the session's setting for that holds while a table is
    written, and at worst makes another query of the session shuffle anew when its
    result is asked for again. Tables that a result still reads stay until ``purge``.
    """

    #: Folders of this process.
    roots: ClassVar[list[str]] = []

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/loomwork/{label}-{uuid.uuid4().hex[:12]}"
        Scratch.roots.append(self.root)

    def save(self, df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
        before = self.spark.conf.get(_FILE_CLEANUP, None)
        self.spark.conf.set(_FILE_CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", compression).parquet(f"{self.root}/{name}")
        finally:
            if before is None:
                self.spark.conf.unset(_FILE_CLEANUP)
            else:
                self.spark.conf.set(_FILE_CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, *names: str) -> None:
        """Remove tables that nothing still to run reads."""
        for name in names:
            _delete(self.spark, f"{self.root}/{name}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    with contextlib.suppress(Exception):
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def purge(spark: SparkSession) -> None:
    """Remove every table that operators left in this process; call it when their results have been written."""
    while Scratch.roots:
        _delete(spark, Scratch.roots.pop())
