"""Intermediate tables that several later steps read.

Where the cluster names a shared folder (``spark.checkpoint.dir``), a staged table is
written there once and read back as a columnar relation: later steps prune its columns and
push filters, plans stay small, and a lost executor costs a re-read instead of the whole
lineage. Without such a folder the engine keeps it (memory first, then its own disk) and
recomputes what it loses.

A :class:`Run` owns the tables that were staged for it and counts who still reads them; the
last one to release it drops its tables and no others. What is left goes when the
application ends.
"""

from __future__ import annotations

import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

TABLE, PERSIST, NONE = "table", "persist", "none"


class Run:
    """The staged tables of one run: written, persisted (also where no folder is named), or not kept at all."""

    def __init__(self, mode: str = TABLE) -> None:
        if mode not in (TABLE, PERSIST, NONE):
            raise ValueError(f"mode must be one of {(TABLE, PERSIST, NONE)}")
        self.mode, self.users = mode, 1
        self._kept: list[DataFrame] = []
        self._written: list[tuple[SparkSession, str]] = []

    @staticmethod
    def of(mode: str | Run) -> Run:
        return mode if isinstance(mode, Run) else Run(mode)

    def hold(self) -> Run:
        """One more reader, who releases the run as well."""
        self.users += 1
        return self

    def release(self) -> None:
        """One reader less; after the last one nothing that was staged can be read."""
        self.users -= 1
        if self.users > 0:
            return
        while self._kept:
            self._kept.pop().unpersist()
        while self._written:
            spark, path = self._written.pop()
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        if self.mode == NONE:
            return df
        spark = df.sparkSession
        folder = shared_folder(spark)
        if self.mode == PERSIST or not folder:
            self._kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
            return self._kept[-1]
        path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
        self._written.append((spark, path))
        return spark.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession) -> str | None:
    """The folder that the cluster names for all executors, if it names one."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, name: str, mode: str | Run = TABLE) -> DataFrame:
    """Keep ``df`` for a run; a mode alone keeps it until the application ends."""
    return Run.of(mode).stage(df, name)
