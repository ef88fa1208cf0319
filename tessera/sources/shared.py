"""The folder that driver and executors share, as the session names it, and tables in it."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir.

    Where the setting is absent, a local session (tests) gets a folder of its own; on a cluster
    that is an error, as executors would write to disks of their own.
    """
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if context.master != "local" and not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            named = tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


class Scratch:
    """Tables in the shared folder the cluster names in spark.checkpoint.dir.

    Writing a table cuts lineage as checkpoint() does, but compressed and in
    columns. Files survive a lost executor; they go when dropped or at the
    driver's exit. Where the setting is absent, only a local session (tests)
    gets a folder. `tidy` lets Spark delete the shuffles behind each table at once,
    which costs a collection of garbage; steps of a few MB do without.
    """

    def __init__(self, spark: SparkSession, tidy: bool = True):
        context = spark.sparkContext
        self.spark, self.tidy = spark, tidy
        self.root = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
        jvm = context._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(context._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(self._path(self.root))

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """df, written once."""
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        if self.tidy:
            released(self.spark)
        return out

    def drop(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def close(self) -> None:
        """Drops all tables now, not at the driver's exit; nothing may read them any more."""
        self._fs.delete(self._path(self.root), True)


def released(spark: SparkSession) -> None:
    """Collect garbage on the driver, so that shuffle files nothing refers to are deleted now."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: a small file of one row group is one task otherwise.

    Large inputs have more splits than that and stay as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
