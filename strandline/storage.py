"""Intermediate results in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: For actions whose result is written: shuffle files go as soon as the action has ended, instead of when the driver
#: collects garbage, and small partitions are joined to the advisory size, so that small tables are few files.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where none is set, local mode gets a temporary one; a cluster must name one."""
    sc = spark.sparkContext
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not folder:
            folder = tempfile.mkdtemp(prefix="strandline-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
        held = sc._jsc.sc().getCheckpointDir()
    at = sc._jvm.org.apache.hadoop.fs.Path(held.get())
    # This application's own folder: what is left in it goes when the driver ends.
    at.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(at)
    return held.get()


@contextmanager
def tidy(spark: SparkSession, few: bool = True) -> Iterator[None]:
    """Actions inside leave no shuffle files behind; what they return must not depend on them.

    Without ``few`` small partitions are joined only as far as every core still has one.
    """
    put = {k: v for k, v in TIDY.items() if few or "coalesce" not in k}
    before = {k: spark.conf.get(k, None) for k in put}
    for k, v in put.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def materialise(df: DataFrame, few: bool = True) -> DataFrame:
    """A reliable checkpoint in the shared folder. What takes long to compute for each byte goes without ``few``: on every core."""
    shared_folder(df.sparkSession)
    with tidy(df.sparkSession, few):
        return df.checkpoint(eager=True)


class Scratch:
    """Tables written to a folder of their own under the shared folder, so that each can be removed when it is done with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/{uuid.uuid4()}", {}

    def write(self, df: DataFrame) -> DataFrame:
        """df written once and read back, without its lineage."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        with tidy(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path, out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later step reads."""
        for t in tables:
            path, _ = self.paths.pop(id(t))
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

    def clear(self, but: DataFrame) -> None:
        """Remove all tables but the one that is returned."""
        self.drop(*[t for _, t in list(self.paths.values()) if t is not but])
