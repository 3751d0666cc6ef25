"""Intermediate tables in the folder that all executors share.

The folder is the one named by ``spark.checkpoint.dir``. Where that setting is
absent, a local session (as in tests) gets a folder of its own, once; on a cluster
its absence is an error, since executors don't share machine-local folders.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexloom-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/lexloom/{name}-{uuid.uuid4().hex}"


def free(names: list[str], *wanted: str) -> list[str]:
    """``wanted``, with underscores in front of those that clash with a name that is there (in any case)."""
    taken, out = {n.lower() for n in names}, []
    for w in wanted:
        while w.lower() in taken:
            w = "_" + w
        taken.add(w.lower())
        out.append(w)
    return out


class Table:
    """A DataFrame written once; ``df`` reads it back and ``drop`` deletes it."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = new_path(self.spark, name)
        df.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        delete(self.spark, self.path)


def filesystem(spark: SparkSession, path: str):
    """Hadoop's file system and path object for a path."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = filesystem(spark, path)
    fs.delete(p, True)
