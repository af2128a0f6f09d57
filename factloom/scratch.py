"""Intermediate tables in the folder that driver and executors share.

A table written here cuts the lineage and survives the loss of an executor. The
folder is the one the cluster names in ``spark.checkpoint.dir``; only a local
session without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from factloom.workers import importable

_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    key = context.applicationId
    if key not in _local:
        folder = tempfile.TemporaryDirectory(prefix="factloom-")
        _local[key] = folder.name
        atexit.register(folder.cleanup)
    return _local[key]


def _delete(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may have ended already
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


class Scratch:
    """Tables of one operator call: ``table`` writes and rereads, ``drop`` frees early.

    What is not dropped stays until the driver's Python ends, as the returned
    plan may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        importable(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/factloom-{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        atexit.register(_delete, spark, self.root)

    def table(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.root}/{self._n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def clear(self) -> None:
        """All tables go; no plan may read them any more."""
        _delete(self.spark, self.root)
        self._paths.clear()

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            path = getattr(t, "_scratch_path", None)
            if path:
                _delete(self.spark, path)


def broadcast_if_small(df: DataFrame, size: int, limit: int = 50_000) -> DataFrame:
    """A broadcast hint for a table whose counted rows, with the entries of their arrays, are within the limit; else the plain table, joined by shuffle.

    Rows and entries are numbers and short names, under 100 bytes each.
    """
    from pyspark.sql import functions as F

    return F.broadcast(df) if size <= limit else df
