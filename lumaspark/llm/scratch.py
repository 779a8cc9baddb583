"""Intermediate tables that cut lineage.

Tables are written as Parquet below ``spark.checkpoint.dir``, which the driver and all executors share, so a
lost executor costs a re-read and nothing else. Only where that setting is absent and the session runs in one process (tests, a
laptop) is a local folder used.
"""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}
#: Folders of tables that this process has made and not deleted, in order.
MADE: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder: the session's ``spark.checkpoint.dir``; one temporary folder per process if unset and the
    master is local; on a cluster an unset folder is an error, as executors would each write to their own disk."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = tempfile.mkdtemp(prefix="lumaspark-")
    return f"file://{_LOCAL['dir']}"


class Scratch:
    """Tables of one run. ``keep`` writes a table and reads it back; ``drop`` deletes one that is no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{folder(spark)}/lumaspark-{uuid.uuid4().hex}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)
        MADE.append(self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def keep(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        path = self.path(name)
        df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        for df in tables:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._scratch_path), True)


def delete(spark: SparkSession, roots: list[str]) -> None:
    """Delete folders of tables that nothing reads any more, and let the cleaner remove the shuffle files of plans that are gone."""
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        MADE.remove(root)
    gc.collect()
    spark._jvm.System.gc()
