"""Written intermediate tables of one run, in the folder that the driver and all executors share.

The folder is ``spark.checkpoint.dir``.  Only where a session of one local process leaves it
unset (tests) is a temporary folder taken, one for the whole session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marklake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Files:
    """What the engine does with folders, on any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def names(self, path: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(path))] if self.exists(path) else []

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)


class Scratch:
    """A folder of tables that belong to one run; nobody else knows its name."""

    def __init__(self, spark: SparkSession, name: str, root: str | None = None):
        self.spark = spark
        self.path = f"{root or folder(spark) + '/marklake'}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends at files that survive a lost executor."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        Files(self.spark, self.path).delete(f"{self.path}/{name}" if name else self.path)


_KEPT: dict[tuple, object] = {}


def kept(spark: SparkSession, name: str, source: str, build):
    """What ``build()`` wrote for ``source``, made once in a session: an index that many searches read."""
    key = (spark.sparkContext.applicationId, name, source)
    if key not in _KEPT:
        _KEPT[key] = build()
    return _KEPT[key]
