"""Written tables in the folder that the driver and all executors share.

The folder is ``spark.checkpoint.dir``.  Only where the session leaves it unset
and runs in one local process (tests) is a temporary folder taken instead.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="marklake-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Workspace:
    """A folder of written tables that belong to one run of one operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/marklake/{name}-{uuid.uuid4().hex}"
        self.names: set[str] = set()

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends at files that survive a lost executor."""
        at = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(at)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str = "") -> None:
        """Delete one table, or the whole folder, once nothing reads it any more."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.names.discard(name)

    def settle(self, df: DataFrame) -> DataFrame:
        """Write a result and delete all tables that it came from: only the result is left behind."""
        out = self.save(df, "result")
        for name in self.names - {"result"}:
            self.drop(name)
        return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
