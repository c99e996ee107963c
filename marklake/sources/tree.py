"""Listings of a folder tree made by tasks, and what changed between two of them.

The tree is walked level by level: the folders of a level are dealt over tasks, each of
which lists its folders through a file system address (local, HDFS, object stores) and
states every folder's digest, over names, sizes and times.  The driver sees how many
folders a level has and nothing else.  Two listings are compared folder by folder first:
entries are joined only for folders whose digests differ.
"""

from __future__ import annotations

import hashlib
import posixpath
from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Files, Scratch

LISTING = "folder string, name string, is_folder boolean, size long, mtime long, digest string"
FOLDERS = 200  # folders that one task lists
READS = 200  # files that one task reads


def _place(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def _listed(root: str, hidden: bool) -> Callable:
    def work(batches):
        store, base = _place(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = store.get_file_info(pafs.FileSelector(posixpath.join(base, folder) if folder else base, allow_not_found=True))
                rows = sorted((x.base_name, x.type == pafs.FileType.Directory, x.size or 0, x.mtime_ns or 0) for x in found if hidden or not x.base_name.startswith("."))
                rows = [(n, d, 0 if d else s, 0 if d else t // 1000) for n, d, s, t in rows if d or n.lower().endswith(".md")]
                digest = hashlib.sha256(repr(rows).encode()).hexdigest()
                cells = list(zip(*rows)) or [(), (), (), ()]
                n = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array([folder] * n, pa.string()), pa.array(cells[0], pa.string()), pa.array(cells[1], pa.bool_()), pa.array(cells[2], pa.int64()), pa.array(cells[3], pa.int64()), pa.array([digest] * n, pa.string())], ["folder", "name", "is_folder", "size", "mtime", "digest"])

    return work


def listing(spark: SparkSession, root: str, at: str, hidden: bool = False) -> DataFrame:
    """Write the listing of the tree below ``root`` to ``at`` and read it back; an incomplete one there is replaced."""
    work = Scratch(spark, "listing")
    levels, frontier, n = [], spark.createDataFrame([("",)], "folder string"), 1
    while n:
        level = work.save(frontier.repartition(-(-n // FOLDERS)).mapInArrow(_listed(root, hidden), LISTING), str(len(levels)))
        levels.append(level)
        frontier = level.where("is_folder").select(F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name")).alias("folder"))
        n = frontier.count()
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    every.write.mode("overwrite").parquet(at)
    work.drop()
    return spark.read.schema(LISTING).parquet(at)


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """``event, path, ts`` between two listings; folders with equal digests are passed over."""
    folders = lambda df: df.select("folder", "digest").distinct()
    same = folders(old).join(folders(new), ["folder", "digest"], "left_semi")
    path = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
    files = lambda df: df.join(same, ["folder", "digest"], "left_anti").where("NOT is_folder").select(path.alias("path"), F.struct("size", "mtime").alias("at"))
    both = files(old).withColumnRenamed("at", "was").join(files(new).withColumnRenamed("at", "now"), "path", "full")
    event = F.when(F.col("was").isNull(), "add").when(F.col("now").isNull(), "unlink").when(F.col("was") != F.col("now"), "change")
    return both.select(event.alias("event"), "path", F.timestamp_micros("now.mtime").alias("ts")).where("event IS NOT NULL")


def contents(rows: DataFrame, root: str) -> DataFrame:
    """``event, path, content, ts`` of changes, the files read by tasks; a file that is gone by now counts as removed."""
    def work(batches):
        store, base = _place(root)
        for batch in batches:
            events, paths, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for i, path in enumerate(paths):
                text = None
                if events[i] != "unlink":
                    try:
                        with store.open_input_stream(posixpath.join(base, path)) as f:
                            text = f.read().decode("utf-8", "replace")
                    except FileNotFoundError:
                        events[i] = "unlink"
                texts.append(text)
            yield pa.RecordBatch.from_arrays([pa.array(events, pa.string()), batch.column(1), pa.array(texts, pa.string()), batch.column(2)], ["event", "path", "content", "ts"])

    return rows.select("event", "path", "ts").mapInArrow(work, "event string, path string, content string, ts timestamp")


def poll(spark: SparkSession, root: str, state: str, turn: int, hidden: bool = False) -> DataFrame:
    """The changes since turn ``turn - 1``, whose listing lies below ``state``; a repeated turn compares with the same one again."""
    files = Files(spark, state)
    before = f"{state}/{turn - 1}"
    old = spark.read.schema(LISTING).parquet(before) if files.exists(f"{before}/_SUCCESS") else spark.createDataFrame([], LISTING)
    new = listing(spark, root, f"{state}/{turn}", hidden)
    if files.exists(f"{state}/{turn - 2}"):
        files.delete(f"{state}/{turn - 2}")
    found = changes(old, new)
    return contents(found.repartition(max(1, -(-found.count() // READS))), root)


def watch(spark: SparkSession, root: str, state: str, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds", hidden: bool = False):
    """A running query that polls the tree and hands each turn's changes to ``sink``, such as ``pipeline.batch``."""
    ticks = spark.readStream.format("rate").load()
    return ticks.writeStream.foreachBatch(lambda _, turn: sink(poll(spark, root, state, turn, hidden), turn)).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
