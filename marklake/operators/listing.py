"""Listings, point and batch reads of notes and folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions.yaml import fm_text
from ..scratch import Scratch

MAX_BATCH = 100


def page_size(value, default: int = 20, most: int = 100) -> int:
    """A page size from free input: missing, zero and non-numbers give the default."""
    try:
        n = int(float(value))
    except (TypeError, ValueError):
        n = 0
    return min(max(n or default, 1), most)


def page_size_of(value: Column, default: int = 20, most: int = 100) -> Column:
    """The same for a column of free input."""
    n = F.coalesce(value.cast("string").try_cast("double").try_cast("int"), F.lit(0))
    return F.least(F.greatest(F.when(n == 0, default).otherwise(n), F.lit(1)), F.lit(most))


def batch_error(items: Column, most: int = MAX_BATCH) -> Column:
    """What is wrong with a list of entries, as :func:`checked_batch` says it; null for a good one."""
    size = F.coalesce(F.size(items), F.lit(0))
    return F.when(size <= 0, "a non-empty list is required").when(size > most, f"at most {most} entries are allowed")


def checked_batch(items: list, most: int = MAX_BATCH) -> list:
    if not isinstance(items, list) or not items:
        raise ValueError("a non-empty list is required")
    if len(items) > most:
        raise ValueError(f"at most {most} entries are allowed")
    return items


def in_range(date: Column, since: str | None, before: str | None) -> Column:
    """Both ends count; rows without a date pass."""
    inside = F.lit(True)
    if since:
        inside = inside & (date >= since)
    if before:
        inside = inside & (date <= before)
    return date.isNull() | inside


def reader_order(name: Column) -> Column:
    """Sort key of names as readers look them up: letters first, then accents, then case."""
    return F.collate(name, "UNICODE")


def list_files(files: DataFrame, *, path: str | None = None, since: str | None = None, before: str | None = None, allow: list[str] | None = None, deny: list[str] | None = None, **fields: str) -> DataFrame:
    """``path, frontmatter, date``: dated notes first, newest first, then by path.

    Filters that need no front matter come first, so they reach the scan.
    """
    df = files
    if path:
        df = df.where(F.contains("path", F.lit(path)))
    if allow or deny:
        df = df.where(P.can_access_file(F.col("path"), allow or [], deny or []))
    for key, value in fields.items():
        df = df.where(fm_text(F.col("frontmatter"), key) == value)
    date = F.coalesce(T.day_of(F.nullif(F.get_json_object("frontmatter", "$.created"), F.lit(""))), T.name_date(F.col("path"), whole_path=True))
    df = df.select("path", "frontmatter", date.alias("date")).where(in_range(F.col("date"), since, before))
    return df.orderBy(F.col("date").desc_nulls_last(), reader_order(F.col("path")), "path")


def numbered(ordered: DataFrame, name: str) -> DataFrame:
    """Rows of a sorted table with their place, from 1: numbered where they lie, so no task sees them all.

    The sorted rows are written with their number within their task; how many rows the
    tasks before it had, one figure a task, is added.
    """
    written = Scratch(ordered.sparkSession, "numbered").save(ordered.withColumn("_at", F.monotonically_increasing_id()), "rows")
    placed = written.withColumn("_task", F.shiftright("_at", 33))
    sizes = placed.groupBy("_task").agg(F.count("*").alias("_n"))
    before = sizes.select("_task", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    number = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before") + 1
    return placed.join(F.broadcast(before), "_task").select(*ordered.columns, number.alias(name))


def directory(paths: DataFrame, folder: str = "", allow: list[str] | None = None, deny: list[str] | None = None) -> DataFrame:
    """``name, type`` of the direct children of a folder: folders first, then by name."""
    prefix = folder.strip("/") + "/" if folder.strip("/") else ""
    below = paths.where(F.startswith("path", F.lit(prefix))).select(F.substring("path", len(prefix) + 1, 1 << 30).alias("rest"))
    child = below.select(F.split_part("rest", F.lit("/"), F.lit(1)).alias("name"), F.when(F.contains("rest", F.lit("/")), "directory").otherwise("file").alias("type")).distinct()
    if allow or deny:
        full = F.concat(F.lit(prefix), F.col("name"))
        child = child.where(F.when(F.col("type") == "directory", P.can_access_path(full, allow or [], deny or [])).otherwise(P.can_access_file(full, allow or [], deny or [])))
    return child.orderBy("type", reader_order(F.col("name")), "name")


def projects(paths: DataFrame, root: str = "20_Projects/Pro") -> DataFrame:
    """Names of the folders directly below ``root``."""
    return directory(paths, root).where("type = 'directory'").select("name").orderBy(reader_order(F.col("name")), "name")


def read(notes: DataFrame, path: str, links: bool = False) -> DataFrame:
    """One row for the wanted path: the note, its links if asked for, or an error."""
    out = batch_read(notes.sparkSession, notes, [path]).drop("pos")
    return out.withColumn("links", T.link_targets(F.coalesce("content", F.lit("")))) if links else out


def resources(notes: DataFrame) -> DataFrame:
    """``uri, name`` of every note."""
    return notes.select(F.concat(F.lit("note://files/"), F.col("path")).alias("uri"), T.basename(F.col("path")).alias("name"))


def health(notes: DataFrame) -> DataFrame:
    """``status, notes``: whether the notes can be read, and how many there are."""
    return notes.agg(F.lit("ok").alias("status"), F.count("*").alias("notes"))


def context(notes: DataFrame, path: str = "agent.md") -> DataFrame:
    """``content`` of one note, or a sentence that it is missing."""
    return notes.where(F.col("path") == path).agg(F.coalesce(F.first("content"), F.lit(f"{path} not found")).alias("content"))


def batch_read(spark: SparkSession, notes: DataFrame, wanted: list[str]) -> DataFrame:
    """One row per wanted path, in the order asked for, with an error instead of a failure."""
    asked = spark.createDataFrame(list(enumerate(checked_batch(wanted))), "pos int, path string")
    safe = P.canonical(F.col("path"))
    joined = F.broadcast(asked).withColumn("key", safe).join(notes.withColumnRenamed("path", "_path"), F.col("key") == F.col("_path"), "left")
    error = F.when(F.col("key").isNull(), "Access denied").when(F.col("_path").isNull(), "File not found")
    return joined.withColumn("error", error).drop("key", "_path").orderBy("pos")
