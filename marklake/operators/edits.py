"""Changes to notes as row transforms: a new snapshot of ``notes (path, content, ...)`` comes out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as T
from ..functions.yaml import json_to_front, merge_json
from .index import parsed
from .listing import checked_batch

TRASH = ".trash"


def _at(path: str) -> Column:
    return F.col("path") == path


def _row(notes: DataFrame, path: str, content: str, now: str | None) -> DataFrame:
    row = notes.sparkSession.createDataFrame([(path, content)], "path string, content string")
    return row.withColumn("mtime", F.lit(now).cast("timestamp")) if now and "mtime" in notes.columns else row


def write(notes: DataFrame, path: str, content: str, now: str | None = None) -> DataFrame:
    """The note's content replaced, or the note added, with ``now`` as its time."""
    return notes.where(~_at(path)).unionByName(_row(notes, path, content, now), allowMissingColumns=True)


def append(notes: DataFrame, path: str, text: str, now: str | None = None) -> DataFrame:
    """The text as a further line of the note; a note that is not there is made."""
    new = F.when(F.coalesce("content", F.lit("")) == "", F.lit(text)).otherwise(F.concat("content", F.lit("\n" + text)))
    longer = notes.withColumn("content", F.when(_at(path), new).otherwise(F.col("content")))
    absent = _row(notes, path, text, now).join(notes.where(_at(path)).select("path"), "path", "left_anti")
    return longer.unionByName(absent, allowMissingColumns=True)


def replace_body(notes: DataFrame, path: str, body: str) -> DataFrame:
    """The body replaced; front matter is written anew when there is any."""
    one = parsed(notes.where(_at(path)), "api")
    front = F.when(F.col("fm") != "{}", json_to_front("fm")).otherwise("")
    return notes.where(~_at(path)).unionByName(one.withColumn("content", F.concat(front, F.lit(body))).select(*notes.columns))


def patched(content: Column, old: str, new: str, every: bool = False) -> Column:
    """First or all occurrences of a literal replaced."""
    if not old:
        raise ValueError("the text to replace is empty")
    if every:
        return F.replace(content, F.lit(old), F.lit(new))
    at = F.instr(content, old)
    once = F.concat(F.substring(content, F.lit(1), at - 1), F.lit(new), F.substring(content, at + len(old), F.lit(1 << 30)))
    return F.when(at > 0, once).otherwise(content)


def patch(notes: DataFrame, path: str, old: str, new: str, every: bool = False) -> tuple[DataFrame, DataFrame]:
    """New notes, and a report ``occurrences, replacements, changed, error``."""
    out = notes.withColumn("content", F.when(_at(path), patched(F.col("content"), old, new, every)).otherwise(F.col("content")))
    n = T.occurrences(F.col("content"), F.lit(old))
    done = n if every else F.least(n, F.lit(1))
    report = notes.where(_at(path)).select(n.alias("occurrences"), done.alias("replacements"), (done > 0).alias("changed"), F.when(n == 0, "text not found").alias("error"))
    return out, report


def merge_front(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Front matter of the notes in ``changes (path, fm_new)`` merged key by key; the new value wins, nulls are stored."""
    both = parsed(notes, "api").join(changes, "path", "left")
    merged = F.concat(json_to_front(merge_json("fm", "fm_new")), F.col("body"))
    return both.withColumn("content", F.when(F.col("fm_new").isNotNull(), merged).otherwise(F.col("content"))).select(*notes.columns)


def move(notes: DataFrame, moves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New notes, and ``path, destination, error``, for ``moves (path, destination)``.

    Of several moves of one note that to the smallest destination counts; of several
    moves to one place that of the smallest path succeeds.
    """
    have = notes.select("path")
    state = moves.groupBy("path").agg(F.min("destination").alias("destination")).withColumn("safe", P.canonical(F.col("destination")))
    state = state.join(have.withColumn("found", F.lit(True)), "path", "left")
    state = state.join(have.select(F.col("path").alias("safe"), F.lit(True).alias("taken")), "safe", "left")
    blocked = F.when(F.col("safe").isNull(), "Access denied").when(F.col("found").isNull(), "File not found").when(F.col("taken"), "Destination exists")
    state = state.withColumn("blocked", blocked)
    nth = F.row_number().over(Window.partitionBy("safe", F.col("blocked").isNull()).orderBy("path"))
    error = F.coalesce("blocked", F.when(nth > 1, "Destination exists"))
    report = state.select("path", F.col("safe").alias("destination"), error.alias("error"))
    ok = report.where("error IS NULL").select("path", "destination")
    moved = notes.join(ok, "path", "left").withColumn("path", F.coalesce("destination", "path")).select(*notes.columns)
    return moved, report


def into_folder(paths: list[str], folder: str) -> list[tuple[str, str]]:
    """Moves that keep the file names."""
    return [(p, f"{folder.strip('/')}/{p.rsplit('/', 1)[-1]}") for p in checked_batch(paths)]


def move_folder(notes: DataFrame, source: str, destination: str) -> DataFrame:
    """Every note below ``source`` below ``destination`` instead."""
    src, dst = source.strip("/"), destination.strip("/")
    if not src or not dst or src == dst:
        raise ValueError("source and destination must be two folders")
    if dst.startswith(src + "/"):
        raise ValueError("a folder cannot be moved into itself")
    if not notes.where(F.startswith("path", F.lit(dst + "/"))).isEmpty():
        raise ValueError("the destination exists")
    inside = F.startswith("path", F.lit(src + "/"))
    return notes.withColumn("path", F.when(inside, F.concat(F.lit(dst), F.substring("path", len(src) + 1, 1 << 30))).otherwise(F.col("path")))


def delete(notes: DataFrame, targets: DataFrame, now: str, hard: bool = False) -> DataFrame:
    """Notes without those of ``targets (path)``; soft deletion moves them to the trash and stamps them.

    A name that the trash already holds gets the time in its name, and a number if that is taken too.
    """
    gone = notes.join(targets.select("path").distinct(), "path", "left_semi")
    rest = notes.join(targets.select("path").distinct(), "path", "left_anti")
    if hard:
        return rest
    there = notes.where(F.startswith("path", F.lit(TRASH + "/"))).select(F.col("path").alias("_there"))
    stamp = "".join(c for c in now if c.isdigit())
    to = F.concat(F.lit(TRASH + "/"), F.col("path"))
    stamped = rf"-{stamp}(-\d+)?\.md\z"
    again = there.where(F.rlike("_there", F.lit(stamped))).groupBy(F.regexp_replace("_there", stamped, ".md").alias("_base")).agg(F.count("*").alias("_times"))
    moved = gone.withColumn("_to", to).join(there, F.col("_to") == F.col("_there"), "left").join(again, F.col("_to") == F.col("_base"), "left")
    number = F.when(F.col("_times") > 0, F.concat(F.lit("-"), F.col("_times").cast("string"))).otherwise("")
    moved = moved.withColumn("path", F.when(F.col("_there").isNull(), F.col("_to")).otherwise(F.concat(F.regexp_replace("_to", r"\.md\z", ""), F.lit(f"-{stamp}"), number, F.lit(".md"))))
    if "mtime" in notes.columns:
        moved = moved.withColumn("mtime", F.lit(now).cast("timestamp"))
    return rest.unionByName(moved.select(*notes.columns))


def delete_folders(notes: DataFrame, folders: list[str], now: str, hard: bool = False) -> DataFrame:
    below = F.lit(False)
    for f in checked_batch(folders):
        below = below | F.startswith("path", F.lit(f.strip("/") + "/"))
    return delete(notes, notes.where(below & ~F.startswith("path", F.lit(TRASH + "/"))), now, hard)


def create_folders(folders: DataFrame, wanted: list[str]) -> DataFrame:
    """``path, already_existed, error`` for wanted folders against ``folders (path)``."""
    asked = folders.sparkSession.createDataFrame([(p,) for p in checked_batch(wanted)], "wanted string").withColumn("path", P.canonical(F.col("wanted")))
    joined = asked.join(folders.select("path", F.lit(True).alias("there")).distinct(), "path", "left")
    return joined.select(F.col("wanted").alias("path"), F.coalesce("there", F.lit(False)).alias("already_existed"), F.when(F.col("path").isNull(), "Access denied").alias("error"))


def purge(notes: DataFrame, now: str, retention_days: int = 30) -> DataFrame:
    """Notes without trashed ones that are older than the retention; 0 or less keeps all."""
    if retention_days <= 0:
        return notes
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(retention_days))
    return notes.where(~F.startswith("path", F.lit(TRASH + "/")) | (F.col("mtime") >= cutoff))


def batch_summary(report: DataFrame) -> DataFrame:
    """``count, failed_count`` of a report with an ``error`` column."""
    return report.agg(F.count("*").alias("count"), F.count_if(F.col("error").isNotNull()).alias("failed_count"))
