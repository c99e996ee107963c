"""The note index: files and tasks, built from notes and kept current by keyed merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.yaml import yaml_to_json
from . import sections


def parsed(notes: DataFrame, mode: str = "index") -> DataFrame:
    """``notes (path, content, ...)`` with ``fm`` (JSON object) and ``body``; malformed front matter leaves the whole content as body."""
    yaml = T.front_matter(F.col("content"), mode)
    with_yaml = notes.withColumn("_yaml", yaml).withColumn("_fm", F.when(F.col("_yaml").isNotNull(), yaml_to_json("_yaml")))
    body = F.when(F.col("_fm").isNotNull(), T.body(F.col("content"), mode)).otherwise(F.col("content"))
    return with_yaml.withColumn("body", body).withColumn("fm", F.coalesce("_fm", F.lit("{}"))).drop("_yaml", "_fm")


def files(notes: DataFrame) -> DataFrame:
    """``path, title, created, modified, tags, frontmatter`` of parsed notes (``path, fm, body, mtime``)."""
    read = notes.select("path", "fm", "body", "mtime", F.json_tuple("fm", "title", "created", "modified", "tags").alias("title", "created", "changed", "listed"))
    tags = F.col("listed")
    listed = F.when(F.startswith(tags, F.lit("[")), F.from_json(tags, "array<string>")).when(tags != "", F.array(tags))
    modified = F.coalesce(T.day_of(F.nullif(F.col("changed"), F.lit(""))), F.date_format("mtime", "yyyy-MM-dd"))
    return read.select(
        "path", F.coalesce(F.nullif(F.col("title"), F.lit("")), T.basename(F.col("path"))).alias("title"), T.day_of(F.nullif(F.col("created"), F.lit(""))).alias("created"), modified.alias("modified"), T.all_tags(listed, F.col("body")).alias("tags"), F.col("fm").alias("frontmatter"),
    )


def tasks(notes: DataFrame) -> DataFrame:
    """``file_path, text, completed, due, pos`` of parsed notes."""
    lines = notes.select(F.col("path").alias("file_path"), F.posexplode(F.split("body", "\n")).alias("pos", "line")).where(F.contains("line", F.lit("- [")) & F.rlike("line", F.lit(T.TASK)))
    told = lines.select("file_path", "pos", F.regexp_extract("line", T.TASK, 1).isin("x", "X").cast("int").alias("completed"), T.js_trim(F.regexp_extract("line", T.TASK, 2)).alias("text"))  # each text is cut and trimmed once
    return told.select("file_path", "text", "completed", T.due_date(F.col("text")).alias("due"), "pos")


def upsert(table: DataFrame, changed: DataFrame, key: str, new_key: str | None = None) -> DataFrame:
    """Rows of ``table`` whose key is not in ``changed``, and all rows of ``changed`` (replace by key).

    As in all joins here, both sides may be of any size and are never broadcast.
    """
    new_key = new_key or key
    return table.join(changed.select(F.col(new_key).alias("_k")).distinct().hint("merge"), F.col(key) == F.col("_k"), "left_anti").unionByName(changed)


def delete(table: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """Rows of ``table`` whose key is not among ``paths (path)``."""
    return table.join(paths.select(F.col("path").alias("_k")).distinct().hint("merge"), F.col(key) == F.col("_k"), "left_anti")


def reconcile(index: DataFrame, vault: DataFrame) -> DataFrame:
    """``path, action``: ``remove`` for indexed paths that the vault lacks, ``add`` for the others' reverse."""
    gone = index.select("path").join(vault.select("path").hint("merge"), "path", "left_anti").withColumn("action", F.lit("remove"))
    new = vault.select("path").join(index.select("path").hint("merge"), "path", "left_anti").withColumn("action", F.lit("add"))
    return gone.unionByName(new)


def sync_status(index: DataFrame, vault: DataFrame) -> DataFrame:
    """``db_count, vault_count, in_sync``."""
    return index.agg(F.count("*").alias("db_count")).crossJoin(vault.agg(F.count("*").alias("vault_count"))).withColumn("in_sync", F.col("db_count") == F.col("vault_count"))


def unchunked(files_table: DataFrame, chunks_table: DataFrame) -> DataFrame:
    """``path`` of indexed files that have no chunk yet."""
    return files_table.select("path").join(chunks_table.select(F.col("file_path").alias("path")).distinct().hint("merge"), "path", "left_anti")


def _last(events: DataFrame) -> DataFrame:
    """The last event of every path; contents are shuffled and sorted once, not also before the shuffle as an aggregate of them would."""
    later = F.lead(F.lit(True)).over(Window.partitionBy("path").orderBy("seq"))
    return events.select("path", "event", "content", "ts", "seq").withColumn("_later", later).where("_later IS NULL").select("path", "event", "content", "ts")


def latest(events: DataFrame) -> DataFrame:
    """``path, event, mtime, fm, body`` of the last event of every path, its content parsed; all that tables are kept current from."""
    held = F.when(F.col("event") != "unlink", F.col("content"))
    return parsed(_last(events).select("path", "event", held.alias("content"), F.col("ts").alias("mtime"))).drop("content")


def made_chunks(notes: DataFrame, **options: int) -> DataFrame:
    """Chunks of parsed notes, without vectors."""
    titled = notes.select("path", F.coalesce(F.nullif(F.get_json_object("fm", "$.title"), F.lit("")), T.basename(F.col("path"))).alias("title"), "body")
    return sections.chunks(titled, **options)


def with_known(new: DataFrame, old: DataFrame, model: str | None = None) -> DataFrame:
    """Chunks with ``embedding, embed_model``: an equal chunk of ``old`` hands its vector on."""
    if model is None:
        return new.withColumn("embedding", F.lit(None).cast("array<float>")).withColumn("embed_model", F.lit(None).cast("string"))
    return sections.reuse(new, old, model).select(*new.columns, F.col("embedding").cast("array<float>").alias("embedding"), "embed_model")


def chunked(notes: DataFrame, old: DataFrame, model: str | None = None, **options: int) -> DataFrame:
    """Chunks of parsed notes with ``embedding, embed_model``: an equal chunk of ``old`` hands its vector on."""
    return with_known(made_chunks(notes, **options), old, model)


def apply_chunk_events(chunks_table: DataFrame, events: DataFrame, model: str | None = None, vectors: DataFrame | None = None, **options: int) -> DataFrame:
    """The chunk table after a batch of events: chunks of touched notes go, those of notes that stay are made anew.

    A chunk whose content the table or ``vectors (content_hash, embed_model, embedding)``
    holds keeps its vector, so an edit, a move or a copy costs no embedding of what did not change.
    """
    last = latest(events)
    known = chunks_table.select("content_hash", "embed_model", "embedding")
    known = known if vectors is None else known.unionByName(vectors.select(*known.columns))
    return delete(chunks_table, last.select("path"), "file_path").unionByName(chunked(staying(last), known, model, **options))


def staying(last: DataFrame) -> DataFrame:
    """Of :func:`latest` the notes that are there after the events."""
    return last.where("event <> 'unlink'")


def apply_events(files_table: DataFrame, tasks_table: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables after a batch of ``events (event, path, content, ts, seq)``; the last event of a path counts."""
    return apply_latest(files_table, tasks_table, latest(events))


def apply_latest(files_table: DataFrame, tasks_table: DataFrame, last: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same for what :func:`latest` made of the events."""
    now, touched = staying(last), last.select("path")
    return delete(files_table, touched, "path").unionByName(files(now)), delete(tasks_table, touched, "file_path").unionByName(tasks(now))
