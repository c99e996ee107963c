"""The index kept current by a stream of changes, with rule matching and delivery."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from ..operators import edits, index, sections, webhooks
from ..schema import EMBEDDED, FILES, TASKS, VECTORS
from ..scratch import Scratch
from .deliver import REPORT, deliver, public_address

TABLES = {"files": ("path", FILES), "tasks": ("file_path", TASKS), "chunks": ("file_path", EMBEDDED)}
BY_CONTENT = {"vectors": ("content_hash", VECTORS)}
BUCKETS = 64


class Store:
    """Files, tasks and chunks in buckets by hash of the path, and vectors in buckets by hash of their content, on any file system that Spark reaches.

    A turn writes the buckets that its changes touch and nothing else; then a manifest,
    which names the writing (turn and attempt) of every bucket, makes it count.  A repeated
    turn is a further attempt under names of its own: nothing that a reader may be at is
    overwritten or deleted before its successor counts.  What no manifest of the last
    ``keep`` turns names is deleted.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS, keep: int = 3):
        self.spark, self.root, self.buckets, self.keep = spark, root.rstrip("/"), buckets, keep
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._path(f"{self.root}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _writings(self) -> list[tuple[int, int]]:
        """``(turn, attempt)`` of all manifests, oldest first."""
        return sorted(tuple(map(int, n.split("-"))) for n in self._names("manifest") if n.replace("-", "", 1).isdigit())

    def _turns(self) -> list[int]:
        return sorted({turn for turn, _ in self._writings()})

    def manifest(self, before: int | None = None) -> dict[str, str]:
        """Bucket to writing, as of the last turn before ``before``; buckets of vectors are named ``v...``."""
        found = [w for w in self._writings() if before is None or w[0] < before]
        if not found:
            return {}
        stream = self._fs.open(self._path(f"{self.root}/manifest/{found[-1][0]}-{found[-1][1]}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def bucket(self, key):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def table(self, name: str, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        schema, sign = (TABLES | BY_CONTENT)[name][1], "v" if name in BY_CONTENT else ""
        named = {int(b.removeprefix("v")): w for b, w in self.manifest(before).items() if b.startswith("v") == bool(sign)}
        at = [f"{self.root}/{name}/{w}/bucket={b}" for b, w in named.items() if only is None or b in only]
        at = [p for p in at if self._fs.exists(self._path(p))]
        return self.spark.read.schema(schema).parquet(*at) if at else self.spark.createDataFrame([], schema)

    def load(self, before: int | None = None, only: set[int] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        return tuple(self.table(name, before, only) for name in TABLES)

    def buckets_of(self, df: DataFrame, key: str) -> set[int]:
        return {r[0] for r in df.select(self.bucket(F.col(key))).distinct().collect()}  # at most as many as there are buckets

    def save(self, turn: int, touched: set[int], tables: dict[str, DataFrame], hashes: set[int] = frozenset()) -> None:
        """Write the ``touched`` buckets of the tables by path, and the buckets ``hashes`` of vectors."""
        attempt = 1 + max((a for t, a in self._writings() if t == turn), default=-1)
        for name in (*TABLES, *BY_CONTENT):  # folders that an attempt left without a manifest are passed over
            attempt = max([attempt, *(1 + int(n.split("-")[1]) for n in self._names(name) if n.startswith(f"{turn}-"))])
        writing = f"{turn}-{attempt}"
        for name, df in tables.items():
            key = (TABLES | BY_CONTENT)[name][0]
            placed = df.withColumn("bucket", self.bucket(F.col(key)))
            # by bucket, but a large bucket is cut into several tasks' files: no task sorts a share of the whole table
            placed.hint("rebalance", F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/{writing}")
        state = self.manifest(before=turn) | {str(b): writing for b in touched} | {f"v{b}": writing for b in hashes}
        temp = self._path(f"{self.root}/manifest/.{uuid.uuid4().hex}")
        out = self._fs.create(temp, True)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self._fs.rename(temp, self._path(f"{self.root}/manifest/{writing}"))
        self._clean()

    def _clean(self) -> None:
        turns = self._turns()[-self.keep :]
        last = {t: max(a for u, a in self._writings() if u == t) for t in turns}
        named = {w for t in turns for w in self.manifest(before=t + 1).values()} | {f"{t}-{a}" for t, a in last.items()}
        for t, a in self._writings():
            if last.get(t) != a:
                self._fs.delete(self._path(f"{self.root}/manifest/{t}-{a}"), False)
        for name in (*TABLES, *BY_CONTENT):
            for n in self._names(name):
                if n not in named:
                    self._fs.delete(self._path(f"{self.root}/{name}/{n}"), True)

    # ---- what was sent ----
    def sent(self, turn: int) -> DataFrame:
        """Results of the deliveries of a turn."""
        at = f"{self.root}/outbox/{turn}"
        return self.spark.read.schema(REPORT).parquet(at) if self._fs.exists(self._path(at)) else self.spark.createDataFrame([], REPORT)


def batch(store: Store, changes: DataFrame, turn: int, rules: DataFrame | None = None, transport: Callable | None = None, report: Callable[[DataFrame], None] | None = None, model: str | None = None, lexical=None, guard: Callable[[str], bool] | None = public_address, **sending) -> None:
    """One batch of changes ``(event, path, content, ts[, seq])``; without ``seq`` the time orders them.

    Index first for adds and changes; a removed note is matched by its last known
    front matter.  Only the buckets of changed paths are read and written, and of vectors
    those that the new chunks' contents fall into.  ``lexical`` (a ``lexical.LexicalIndex``
    of chunks, owned by their notes) gets the batch as a segment.  What a batch has sent
    is written to the outbox, and a repeated batch doesn't send it again; ``sending`` are
    further options of :func:`deliver`.
    """
    changes = changes.withColumn("seq", F.struct(F.col("seq") if "seq" in changes.columns else F.lit(0).alias("seq"), "ts"))
    sends = rules is not None and transport is not None
    work = Scratch(store.spark, "batch", f"{store.root}/work")
    try:
        if sends:  # read again for the rules
            changes = work.save(changes, "changes")
        # one parsed row a path, made once: every table is kept current from it
        last = work.save(index.latest(changes), "last")
        touched = store.buckets_of(last, "path")
        if not touched:
            return
        files, tasks, chunks = store.load(before=turn, only=touched)
        new_files, new_tasks = index.apply_latest(files, tasks, last)
        made = index.made_chunks(index.staying(last))
        known = chunks.select("content_hash", "embed_model", "embedding")
        if model is not None:
            made = work.save(made, "chunks")
            vectors = store.table("vectors", before=turn, only=store.buckets_of(made, "content_hash"))
            known = known.unionByName(vectors.select(*known.columns))
        new_chunks = index.delete(chunks, last.select("path"), "file_path").unionByName(index.with_known(made, known, model))
        store.save(turn, touched, {"files": new_files, "tasks": new_tasks, "chunks": new_chunks})
        if lexical is not None:
            paths = last.select("path")
            made = store.table("chunks", before=turn + 1, only=touched).withColumn("path", F.col("file_path")).join(paths, "path", "left_semi")
            lexical.apply(made.withColumnsRenamed({"file_path": "owner", "chunk_id": "id"}), turn, paths.withColumnRenamed("path", "owner"))
        if not sends:
            return
        now = store.table("files", before=turn + 1, only=touched)
        known = now.select("path", "frontmatter").withColumn("gone", F.lit(False)).unionByName(files.select("path", "frontmatter").withColumn("gone", F.lit(True)))
        named = changes.withColumn("gone", F.col("event") == "unlink").join(known, ["path", "gone"], "left")
        events = named.select("event", "path", "content", F.coalesce("frontmatter", F.lit("{}")).alias("frontmatter"), "ts")
        key = F.sha2(F.to_json(F.struct(F.lit(turn).alias("turn"), "webhook_id", "path", "event", "ts")).cast("binary"), 256)
        matched = webhooks.match(events, rules).withColumn("key", key).dropDuplicates(["key"])
        due = matched.join(store.sent(turn).select("key"), "key", "left_anti")
        deliver(due, transport, guard=guard, **sending).write.mode("append").parquet(f"{store.root}/outbox/{turn}")
        if report:
            report(store.sent(turn))
    finally:
        work.drop()


def embed(store: Store, embedder: Callable[[list[str]], list[list[float]]], model: str, turn: int, **options) -> None:
    """Vectors for the chunks that lack one of this model, as a turn of its own: each content is embedded once, wherever and however often it occurs."""
    chunks = store.table("chunks", before=turn)
    lacking = chunks.where(F.col("embedding").isNull() | (F.col("embed_model") != model))
    hashes = store.buckets_of(lacking, "content_hash")
    if not hashes:
        return
    old = store.table("vectors", before=turn, only=hashes)
    known = old.where(F.col("embed_model") == model)
    contents = lacking.dropDuplicates(["content_hash"]).join(known.select("content_hash"), "content_hash", "left_anti")
    empty = F.lit(None).cast("array<float>")
    made = sections.backfill(contents.select("content_hash", "text", F.lit(model).alias("embed_model"), empty.alias("embedding")), embedder, model, **options)
    vectors = old.unionByName(made.select("content_hash", "embed_model", "embedding"))
    touched = store.buckets_of(lacking, "file_path")
    # vectors first, in a writing of their own: the chunks are joined with what was written, and nothing is embedded twice
    store.save(turn, set(), {"vectors": vectors}, hashes)
    files, tasks, mine = store.load(before=turn, only=touched)
    done = store.table("vectors", before=turn + 1, only=hashes)
    has = F.col("embedding").isNotNull() & (F.col("embed_model") == model)
    joined = sections.reuse(mine.where(~F.coalesce(has, F.lit(False))).drop("embedding", "embed_model"), done, model).select(*mine.columns)
    store.save(turn, touched, {"files": files, "tasks": tasks, "chunks": mine.where(has).unionByName(joined), "vectors": done}, hashes)


def references(store: Store) -> DataFrame:
    """``content_hash, embed_model, n``: how many chunks hold the content of every vector."""
    held = store.table("chunks").groupBy("content_hash").agg(F.count("*").alias("n"))
    return store.table("vectors").select("content_hash", "embed_model").join(held, "content_hash", "left").select("content_hash", "embed_model", F.coalesce("n", F.lit(0)).alias("n"))


def forget(store: Store, turn: int) -> None:
    """Drop the vectors that no chunk refers to, as a turn of its own."""
    unused = references(store).where("n = 0")
    hashes = store.buckets_of(unused, "content_hash")
    if hashes:
        kept = store.table("vectors", before=turn, only=hashes).join(unused.select("content_hash").distinct(), "content_hash", "left_anti")
        store.save(turn, set(), {"vectors": kept}, hashes)


def start(stream: DataFrame, store: Store, checkpoint: str, *, first_turn: int = 0, **options):
    """A running query over ``stream (event, path, content, ts[, seq])``; a repeated batch writes the same turn again.

    ``first_turn`` is the store's turn for the stream's first batch: one more than the
    last one that :func:`catch_up` took.
    """
    trigger = options.pop("trigger", {"processingTime": "1 second"})
    return stream.writeStream.foreachBatch(lambda df, turn: batch(store, df, first_turn + turn, **options)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def catch_up(store: Store, vault: DataFrame, turn: int, model: str | None = None) -> None:
    """Before a stream starts: notes that the index lacks are added, those that are gone removed; rules see nothing of it."""
    actions = index.reconcile(store.table("files", before=turn), vault)
    added = vault.join(actions.where("action = 'add'").select("path"), "path", "left_semi").select(F.lit("add").alias("event"), "path", "content", F.col("mtime").alias("ts"))
    gone = actions.where("action = 'remove'").select(F.lit("unlink").alias("event"), "path", F.lit(None).cast("string").alias("content"), F.lit(None).cast("timestamp").alias("ts"))
    batch(store, added.unionByName(gone), turn, model=model)


def purge_regularly(spark: SparkSession, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], *, now: Callable[[], str], retention_days: int = 30, every: str = "24 hours"):
    """A running query that purges the trash once for each interval."""
    ticks = spark.readStream.format("rate").load()
    return ticks.writeStream.foreachBatch(lambda _, turn: save(edits.purge(load(), now(), retention_days))).trigger(processingTime=every).start()


class Health(StreamingQueryListener):
    """What a running stream last did: ready, closed, last batch and last error; ``spark.streams.addListener(Health())``."""

    def __init__(self):
        self.ready, self.closed, self.last_event, self.last_error, self.rows = False, False, None, None, 0

    def onQueryStarted(self, event):
        self.ready, self.closed = True, False

    def onQueryProgress(self, event):
        if event.progress.numInputRows:
            self.last_event, self.rows = event.progress.timestamp, self.rows + event.progress.numInputRows

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ready, self.closed, self.last_error = False, True, event.exception

    def status(self) -> dict:
        return {"watcher_ready": self.ready, "watcher_closed": self.closed, "last_event": self.last_event, "last_error": self.last_error, "rows": self.rows}


def windowed_counts(events: DataFrame, *, time_col: str = "ts", late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Events per kind in tumbling windows, with late rows dropped after ``late`` (works on streams and tables)."""
    df = events.withWatermark(time_col, late) if events.isStreaming else events
    counted = df.groupBy(F.window(time_col, width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("day"), "event_type", "n", "total")
