"""Embedding backfill as a stateful stream: what fails waits in state and comes back by a timer.

Contents to embed arrive as a stream and are dealt over buckets.  Each bucket keeps the
contents that wait, how often they were tried, and why its provider stopped.  An answer
that may come out well later (:class:`~marklake.operators.sections.Retry`) leaves them
waiting and sets a timer, with doubling waits or after the time that the other side named;
any other error is final and stops the bucket until it is told to go on.  State lies in the
stream's checkpoint, so a restart goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.sections import Retry

BUCKETS = 8
FIRST, MOST = 5.0, 60.0  # seconds of the first and the longest wait
BATCH = 32
RESULT = "content_hash string, embed_model string, embedding array<float>, tries int, error string"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Embedder(StatefulProcessor):
    """One bucket's waiting contents; gives a row for each that got a vector, and one for a final error."""

    def __init__(self, embed: Callable[[list[str]], list[list[float]]], model: str, batch: int = BATCH, first: float = FIRST, most: float = MOST):
        self.embed, self.model, self.batch, self.first, self.most = embed, model, batch, first, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "content_hash string", "text string, tries int")
        self.stopped = handle.getValueState("stopped", "error string")
        self.due = handle.getValueState("due", "at long")

    def _work(self, now: int) -> Iterator[pd.DataFrame]:
        if self.stopped.exists() or (self.due.exists() and now < self.due.get()[0]):
            return
        self.due.clear()
        items = sorted((k[0], v[0], v[1]) for k, v in self.waiting.iterator())
        rows = []
        for i in range(0, len(items), self.batch):
            part = items[i : i + self.batch]
            tries = max(t for _, _, t in part) + 1
            try:
                vectors = self.embed([text for _, text, _ in part])
                if len(vectors) != len(part):
                    raise ValueError(f"{len(vectors)} vectors for {len(part)} texts")
            except Retry as e:
                for key, text, t in part:
                    self.waiting.updateValue((key,), (text, t + 1))
                wait = e.after if e.after is not None else min(self.most, self.first * 2.0 ** (tries - 1))
                self.due.update((now + int(1000 * wait),))
                self.handle.registerTimer(now + int(1000 * wait))
                break
            except Exception as e:
                self.stopped.update((str(e),))
                rows.append((part[0][0], self.model, None, tries, str(e)))
                break
            for (key, _, t), vector in zip(part, vectors):
                self.waiting.removeKey((key,))
                rows.append((key, self.model, [float(x) for x in vector], t + 1, None))
        if rows:
            yield pd.DataFrame(rows, columns=["content_hash", "embed_model", "embedding", "tries", "error"]).astype({"tries": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                if r.content_hash is None:  # a beat
                    continue
                if not r.content_hash:  # a word to go on
                    self.stopped.clear()
                    self.due.clear()
                elif not self.waiting.containsKey((r.content_hash,)):
                    self.waiting.updateValue((r.content_hash,), (r.text, 0))
        yield from self._work(timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._work(timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def vectors(stream: DataFrame, embed: Callable[[list[str]], list[list[float]]], model: str, *, buckets: int = BUCKETS, **options) -> DataFrame:
    """A stream of :data:`RESULT` for a stream of contents ``(content_hash, text)``.

    A content that is waiting already isn't taken twice.  A row with an empty hash goes to
    every bucket and lets a stopped one go on; one without a hash only wakes it.
    """
    place = F.pmod(F.xxhash64("content_hash"), F.lit(buckets)).cast("int")
    every = F.sequence(F.lit(0), F.lit(buckets - 1))
    dealt = stream.select("content_hash", "text", F.explode(F.when(F.coalesce("content_hash", F.lit("")) == "", every).otherwise(F.array(place))).alias("bucket"))
    return dealt.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Embedder(embed, model, **options), outputStructType=RESULT, outputMode="Append", timeMode="ProcessingTime")


def start(spark: SparkSession, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, embed: Callable, model: str, *, trigger: dict | None = None, **options):
    """A running backfill; ``sink(rows, turn)`` writes each batch's results.

    A stream without new rows runs no batch after a restart, so timers alone would not wake
    what waits in its state: a beat a second does.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    nothing = F.lit(None).cast("string")
    beats = spark.readStream.format("rate").option("rowsPerSecond", 1).load().select(nothing.alias("content_hash"), nothing.alias("text"))
    return vectors(stream.select("content_hash", "text").unionByName(beats), embed, model, **options).writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 second"})).start()
