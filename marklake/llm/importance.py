"""Importance resampling: documents drawn by how much likelier a target corpus makes their features.

Features are runs of words, hashed into buckets.  The gain of a bucket is the logarithm
of its share in the target over its share in the corpus; a document's weight is the sum
of its features' gains.  Weight plus Gumbel noise of the document's own, the highest
ones drawn, is a draw without replacement in proportion to the weights' exponentials.

Equal texts are collapsed first, by grouping the full text.  A text's features are made
once and written as bucket numbers; corpus counts are those of the text times its
copies; the weight is computed once and joined back by a digest, where the noise, which
follows the document's id, is added.

Ranks come from ranges of the order (score, id): every range is ranked by itself, and
the ranges before it add how many rows they hold.

Defined results: a null text has no words, no features and weight 0; a row without an
id draws its noise as an empty id would and ranks after the rows of its score that have
one; equal rows rank next to each other; an empty table gives an empty result, an empty
target counts as one without features; other columns pass through unless they bear the
names of the new ones (those are replaced).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import LOWER, rows_of, slices, word_bounds
from ._components import join_hot
from ._store import Workspace

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = "2024"
NEW = ["n_features", "weight", "score", "rank"]
RANGE_ROWS = 1_000_000  # rows that one task ranks

_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[:0x80] = True
for _a, _z in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A)):
    _SEPARATOR[_a : _z + 1] = False
_LONG = 64  # bytes of a word beyond which it is hashed by itself


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_CRC = _crc_table()


def crc32_of(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of the bytes of every span, byte by byte over all spans at once."""
    length = end - start
    order = np.argsort(-length, kind="stable")
    begin, size = start[order], length[order]
    out = np.full(len(start), 0xFFFFFFFF, np.uint32)
    alone = int(np.searchsorted(-size, -_LONG, "left"))
    begin_, part = begin[alone:], out[alone:]
    left = np.searchsorted(-size[alone:], -np.arange(1, _LONG + 1), "right")
    for i, m in enumerate(left.tolist()):
        if not m:
            break
        part[:m] = _CRC[(part[:m] ^ data[begin_[:m] + i]) & 0xFF] ^ (part[:m] >> np.uint32(8))
    part ^= np.uint32(0xFFFFFFFF)
    for i in range(alone):
        out[i] = zlib.crc32(data[begin[i] : begin[i] + size[i]])
    back = np.empty_like(out)
    back[order] = out
    return back


def features(data: np.ndarray, at: np.ndarray, longest: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(bucket of every feature, offsets of rows, words of every row)``: all runs of 1 to ``longest`` words, joined by one space."""
    low = LOWER[data]
    start, end = word_bounds(low, at, _SEPARATOR)
    row = np.searchsorted(at, start, "right") - 1
    n_words = np.bincount(row, minlength=len(at) - 1)
    # the words of all rows with one space between them: a run of words is one span
    length = end - start
    place = np.concatenate(([0], np.cumsum(length + 1)))[:-1]
    flat = np.full(int((length + 1).sum()), 32, np.uint8)
    inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    flat[np.repeat(place, length) + inside] = low[np.repeat(start, length) + inside]
    found, rows = [], []
    for k in range(1, longest + 1):
        if len(start) < k:
            break
        whole = row[k - 1 :] == row[: len(row) - k + 1]
        a, b = place[: len(place) - k + 1][whole], (place + length)[k - 1 :][whole]
        found.append(crc32_of(flat, a, b) % np.uint32(buckets))
        rows.append(row[: len(row) - k + 1][whole])
    if not found:
        return np.zeros(0, np.uint32), np.zeros(len(at), np.int64), n_words
    found, rows = np.concatenate(found), np.concatenate(rows)
    order = np.argsort(rows, kind="stable")
    return found[order], np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=len(at) - 1)))), n_words


def collapse(ws: Workspace, name: str, docs: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """``digest, copies, n_features, n_words, buckets`` of every distinct text, written."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = docs.select(text.alias("text")).groupBy("text").agg(F.count("*").alias("copies")).select("text", "copies", digest("text").alias("digest"))
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def work(batches):
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                found, offsets, n_words = features(data, at, longest, buckets)
                raw = found.astype(kind).tobytes()
                size = np.dtype(kind).itemsize
                cells = [raw[a * size : b * size] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part.column(2), part.column(1), pa.array(np.diff(offsets)), pa.array(n_words.astype(np.int64)), pa.array(cells, pa.binary())], ["digest", "copies", "n_features", "n_words", "buckets"])

    return ws.save(groups.mapInArrow(work, "digest binary, copies long, n_features long, n_words long, buckets binary"), name)


def digest(text_col: str):
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")).cast("binary"), 256))


def _cells(batch: pa.RecordBatch, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32
    column = batch.column(batch.schema.get_field_index("buckets"))
    sizes = batch.column(batch.schema.get_field_index("n_features")).to_numpy()
    flat = np.frombuffer(b"".join(column.to_pylist()), kind)
    return flat, np.concatenate(([0], np.cumsum(sizes)))


def bucket_sums(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features of each bucket, copies counted; every task sends one row a bucket."""
    def work(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            flat, at = _cells(batch, buckets)
            copies = batch.column(batch.schema.get_field_index("copies")).to_numpy()
            alone = copies == 1
            rows = rows_of(at)
            total += np.bincount(flat[alone[rows]], minlength=buckets)
            for i in np.flatnonzero(~alone).tolist():
                total += np.bincount(flat[at[i] : at[i + 1]], minlength=buckets) * copies[i]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    sums = texts.select("copies", "n_features", "buckets").mapInArrow(work, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in sums.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of the logarithm of every bucket's share in the target over that in the corpus, each count one up."""
    n = len(corpus)
    s_all, t_all = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log(float(t + 1) * s_all / (float(s + 1) * t_all))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def weigh(spark: SparkSession, texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """``digest, copies, n_features, n_words, weight`` of every distinct text."""
    table, buckets = spark.sparkContext.broadcast(gain), len(gain)

    def work(batches):
        for batch in batches:
            flat, at = _cells(batch, buckets)
            run = np.concatenate(([0], np.cumsum(table.value[flat])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(run[at[1:]] - run[at[:-1]])], ["digest", "copies", "n_features", "n_words", "weight"])

    return texts.mapInArrow(work, "digest binary, copies long, n_features long, n_words long, weight long")


def noise(id_col, seed: str):
    """Whole thousandths of Gumbel noise that an id draws."""
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(hexes, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    spark: SparkSession,
    docs: DataFrame,
    target: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    longest: int = 1,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: str = SEED,
) -> DataFrame:
    """``docs`` without their texts, with ``n_features``, ``weight``, ``score`` and ``rank``; rows that aren't drawn have no rank.

    Of the documents of at least ``min_words`` words ``percent`` of 100 are drawn.
    """
    ws = Workspace(spark, "resample")
    docs = docs.drop(*NEW)
    names = [c for c in docs.columns if c != text_col]
    rows = ws.save(docs.select(*names, digest(text_col).alias("_digest")), "rows")
    texts = collapse(ws, "texts", docs, text_col, longest, buckets)
    want = collapse(ws, "target", target, text_col, longest, buckets)
    gain = gains(bucket_sums(texts, buckets), bucket_sums(want, buckets))
    weights = ws.save(weigh(spark, texts, gain).withColumnsRenamed({"digest": "_digest", "copies": "_times", "n_words": "_n_words"}), "weights")
    for name in ("texts", "target"):
        ws.drop(name)
    total, eligible = weights.agg(F.sum("_times"), F.sum(F.when(F.col("_n_words") >= min_words, F.col("_times")))).first()
    draw = (eligible or 0) * percent // 100
    scored = join_hot(rows, weights, "_digest", "_times", total or 0)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col(id_col), seed)).withColumn("_fit", F.col("_n_words") >= min_words)
    order = [F.desc("_fit"), F.desc("score"), F.asc_nulls_last(id_col), F.asc("_digest"), F.asc("_even")]
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(total or 0) // RANGE_ROWS))
    # rows equal in all that orders them are told apart by chance, so that they may be dealt over several ranges
    ranged = scored.withColumn("_even", F.rand(7)).repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id())
    ranged = ws.save(ranged, "ranged")
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect()  # one row a range
    before, seen = {}, 0
    for r in sizes:
        before[r["_range"]] = seen
        seen += r["n"]
    offset = F.lit(0).cast("long")
    if before:
        listed = F.array(*[F.lit(before.get(i, 0)).cast("long") for i in range(max(before) + 1)])
        offset = F.element_at(listed, F.col("_range") + 1)
    place = offset + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranged.withColumn("_place", place)
    out = ranked.select(*names, "n_features", "weight", "score", F.when(F.col("_fit") & (F.col("_place") <= draw), F.col("_place")).cast("long").alias("rank"))
    return ws.settle(out)
