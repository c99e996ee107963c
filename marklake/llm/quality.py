"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

A text becomes a vector of hashed counts: trigrams of character classes, words,
and how much its words and lines repeat.  The leading right singular vectors of
the labelled rows span the latent space.  Every text is compared with every
labelled row by cosine, in blocks, and the nearest ones vote with a weight that
rises with their similarity.

At most ``per_class`` labelled rows of each class are kept, those with the
smallest hash of their id; so what is broadcast is bounded by
``2 * per_class * rank`` numbers.  Votes are weighted back to the share that a
class has among all labelled rows.

All numbers of the latent space lie on binary grids so coarse that every product
and every sum of them is exact in doubles.  So equal texts have equal cosines, in
whatever batch, order or partition they are compared.

Defined results: a null text counts as empty and gets a score like any other;
labels that are null are ignored, of several labels of one id the smallest
counts, of several texts of one id the least is learned; without any labelled row
every score is 0.5; ties among neighbours go by their order of hash; repeated rows
get equal scores; an empty table gives an empty result; other columns pass through
unless they bear the names of the new ones (those are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import SPACE, mix64, rows_of, runs, slices, words
from .language_id import held_out

SHAPES, WORDS, STATS = 1024, 768, 256
DIM = SHAPES + WORDS + STATS
PER_CLASS = 2000
RANK = 64
NEIGHBOURS = 15
SHARPNESS = 12.0
CUT = 0.7
# binary places of features, axes and unit vectors: 2048 products of the first two, and 64 of the third with itself, fit in 53 bits
FEATURE_BITS, AXIS_BITS, UNIT_BITS = 14, 24, 20

_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[ord("a") : ord("z") + 1] = ord("a")
_CLASS[128:] = ord("a")
_CLASS[ord("A") : ord("Z") + 1] = ord("A")
_CLASS[ord("0") : ord("9") + 1] = ord("0")
_CLASS[[9, 13, 11, 12]] = 32
_FOLDS = np.zeros(256, bool)
_FOLDS[[ord("a"), ord("A"), ord("0"), 32]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _binned(out: np.ndarray, base: int, value: np.ndarray, weight: float) -> int:
    """Spread a share of 0 to 1 over 8 soft bins; returns the next free place."""
    x = np.clip(value, 0, 1) * 7
    low = np.minimum(x.astype(np.int64), 6)
    rows = np.arange(len(value))
    out[rows, base + low] += weight * (1 - (x - low))
    out[rows, base + low + 1] += weight * (x - low)
    return base + 8


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), np.float32(1e-9))


def _grid(x: np.ndarray, bits: int) -> np.ndarray:
    """The nearest multiples of ``2 ** -bits``, in doubles."""
    return np.rint(x.astype(np.float64) * 2.0**bits) * 2.0**-bits


def _distinct_share(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = len(at) - 1
    if not len(hashes):
        return np.ones(n)
    row = rows_of(at)
    key = np.sort(mix64(hashes + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) | (row.astype(np.uint64) << np.uint64(40)))
    first, _ = runs(key)
    seen = np.bincount((key[first] >> np.uint64(40)).astype(np.int64), minlength=n)
    return seen / np.maximum(np.diff(at), 1)


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of ``DIM`` numbers for every text."""
    n = len(at) - 1
    out = np.zeros((n, DIM), np.float32)
    cls = _CLASS[data]
    keep = np.ones(len(cls), bool)
    keep[1:] = (cls[1:] != cls[:-1]) | ~_FOLDS[cls[1:]]
    keep[at[:-1][at[:-1] < len(cls)]] = True
    kept = np.flatnonzero(keep)
    c = cls[kept].astype(np.uint64)
    ends = np.searchsorted(kept, at)
    row = rows_of(ends)
    if len(c) > 2:
        code = mix64((c[:-2] << np.uint64(16)) | (c[1:-1] << np.uint64(8)) | c[2:]) % np.uint64(SHAPES)
        inside = row[:-2] == row[2:]
        counts = np.bincount(row[:-2][inside] * SHAPES + code[inside].astype(np.int64), minlength=n * SHAPES).reshape(n, SHAPES)
        out[:, :SHAPES] = _unit(np.sqrt(counts).astype(np.float32))
    hashes, offsets, _ = words(data, at)
    n_words = np.diff(offsets)
    wrow = rows_of(offsets)
    if len(hashes):
        counts = np.bincount(wrow * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS)
        out[:, SHAPES : SHAPES + WORDS] = 0.4 * _unit(np.sqrt(counts).astype(np.float32))
    base = SHAPES + WORDS
    for back in (1, 2, 3):
        same = np.zeros(n)
        if len(hashes) > back:
            equal = (hashes[back:] == hashes[:-back]) & (wrow[back:] == wrow[:-back])
            same = np.bincount(wrow[back:][equal], minlength=n) / np.maximum(n_words, 1)
        base = _binned(out, base, same * 2, 0.5)
    base = _binned(out, base, _distinct_share(hashes, offsets), 0.4)
    lines, line_at, _ = words(data, at, _LINE)
    base = _binned(out, base, _distinct_share(lines, line_at), 0.5)
    base = _binned(out, base, np.log2(n_words + 1.0) / 16, 0.3)
    size = np.maximum(np.diff(at), 1)
    byte_row = rows_of(at)
    for mark, scale in ((SPACE, 3.0), (_CLASS == ord("A"), 2.0), (_CLASS == ord("0"), 4.0), (~np.isin(_CLASS, [ord("a"), ord("A"), ord("0"), 32, 10, ord("."), ord(",")]), 3.0)):
        share = np.bincount(byte_row[mark[data]], minlength=n) / size if len(data) else np.zeros(n)
        base = _binned(out, base, share * scale, 0.4)
    return out


class Model:
    """Latent space and labelled vectors; small enough to travel with the tasks."""

    def __init__(self, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, weights: np.ndarray):
        self.axes, self.vectors, self.labels, self.weights = axes, vectors, labels, weights

    def latent(self, x: np.ndarray) -> np.ndarray:
        return _grid(_unit(_grid(x, FEATURE_BITS) @ self.axes), UNIT_BITS)

    def score(self, x: np.ndarray, neighbours: int, block: int = 512) -> np.ndarray:
        out = np.full(len(x), 0.5)
        k = min(neighbours, len(self.labels))
        for i in range(0, len(x), block) if k else ():
            cos = self.latent(x[i : i + block]) @ self.vectors.T
            # whole numbers that order by cosine and then by place: of ties the first in order of hash is nearer
            order = -(cos * 2.0 ** (2 * UNIT_BITS)).astype(np.int64) * len(self.labels) + np.arange(len(self.labels))
            near = np.sort(np.argpartition(order, k - 1, axis=1)[:, :k], axis=1)
            weight = np.exp(SHARPNESS * (np.take_along_axis(cos, near, axis=1) - 1)) * self.weights[near]
            out[i : i + block] = (weight * self.labels[near]).sum(axis=1) / weight.sum(axis=1)
        return np.clip(out, 0, 1)


def leading_axes(x: np.ndarray, rank: int, turns: int = 8) -> np.ndarray:
    """Leading right singular vectors of ``x``, by subspace iteration: no square matrix of all columns is decomposed."""
    rank = min(rank, x.shape[1])
    rng = np.random.Generator(np.random.PCG64(64))
    q = rng.standard_normal((x.shape[1], min(x.shape[1], rank + 32))).astype(np.float32)
    for _ in range(turns):
        q = np.linalg.qr((x.T @ (x @ q)).astype(np.float64))[0].astype(np.float32)
    small = (x @ q).astype(np.float64)
    value, turn = np.linalg.eigh(small.T @ small)
    rank = max(1, min(rank, int((value > 1e-7 * value[-1]).sum())))  # directions in which no labelled row lies are left out
    return (q @ turn[:, ::-1][:, :rank]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, *, text_col: str, id_col: str, label_col: str, per_class: int = PER_CLASS, rank: int = RANK) -> Model:
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.min(label_col) > 0).cast("int").alias("_label"))
    totals = {r["_label"]: r["count"] for r in marks.groupBy("_label").count().collect()}
    order = [F.xxhash64(F.col("_id").cast("string")), F.col("_id")]
    chosen = marks.where("_label = 0").orderBy(*order).limit(per_class).unionAll(marks.where("_label = 1").orderBy(*order).limit(per_class))
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "_id")  # at most 2 * per_class ids
    rows = rows.groupBy("_id", "_label").agg(F.min("text").alias("text"))

    def work(batches):
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                x = features(data, at).astype(np.float16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "label", "x"])

    kind = dict(rows.dtypes)["_id"]
    got = rows.select("_id", "text", "_label").mapInArrow(work, f"id {kind}, label int, x binary").toPandas()
    got["h"] = [hash_of(i) for i in got["id"]]
    got = got.sort_values(["h", "id"], kind="stable")
    if not len(got):
        return Model(np.zeros((DIM, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0), np.zeros(0))
    y = got["label"].to_numpy().astype(np.float64)
    x = np.stack([np.frombuffer(b, np.float16) for b in got["x"]]).astype(np.float32)
    del got
    axes = _grid(leading_axes(x, rank), AXIS_BITS)
    share = np.array([totals.get(int(v), 1) for v in y], float) / np.array([(y == v).sum() for v in y], float)
    model = Model(axes, np.zeros((0, axes.shape[1])), y, share / share.mean())
    model.vectors = np.concatenate([model.latent(x[i : i + 512]) for i in range(0, len(x), 512)])
    return model


def hash_of(value) -> int:
    import zlib

    return zlib.crc32(str(value).encode())


def classify(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "quality",
    per_class: int = PER_CLASS,
    rank: int = RANK,
    neighbours: int = NEIGHBOURS,
    keep_text: bool = True,
    train_docs: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; labels of rows whose crc32(id) mod 4 is 2 are never learned from."""
    docs = docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out(F.col(id_col), 4))
    known = labels.where(~held_out(F.col(id_col), 4))
    model = spark.sparkContext.broadcast(fit(docs if train_docs is None else train_docs, known, text_col=text_col, id_col=id_col, label_col=label_col, per_class=per_class, rank=rank))
    names = [c for c in docs.columns if keep_text or c != text_col]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in names), "score double", "predicted int"])

    def work(batches):
        for batch in batches:
            for part, data, at in slices(batch, text_col):
                score = model.value.score(features(data, at), neighbours)
                kept = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= CUT).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(work, schema)
