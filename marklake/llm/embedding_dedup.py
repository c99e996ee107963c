"""Near-duplicate vectors: sign hashing in several tables, exact cosines, connected components.

Equal vectors are merged first and count with their number.  Each different vector
gets one key per table: the signs of its products with that table's random
hyperplanes.  Vectors that share a key in some table are compared by cosine in
double precision, block by block.  A pair that shares keys in several tables is
counted in the first of them, so a block reports how many links each vector has and
how its vectors hang together, and pairs are never written out.

The number of hyperplanes follows the logarithm of the number of vectors and the
number of tables follows from it, so that a pair at the threshold is found with a
probability of at least ``recall`` at every size.  A key that many vectors share is
cut into tiles, and each pair of tiles is a task's work of its own.  A vector travels
once for each table and tile, in its own type, and nothing with it: its keys are made
again from the vector where they are compared.

Defined results: rows whose vector is null, zero or holds a null or non-finite
component, and rows without an id, link with nothing; vectors of different length
never link; repeated rows are further vectors of the same id; an empty table gives
an empty result; further columns are not returned.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import cut_groups, mix64
from ._components import components, join_hot
from ._store import Workspace

THRESHOLD = 0.9
RECALL = 0.998
PER_KEY = 1024  # vectors that share a key on average if they lie at random; products cost less than sending a vector to more tables
TILE = 4096  # vectors of a key that one task compares with another such tile
BLOCK = 512  # rows of a tile whose products are held at once
SEED = 0xE3B


def plan_tables(n: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """``(bits, tables)`` for ``n`` vectors."""
    bits = min(62, max(6, math.ceil(math.log2(max(n, 2) / PER_KEY))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - agree)))


def table_keys(x: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """One key per row and table; the hyperplanes depend on the length of the vectors only."""
    rng = np.random.Generator(np.random.PCG64([SEED, x.shape[1]]))
    planes = rng.standard_normal((x.shape[1], bits * tables))
    sign = (x @ planes > 0).reshape(len(x), tables, bits)
    packed = (sign.astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(axis=2, dtype=np.uint64)
    salt = mix64(np.arange(tables, dtype=np.uint64) + np.uint64(x.shape[1] << 20))
    return mix64(packed ^ salt).view(np.int64)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # keeps norms of very large and very small vectors finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _pairs(x: np.ndarray, late: np.ndarray, two: bool, threshold: float):
    """Pairs ``a < b`` of rows with a cosine of at least ``threshold``: of two tiles across them, of one tile inside it."""
    if two:
        left, right = np.flatnonzero(~late), np.flatnonzero(late)
    else:
        left = right = np.arange(len(x))
    a, b = [], []
    for i in range(0, len(left), BLOCK):
        own = left[i : i + BLOCK]
        p, q = np.nonzero(x[own] @ x[right].T >= threshold)
        p, q = own[p], right[q]
        if not two:
            p, q = p[p < q], q[p < q]
        a.append(p)
        b.append(q)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def link(spark: SparkSession, vectors: DataFrame, *, vec_col: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``vectors``: ``id_col``, ``n_links``, ``component_id``, ``kept``."""
    ws = Workspace(spark, "vectors")
    real = vectors.schema[vec_col].dataType.elementType.typeName() == "float"
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if real else "array<double>").alias("v"))
    sane = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    v = v.withColumn("ok", F.coalesce(sane, F.lit(False)))
    v = v.withColumn("h1", F.when(F.col("ok"), F.xxhash64("v"))).withColumn("h2", F.when(F.col("ok"), F.xxhash64(F.lit(1), F.col("v"))))
    members = ws.save(v.select("id", "h1", "h2"), "members")
    distinct = ws.save(v.where("ok").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("m"), F.first("v").alias("v")), "distinct")
    n, rows_in = distinct.agg(F.count("*"), F.sum("m")).first()
    bits, tables = plan_tables(n, threshold, recall)
    kind = np.float32 if real else np.float64

    def sign(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                lists = part.column(2)
                dims = lists.value_lengths().to_numpy(zero_copy_only=False)
                flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(dims)))
                for dim in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == dim)
                    raw = flat[(off[at][:, None] + np.arange(dim)).ravel()].reshape(len(at), dim)
                    keys = table_keys(_unit(raw), bits, tables)
                    listed = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * tables), pa.array(keys.ravel()))
                    took = pa.array(at)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(took), part.column(1).take(took), pa.array([r.tobytes() for r in raw.astype(kind)], pa.binary()), listed], ["rep", "m", "x", "keys"])

    signed = ws.save(distinct.select("rep", "m", "v").mapInArrow(sign, "rep long, m long, x binary, keys array<long>"), "signed")
    keyed = signed.select("rep", F.posexplode("keys").alias("t", "key"))
    # keys are counted without the vectors; each row of crowded stands for more than TILE of a table
    crowded = ws.save(keyed.groupBy("t", "key").agg(F.count("*").alias("size")).where(F.col("size") > TILE), "crowded")
    rows = signed.select("rep", "m", "x", F.posexplode("keys").alias("t", "key"))
    rows = rows.join(crowded, ["t", "key"], "left").withColumn("tiles", F.coalesce(F.ceil(F.col("size") / TILE).cast("int"), F.lit(1)))
    rows = rows.withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    group = F.xxhash64("t", "key", F.least("tile", "other"), F.greatest("tile", "other"))
    rows = rows.select(group.alias("g"), "t", "rep", "m", "x", (F.col("tile") > F.col("other")).alias("late"), (F.col("tile") != F.col("other")).alias("two"))
    rows = rows.repartition("g").sortWithinPartitions("g")

    def compare(batches):
        for t, first, count in cut_groups(batches, "g"):
            rep, m, table = (t.column(c).to_numpy() for c in ("rep", "m", "t"))
            late, two = (t.column(c).to_numpy(zero_copy_only=False) for c in ("late", "two"))
            xs = t.column("x").combine_chunks()
            ids, links, roots = [], [], []
            for i, size in zip(first.tolist(), count.tolist()):
                at = slice(i, i + size)
                x = _unit(np.frombuffer(b"".join(xs.slice(i, size).to_pylist()), kind).reshape(size, -1))
                a, b = _pairs(x, late[at], two[i], threshold)
                if not len(a):
                    continue
                if table[i]:
                    # pairs that an earlier table finds are counted there
                    some, place = np.unique(np.concatenate((a, b)), return_inverse=True)
                    own = table_keys(x[some], bits, tables)[:, : table[i]]
                    p, q = place[: len(a)], place[len(a) :]
                    new = np.ones(len(a), bool)
                    for k in range(0, len(a), 1 << 16):
                        new[k : k + (1 << 16)] = ~(own[p[k : k + (1 << 16)]] == own[q[k : k + (1 << 16)]]).any(axis=1)
                    a, b = a[new], b[new]
                    if not len(a):
                        continue
                total = np.bincount(a, m[at][b], size) + np.bincount(b, m[at][a], size)
                root = rep[at].copy()
                while True:
                    low = root.copy()
                    np.minimum.at(low, a, root[b])
                    np.minimum.at(low, b, root[a])
                    if (low == root).all():
                        break
                    root = low
                some = np.flatnonzero(total)
                ids.append(rep[at][some])
                links.append(total[some].astype(np.int64))
                roots.append(root[some])
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(z)) for z in (ids, links, roots)], ["id", "links", "root"])

    found = ws.save(rows.mapInArrow(compare, "id long, links long, root long"), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    comp = components(ws, found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_rep = distinct.select("h1", "h2", F.col("rep").alias("id"), "m").join(counts, "id", "left").join(comp, "id", "left")
    per_rep = per_rep.select("h1", "h2", "m", (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    placed = join_hot(members.where("h1 IS NOT NULL"), per_rep, ["h1", "h2"], "m", rows_in or 0)
    out = placed.unionByName(members.where("h1 IS NULL"), allowMissingColumns=True)
    component = F.coalesce("component_id", "id")
    return ws.settle(out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")))
