"""Near-duplicate texts: DartMinHash signatures, banded join, exact check, connected components.

A text is the multiset of its runs of five words (all its words, if fewer).  Darts
fall on the plane ``weight x rank`` of every element as a Poisson process that
depends on the element alone; the dart of least rank below the element weights in
each of ``k`` coordinates is the signature.  Two texts agree in a coordinate with
a probability equal to their weighted Jaccard similarity.  The number of darts to
generate does not grow with ``k`` times the length of the text, only with their sum.

Equal texts are merged first.  Texts that share a band of coordinates are
candidates.  Within a band a text is paired with one text of the band only, in large
bands with the most central one;
after those links are verified, bands whose texts still lie in several components
are searched again, this time for every pair across components whose signatures
could belong to similar texts.  So no group is expanded into all its pairs and no
link between components is lost.

Defined results: a null or blank text is a class of its own with every other such
text only if they are byte-equal (null equals null); an empty table gives an empty
result; repeated rows fall into one class; a null id gets a row, and the smallest
id that is not null names the class; different texts under one id are searched each
for itself, and if they are of one class named by that id, one of them is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytes import column_bytes, cut_groups, mix64, rows_of, slices, words
from ._components import components, join_hot
from ._store import Workspace

SHINGLE = 5
SIMILARITY = 0.8
BANDS, PER_BAND = 16, 4
K = BANDS * PER_BAND
FIRST_SLAB = -4  # ranks below 2**-4 are one slab; later slabs double
TILE = 1000  # texts of a band that one task compares with another such tile
SLACK = 0.2  # estimated similarities may fall so far below the exact one (4 standard deviations)
CROWD = 4  # groups with more candidate pairs than so many times their texts are checked on the spot
SMALL = 8  # bands of fewer texts are tied to their first text
SLOTS = 1 << 20  # slots of the set that sifts texts before they are shuffled; its size does not depend on the data

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_KEYS = mix64(np.arange(1, 65, dtype=np.uint64) * _GOLD)


def shingles(data: np.ndarray, at: np.ndarray, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of ``n`` words of every row, and their row offsets."""
    h, off, _ = words(data, at)
    count = np.diff(off)
    short = (count > 0) & (count < n)
    total = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        total = mix64(total * _GOLD + h[j : j + len(total)]) if len(total) else total
    row = rows_of(off)
    inside = row[: len(total)] == row[n - 1 :] if len(total) else np.zeros(0, bool)
    out, rows = total[inside], row[: len(total)][inside]
    if short.any():
        extra_row = np.flatnonzero(short)
        extra = mix64(np.array([np.bitwise_xor.reduce(mix64(h[off[i] : off[i + 1]] + np.arange(count[i], dtype=np.uint64) * _GOLD)) for i in extra_row], np.uint64))
        out, rows = np.concatenate((out, extra)), np.concatenate((rows, extra_row))
        order = np.argsort(rows, kind="stable")
        out, rows = out[order], rows[order]
    return out, np.searchsorted(rows, np.arange(len(at)))


def _poisson_table(area: float) -> np.ndarray:
    out, p, c, i = [], np.exp(-area), 0.0, 0
    while c < 1 - 1e-15 and i < area + 60 * max(1.0, area**0.5):
        c += p
        out.append(c)
        i += 1
        p *= area / i
    return np.array(out)


def signatures(elements: np.ndarray, at: np.ndarray, k: int = K) -> np.ndarray:
    """DartMinHash of every row: ``k`` 64-bit darts; rows without elements are all zero.

    Element weights are counts, so the plane is cut into cells of weight 1: an
    element that occurs ``w`` times owns the cells 0 to w - 1.
    """
    n = len(at) - 1
    rows = rows_of(at).astype(np.uint64)
    # occurrences of one element in one row become the cells 0, 1, 2, ...
    order = np.lexsort((elements, rows))
    x, r = elements[order], rows[order].astype(np.int64)
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (r[1:] != r[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(x)), 0))
    cell = (np.arange(len(x)) - first).astype(np.uint64)
    seed = mix64(x + mix64(cell * _GOLD + np.uint64(7)))
    size = np.diff(at)
    darts = k * np.log(k) + 2 * k
    top = np.ceil(np.log2(darts / np.maximum(size, 1))).astype(np.int64)
    top = np.maximum(top, FIRST_SLAB)
    best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    value = np.zeros(n * k, np.uint64)
    done = np.full(n, FIRST_SLAB - 1)
    wait = size > 0
    slab = FIRST_SLAB
    while wait.any():
        use = wait[r] & (done[r] == slab - 1)
        s, rr = seed[use], r[use]
        low, width = (0.0, 2.0**slab) if slab == FIRST_SLAB else (2.0 ** (slab - 1), 2.0 ** (slab - 1))
        u = mix64(s ^ _KEYS[slab - FIRST_SLAB])
        number = np.searchsorted(_poisson_table(width), (u >> np.uint64(11)).astype(np.float64) * 2.0**-53, side="right")
        hit = np.flatnonzero(number)
        many = number[hit]
        which = np.repeat(hit, many)
        nth = (np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)).astype(np.uint64)
        dart = mix64(u[which] + (nth + np.uint64(1)) * _GOLD)
        rank = low + width * ((mix64(dart ^ _KEYS[40]) >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        place = rr[which] * k + (mix64(dart ^ _KEYS[41]) % np.uint64(k)).astype(np.int64)
        bits = rank.view(np.uint64)  # non-negative doubles sort like their bits
        np.minimum.at(best, place, bits)
        won = bits == best[place]
        value[place[won]] = dart[won]
        done[wait & (done == slab - 1)] = slab
        full = (best.reshape(n, k) != np.iinfo(np.uint64).max).all(axis=1)
        wait &= ~((slab >= top) & full)
        slab += 1
    return value.reshape(n, k)


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Similarity of two sorted multisets of hashes."""
    if not len(a) or not len(b):
        return 0.0
    (ua, ca), (ub, cb) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[i], cb[j]).sum())
    return both / (len(a) + len(b) - both)


def _digest(text):
    """20 bytes that name a text; null has a name of its own."""
    return F.coalesce(F.unhex(F.sha1(text.cast("binary"))), F.lit(b""))


def _sign(docs: DataFrame) -> DataFrame:
    """``(id, digest, n, sig)``; sig holds the low 16 bits of every dart."""
    kind = dict(docs.dtypes)["id"]

    def work(batches):
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                e, off = shingles(data, at)
                low = (signatures(e, off) & np.uint64(0xFFFF)).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(off).astype(np.int64)), pa.array([x.tobytes() for x in low], pa.binary())], ["id", "digest", "n", "sig"])

    return docs.select("id", _digest(F.col("text")).alias("digest"), "text").mapInArrow(work, f"id {kind}, digest binary, n long, sig binary")


def band_keys(sig) -> list:
    """One key for each band of ``PER_BAND`` coordinates."""
    size = 2 * PER_BAND
    return [F.xxhash64(F.lit(b), F.substring(sig, 1 + size * b, size)) for b in range(BANDS)]


def _heads(members: DataFrame) -> DataFrame:
    """Pairs that tie the texts of a large band to its most central text.

    ``members`` is ``(key, head, id, sig, tile)``.  In each tile the text whose
    signature agrees best with the most frequent darts takes all others; the tiles'
    central texts are tied to the band's first text.
    """
    kind = dict(members.dtypes)["id"]
    rows = members.select(F.xxhash64("key", "tile").alias("g"), "id", "head", "sig").repartition("g").sortWithinPartitions("g", "id")

    def work(batches):
        for t, first, count in cut_groups(batches, "g"):
            ids, head = t.column("id").to_numpy(), t.column("head").to_numpy()
            sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(ids), K)
            a, b = [], []
            for i, n in zip(first.tolist(), count.tolist()):
                own = sig[i : i + n]
                votes = np.zeros(n)
                for j in range(K):
                    _, inverse, often = np.unique(own[:, j], return_inverse=True, return_counts=True)
                    votes += often[inverse]
                center = ids[i + int(votes.argmax())]
                a.append(np.append(np.full(n, center), head[i]))
                b.append(np.append(ids[i : i + n], center))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), t.schema.field("id").type), pa.array(np.concatenate(b), t.schema.field("id").type)], ["a", "b"])

    return rows.mapInArrow(work, f"a {kind}, b {kind}")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs ``(a, b)`` whose texts are at least ``threshold`` similar.

    Each side's texts are joined by id: a text that many pairs name is a hot key
    of a plain inner join, which Spark splits at run time.
    """
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def work(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            sims, n = [], batch.num_rows
            i = 0
            while i < n:
                j = min(n, i + 256)
                part = batch.slice(i, j - i)
                sets = []
                for name in ("ta", "tb"):
                    own: list[np.ndarray] = []
                    for _, data, at in slices(part, name):
                        e, off = shingles(data, at)
                        own += [e[off[q] : off[q + 1]] for q in range(len(off) - 1)]
                    sets.append(own)
                sims += [weighted_jaccard(x, y) for x, y in zip(*sets, strict=True)]
                i = j
            ok = pa.array(np.array(sims) >= threshold)
            yield pa.RecordBatch.from_arrays([a.filter(ok), b.filter(ok)], ["a", "b"])
    kinds = dict(both.dtypes)
    return both.mapInArrow(work, f"a {kinds['a']}, b {kinds['b']}")


def _spread(members: DataFrame) -> DataFrame:
    """``members (key, band, id, comp, n, sig, tile, tiles)`` once for every pair of tiles that they are in.

    A band of many texts is cut into tiles; each pair of tiles is one group ``g``, so a
    task never needs more than two tiles at once.
    """
    rows = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    g = F.xxhash64("key", F.least("tile", "other"), F.greatest("tile", "other"))
    return rows.select(g.alias("g"), "band", "id", "comp", "n", "sig", (F.col("tile") > F.col("other")).alias("late"), (F.col("tile") != F.col("other")).alias("two"))


def _columns(t: pa.Table, at: slice) -> list[np.ndarray]:
    part = t.slice(at.start, at.stop - at.start)
    sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), np.uint16).reshape(-1, K)
    return [*(part.column(c).to_numpy() for c in ("id", "comp", "n", "late", "two", "band")), sig]


def _candidates(ids, comp, n, late, two, band, sig, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different components that may be similar: by size, by signature, and met in no earlier band."""
    a, b = [], []
    for i in range(len(ids)):
        j = np.flatnonzero((comp != comp[i]) & (late > late[i] if two[i] else ids > ids[i]) & (n >= similarity * n[i]) & (similarity * n <= n[i]))
        if not len(j):
            continue
        same = sig[j] == sig[i]
        ok = same.mean(axis=1) >= similarity - SLACK
        if band[i]:
            ok &= ~same[:, : band[i] * PER_BAND].reshape(len(j), band[i], PER_BAND).all(axis=2).any(axis=1)
        j = j[ok]
        a.append(np.full(len(j), i))
        b.append(j)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def _across(spread: DataFrame, similarity: float) -> DataFrame:
    """``(g, a, b)``: candidate pairs across components; a group with many of them gives one row ``(g, null, null)``."""
    kind = dict(spread.dtypes)["id"]
    rows = spread.repartition("g").sortWithinPartitions("g", "id")

    def work(batches):
        for t, first, count in cut_groups(batches, "g"):
            key, kind_of = t.column("g").to_numpy(), t.schema.field("id").type
            g, a, b = [], [], []
            for i, size in zip(first.tolist(), count.tolist()):
                own = _columns(t, slice(i, i + size))
                x, y = _candidates(*own, similarity)
                if len(x) > CROWD * size:
                    g.append(key[i])
                    a.append(None)
                    b.append(None)
                elif len(x):
                    g += [key[i]] * len(x)
                    a += np.minimum(own[0][x], own[0][y]).tolist()
                    b += np.maximum(own[0][x], own[0][y]).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(a, kind_of), pa.array(b, kind_of)], ["g", "a", "b"])

    return rows.mapInArrow(work, f"g long, a {kind}, b {kind}")


def overlaps(elements: np.ndarray, at: np.ndarray, block: int = 4096) -> np.ndarray:
    """Sizes of the multiset intersections of all pairs of rows."""
    n = len(at) - 1
    row = rows_of(at)
    order = np.lexsort((elements, row))
    e, r = elements[order], row[order]
    new = np.ones(len(e), bool)
    new[1:] = (e[1:] != e[:-1]) | (r[1:] != r[:-1])
    nth = np.arange(len(e)) - np.maximum.accumulate(np.where(new, np.arange(len(e)), 0))
    _, column, often = np.unique(mix64(e + nth.astype(np.uint64) * _GOLD), return_inverse=True, return_counts=True)
    shared = often[column] > 1
    column, r = column[shared], r[shared]
    out = np.zeros((n, n), np.float32)
    order = np.argsort(column, kind="stable")
    column, r = column[order], r[order]
    _, column = np.unique(column, return_inverse=True)
    for i in range(0, int(column[-1]) + 1 if len(column) else 0, block):
        lo, hi = np.searchsorted(column, (i, i + block))
        m = np.zeros((n, block), np.float32)
        m[r[lo:hi], column[lo:hi] - i] = 1
        out += m @ m.T
    return out


def _crowded(spread: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """Links ``(a, b)`` of crowded groups, checked exactly where the group's texts stand together: only links leave the task."""
    kind = dict(spread.dtypes)["id"]
    rows = spread.join(texts, "id").repartition("g").sortWithinPartitions("g", "id")

    def work(batches):
        for t, first, count in cut_groups(batches, "g"):
            for i, size in zip(first.tolist(), count.tolist()):
                own = _columns(t, slice(i, i + size))
                x, y = _candidates(*own, similarity)
                data, at = column_bytes(t.column("text").slice(i, size))
                e, off = shingles(data, at)
                both = overlaps(e, off)[x, y]
                n = np.diff(off)
                ok = both / (n[x] + n[y] - both) >= similarity
                a, b, kind_of = own[0][x[ok]], own[0][y[ok]], t.schema.field("id").type
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b), kind_of), pa.array(np.maximum(a, b), kind_of)], ["a", "b"])

    return rows.mapInArrow(work, f"a {kind}, b {kind}")


def classes(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``class_id``, ``text_id`` (smallest id with the same text), ``kept``."""
    return _classes(spark, docs, text_col, id_col, similarity).drop("digest")


def _classes(spark: SparkSession, docs: DataFrame, text_col: str, id_col: str, similarity: float) -> DataFrame:
    ws = Workspace(spark, "near")
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = ws.save(_sign(base), "signed")
    # one row, with a number of its own, for every different text
    texts_of = signed.groupBy("digest").agg(F.min("id").alias("text_id"), F.min(F.struct("n", "sig")).alias("u"), F.count("*").alias("times"))
    texts_of = ws.save(texts_of.select("digest", "text_id", "u.*", "times", F.monotonically_increasing_id().alias("node")), "texts_of")
    unique = texts_of.where("n > 0").select(F.col("node").alias("id"), "sig", "n")
    banded = unique.select("id", F.posexplode(F.array(*band_keys(F.col("sig")))).alias("band", "key"))
    groups = banded.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("size")).where("size > 1")
    # only texts that share a band go on; their signatures are fetched again where they are needed
    total = BANDS * unique.count()
    shared = ws.save(join_hot(banded, groups.withColumn("times", F.col("size")), "key", "times", total), "shared")
    tile_of = F.pmod(F.xxhash64("id"), F.ceil(F.col("size") / TILE).cast("int")).cast("int")
    small = shared.where(F.col("size") < SMALL).select(F.col("head").alias("a"), F.col("id").alias("b"))
    large = shared.where(F.col("size") >= SMALL).join(unique, "id").select("key", "head", "id", "sig", tile_of.alias("tile"))
    star = small.unionAll(_heads(large)).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    star = ws.save(star, "star")
    involved = star.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS)).cast("int")
    involved = ws.save(texts_of.select(F.col("node").alias("id"), "digest").join(involved, "id", "left_semi"), "involved")
    slots = involved.select(slot("digest").alias("slot")).distinct()  # at most SLOTS rows
    sifted = base.select(_digest(F.col("text")).alias("digest"), "text").join(F.broadcast(slots), slot("digest") == F.col("slot"), "left_semi")
    texts = ws.save(sifted.groupBy("digest").agg(F.min("text").alias("text")).join(involved, "digest").select("id", "text"), "texts")
    links = ws.save(_verify(star, texts, similarity), "links")
    comp = ws.save(components(ws, links, "first"), "comp")

    # second search: bands that still hold several components
    named = shared.join(comp, "id", "left").select("key", "band", "id", "size", F.coalesce("component", "id").alias("comp"))
    named = ws.save(named, "named")
    mixed = named.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    members = named.join(mixed, "key", "left_semi").join(unique, "id")
    spread = _spread(members.withColumn("tiles", tiles).withColumn("tile", tile_of))
    found = ws.save(_across(spread, similarity), "found")
    more = found.where("a IS NOT NULL").select("a", "b").distinct().join(star, ["a", "b"], "left_anti")
    extra = _verify(more, texts, similarity)
    crowds = ws.save(found.where("a IS NULL").select("g").distinct(), "crowds")
    if not crowds.isEmpty():
        extra = extra.unionAll(_crowded(spread.join(crowds, "g", "left_semi"), texts, similarity))
    extra = ws.save(extra.distinct(), "extra")
    if not extra.isEmpty():
        comp = ws.save(components(ws, links.unionAll(extra), "second"), "comp2")

    # the smallest id, and of its texts the one of the smallest digest, name and stand for the class
    linked = texts_of.select("digest", "text_id", "times", "node").join(comp.select(F.col("id").alias("node"), "component"), "node", "left")
    heads = linked.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct(F.col("text_id").isNull().alias("none"), "text_id", "digest")).alias("head"))
    labels = linked.join(heads, "component", "left").select("digest", "text_id", "times", F.coalesce("head.text_id", "text_id").alias("class_id"), F.coalesce("head.digest", "digest").alias("stands"))
    rows = texts_of.agg(F.sum("times")).first()[0] or 0
    out = join_hot(signed.select("id", "digest"), labels, "digest", "times", rows)
    kept = F.coalesce((F.col("id") == F.col("class_id")) & (F.col("digest") == F.col("stands")), F.lit(False))
    return ws.settle(out.select(F.col("id").alias(id_col), "class_id", "text_id", kept.alias("kept"), "digest"))


def deduplicate(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id; of rows equal in id and text, the least by the hash of all columns.

    A row without an id is named by its text and comes after all rows with one, so
    its class keeps a row all the same.
    """
    far = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 2) + F.lit(1 << 62)
    stand_in = F.concat(F.lit("\U0010ffff"), far.cast("string")) if dict(docs.dtypes)[id_col] == "string" else far
    named = docs.withColumn("_near_id", F.coalesce(F.col(id_col), stand_in))
    found = _classes(spark, named, text_col, "_near_id", similarity)
    keep = found.where("kept").select(F.col("_near_id").alias("_keep"), F.col("digest").alias("_text")).distinct()
    named = named.withColumn("_near_text", _digest(F.col(text_col)))
    kept = named.join(keep, (F.col("_near_id") == F.col("_keep")) & (F.col("_near_text") == F.col("_text")), "left_semi")
    nth = F.row_number().over(Window.partitionBy("_near_id", "_near_text").orderBy(F.xxhash64(*[F.col(c).cast("string") for c, k in docs.dtypes])))
    return kept.withColumn("_nth", nth).where("_nth = 1").drop("_nth", "_near_id", "_near_text")
