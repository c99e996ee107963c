"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Text and benchmark items are folded to lower-case letters and digits with single
spaces.  An item of ``m`` bytes may occur with ``e = floor(rate * m)`` edits; such an
occurrence shares at least ``m + 1 - q - q * e`` of its q-grams with the text, on
diagonals that lie at most ``e`` apart.  So shared q-grams are counted in bands of
``2 * (e + 1)`` diagonals that overlap by half, bands that reach the bound are kept, and
an alignment inside the band gives the number of edits and the place.

All q-grams of a whole text are looked up.  The index over the items travels with
the tasks only in parts of at most ``index_bytes`` of item text; a larger benchmark is
searched part by part.

An item shorter than ``q`` bytes after folding occurs where it stands, unchanged, as
whole words of the text; one hash lookup for each such length finds it.

Defined results: null or empty texts and items match nothing, as do items without a
letter or digit; item ids may be of any type; an item that occurs several times gives several
rows; repeated rows of either table give repeated matches; empty tables give empty
results; columns of other names are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._bytes import column_bytes, runs, slices

Q = 8  # a q-gram fills one 64-bit word, so equal codes are equal q-grams
RATE = 0.05
INDEX_BYTES = 4 << 20  # the index takes some 20 bytes for each
_BITS = 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_NO_ORIGIN = 1 << 20

_FOLD = np.full(256, 32, np.uint8)
_FOLD[48:58] = np.arange(48, 58)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def fold(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded bytes, their row offsets, and the place of each in ``data``."""
    f = _FOLD[data]
    keep = np.ones(len(f), bool)
    if len(f):
        blank = f == 32
        keep[1:] = ~(blank[1:] & blank[:-1])
        starts = at[:-1][at[:-1] < len(f)]
        keep[starts] = ~blank[starts]  # no blank at the start of a row
    kept = np.flatnonzero(keep)
    return f[kept], np.searchsorted(kept, at), kept


def gram_codes(f: np.ndarray, q: int = Q) -> np.ndarray:
    """The code of the q-gram that starts at each byte."""
    n = len(f) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = f[:n].astype(np.uint64)
    for j in range(1, q):
        out |= f[j : j + n].astype(np.uint64) << np.uint64(8 * j)
    return out


class Index:
    """q-grams of the items of one part of the benchmark."""

    def __init__(self, ids: list, texts: list, rate: float):
        f, at, _ = fold(*column_bytes(pa.array([t or "" for t in texts], pa.string())))
        ends = at[1:].copy()
        for i in range(len(ids)):
            if ends[i] > at[i] and f[ends[i] - 1] == 32:
                ends[i] -= 1
        self.ids, self.f, self.start, self.size = ids, f, at[:-1], ends - at[:-1]
        self.budget = np.floor(self.size * rate).astype(np.int64)
        self.bound = np.maximum(self.size + 1 - Q - Q * self.budget, 1)
        codes, item, place = [], [], []
        for i in np.flatnonzero(self.size >= Q):
            c = gram_codes(f[self.start[i] : self.start[i] + self.size[i]])
            codes.append(c)
            item.append(np.full(len(c), i, np.int32))
            place.append(np.arange(len(c), dtype=np.int32))
        code = np.concatenate(codes) if codes else np.zeros(0, np.uint64)
        order = np.argsort(code, kind="stable")
        self.item = np.concatenate(item)[order] if codes else np.zeros(0, np.int32)
        self.place = np.concatenate(place)[order] if codes else np.zeros(0, np.int32)
        code = code[order]
        self.first, self.count = (x.astype(np.int32) for x in runs(code))
        self.code = code[self.first]
        self.mask = np.zeros(1 << _BITS, bool)
        self.mask[self._slot(self.code)] = True
        # short items by length: sorted codes and their items
        self.short = {}
        for size in range(1, Q):
            own = np.flatnonzero(self.size == size)
            if len(own):
                own_codes = np.array([int.from_bytes(f[self.start[i] : self.start[i] + size].tobytes(), "little") for i in own], np.uint64)
                by_code = np.argsort(own_codes, kind="stable")
                self.short[size] = own_codes[by_code], own[by_code]

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return ((codes * _SPREAD) >> np.uint64(64 - _BITS)).astype(np.int64)

    def matches(self, data: np.ndarray, at: np.ndarray):
        """Arrays ``row, item, start, end, edits, shared``: byte places in the row's text."""
        f, off, kept = fold(data, at)
        found = [self._long(f, off, kept), *(self._whole(f, off, kept, size) for size in self.short)]
        return tuple(np.concatenate(x).astype(np.int64) for x in zip(*found, strict=True))

    def _whole(self, f: np.ndarray, off: np.ndarray, kept: np.ndarray, size: int):
        """Unchanged occurrences of the items of ``size`` bytes, as whole words."""
        codes, items = self.short[size]
        got = gram_codes(f, size)
        lo = np.searchsorted(codes, got, "left")
        pos = np.flatnonzero(codes[np.minimum(lo, len(codes) - 1)] == got)
        row = np.searchsorted(off, pos, side="right") - 1
        end = pos + size
        begins = (pos == off[row]) | (f[np.maximum(pos - 1, 0)] == 32)
        ends = (end == off[row + 1]) | ((end < off[row + 1]) & (f[np.minimum(end, len(f) - 1)] == 32))
        ok = (end <= off[row + 1]) & begins & ends
        pos, row = pos[ok], row[ok]
        many = np.searchsorted(codes, got[pos], "right") - lo[pos]
        which = np.repeat(np.arange(len(pos)), many)
        item = items[lo[pos][which] + np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many)]
        start = kept[pos[which]]
        return row[which], item, start, kept[pos[which] + size - 1] + 1, np.zeros(len(which)), np.zeros(len(which))

    def _long(self, f: np.ndarray, off: np.ndarray, kept: np.ndarray):
        """Occurrences of the items of at least ``q`` bytes, by shared q-grams."""
        none = tuple(np.zeros(0, np.int64) for _ in range(6))
        codes = gram_codes(f)
        if not len(codes) or not len(self.code):
            return none
        maybe = np.flatnonzero(self.mask[self._slot(codes)])
        found = np.searchsorted(self.code, codes[maybe])
        found[found == len(self.code)] = 0
        hit = self.code[found] == codes[maybe]
        pos, found = maybe[hit], found[hit]
        row = np.searchsorted(off, pos, side="right") - 1
        inside = pos + Q <= off[row + 1]
        pos, found, row = pos[inside], found[inside], row[inside]
        many = self.count[found]
        which = np.repeat(np.arange(len(pos)), many)
        post = np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + self.first[found][which]
        item = self.item[post]
        r = row[which]
        # a text with fewer hits of an item than its bound has no match
        pair = r * len(self.ids) + item
        order = np.argsort(pair, kind="stable")
        first, count = runs(pair[order])
        enough = np.repeat(count >= self.bound[item[order][first]], count) if len(first) else np.zeros(0, bool)
        sel = order[enough]
        if not len(sel):
            return none
        item, r, diagonal = item[sel], r[sel], pos[which[sel]] - self.place[post[sel]]
        width = self.budget[item] + 1
        band = diagonal // width
        band = np.concatenate((band, band - 1))
        item, r = np.concatenate((item, item)), np.concatenate((r, r))
        order = np.lexsort((band, item, r))
        band, item, r = band[order], item[order], r[order]
        new = np.ones(len(band), bool)
        new[1:] = (band[1:] != band[:-1]) | (item[1:] != item[:-1]) | (r[1:] != r[:-1])
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(band)))
        ok = count >= self.bound[item[first]]
        first, count = first[ok], count[ok]
        if not len(first):
            return none
        return self._verify(f, off, kept, r[first], item[first], band[first] * (self.budget[item[first]] + 1), count)

    def _verify(self, f, off, kept, row, item, diagonal, shared, block: int = 2048):
        out = [self._align(f, off, row[i : i + block], item[i : i + block], diagonal[i : i + block]) for i in range(0, len(row), block)]
        edits, start, end = (np.concatenate(x) for x in zip(*out, strict=True))
        ok = np.flatnonzero(edits <= self.budget[item])
        row, item, edits, start, end, shared = row[ok], item[ok], edits[ok], start[ok], end[ok], shared[ok]
        # both bands that cover an occurrence report it: one row for each start
        order = np.lexsort((edits, start, item, row))
        row, item, edits, start, end, shared = (x[order] for x in (row, item, edits, start, end, shared))
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (start[1:] >= end[:-1])
        row, item, edits, start, end, shared = (x[new] for x in (row, item, edits, start, end, shared))
        return row, item, kept[start], kept[end - 1] + 1, edits, shared

    def _align(self, f, off, row, item, diagonal):
        """Fewest edits of each item inside its band, and where it starts and ends in ``f``."""
        m, n = self.size[item], len(row)
        width = int(2 * (self.budget[item].max() + 1)) + 1
        lane = np.arange(width)
        usable = lane[None, :] <= 2 * (self.budget[item] + 1)[:, None]
        unit = _NO_ORIGIN
        big = np.int64(unit) * (1 << 20)
        # cost * unit + origin, so that the least cost wins and then the earliest start
        cost = np.where(usable, lane[None, :], big).astype(np.int64)
        begin, end = off[row], off[row + 1]
        result = np.full(n, big)
        stop = np.zeros(n, np.int64)
        for i in range(int(m.max())):
            at = diagonal[:, None] + lane[None, :] + i
            inside = (at >= begin[:, None]) & (at < end[:, None])
            text = f[np.clip(at, 0, len(f) - 1)]
            want = self.f[np.minimum(self.start[item] + i, len(self.f) - 1)][:, None]
            step = cost + np.where(inside & (text == want), 0, unit)
            drop = np.full_like(cost, big)
            drop[:, :-1] = cost[:, 1:] + unit
            step = np.minimum(step, drop)
            step = np.minimum.accumulate(step - lane * unit, axis=1) + lane * unit
            cost = np.where(usable, step, big)
            done = np.flatnonzero(m == i + 1)
            if len(done):
                best = cost[done].argmin(axis=1)
                result[done] = cost[done, best]
                stop[done] = diagonal[done] + best + i + 1
        edits, origin = result // unit, result % unit
        start = np.clip(diagonal + origin, begin, end - 1)
        return edits, start, np.clip(stop, start + 1, end)


def indexes(spark: SparkSession, benchmark: DataFrame, *, id_col: str, text_col: str, rate: float, index_bytes: int):
    """Broadcast indexes that together hold all items, each over at most about ``index_bytes`` of text."""
    items = benchmark.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total / index_bytes))
    for part in range(parts):
        some = items if parts == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(parts)) == part)
        rows = some.collect()
        yield spark.sparkContext.broadcast(Index([r["id"] for r in rows], [r["text"] for r in rows], rate))


def find(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """One row per occurrence: ``doc_id, item_id, start, end, edits, shared``; places count code points of the text."""
    kind, item_kind = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item_id]
    schema = f"doc_id {kind}, item_id {item_kind}, start long, end long, edits long, shared long"
    rows, out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), None
    for index in indexes(spark, benchmark, id_col=item_id, text_col=item_text, rate=rate, index_bytes=index_bytes):

        def work(batches, index=index):
            for batch in batches:
                for part, data, at in slices(batch, "text"):
                    row, item, start, end, edits, shared = index.value.matches(data, at)
                    if not len(row):
                        continue
                    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                    base = points[at[row]]
                    ids = pa.array([index.value.ids[i] for i in item.tolist()], batch_type)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), ids, *(pa.array(x) for x in (points[start] - base, points[end] - base, edits, shared))], ["doc_id", "item_id", "start", "end", "edits", "shared"])

        batch_type = to_arrow_type(benchmark.schema[item_id].dataType)
        found = rows.mapInArrow(work, schema)
        out = found if out is None else out.unionAll(found)
    return out


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` without the rows in which some item occurs."""
    schema = docs.schema
    for index in indexes(spark, benchmark, id_col=item_id, text_col=item_text, rate=rate, index_bytes=index_bytes):

        def work(batches, index=index):
            for batch in batches:
                for part, data, at in slices(batch, text_col):
                    keep = np.ones(part.num_rows, bool)
                    keep[index.value.matches(data, at)[0]] = False
                    yield part.filter(pa.array(keep))

        docs = docs.mapInArrow(work, schema)
    return docs
