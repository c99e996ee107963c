"""Whole text columns as numpy arrays: bytes, words and hashes without a Python loop per row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20  # texts are worked on in runs of about so many bytes; a longer text is a run of its own

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (the finaliser of splitmix64)."""
    x = np.atleast_1d(x)  # arrays wrap around silently
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and the ``n + 1`` offsets of its rows; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[at[0] : at[-1]], at - at[0]


def slices(batch: pa.RecordBatch, name: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of a batch, each with the bytes and offsets of its text column."""
    data, at = column_bytes(batch.column(batch.schema.get_field_index(name)))
    n, i = len(at) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE_BYTES, "right")) - 1)
        yield batch.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


LOWER = lower_table()
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_POWER_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _POWER_BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(4096)


def word_bounds(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every maximal run of non-separators; words never cross rows."""
    inside = ~separator[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = at[:-1]
    edges = edges[edges < len(data)]
    first[edges] = inside[edges]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    ends = at[1:] - 1
    ends = ends[ends >= 0]
    last[ends] = inside[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, at: np.ndarray, separator: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(hashes, offsets of rows into hashes, starts)`` of the lower-cased words of all rows."""
    start, end = word_bounds(data, at, separator)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64), start
    codes = _BYTE[LOWER[data]]
    codes[separator[data]] = 0
    length = end - start
    longest = int(length.max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    # position of each byte in its word: bytes between words carry the code 0
    follow = np.empty(len(start), np.int64)
    follow[:-1] = start[1:]
    follow[-1] = len(data)
    place = np.arange(start[0], len(data)) - np.repeat(start, follow - start)
    np.minimum(place, len(powers) - 1, out=place)
    codes[start[0] :] *= powers[place]
    hashes = mix64(np.add.reduceat(codes, start) + length.astype(np.uint64))
    return hashes, np.searchsorted(start, at), start


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of every element under ``offsets``."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index and length of every run of equal values."""
    if not len(sorted_values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.diff(np.append(first, len(sorted_values)))


def arrow_map(df, function, schema: str, columns: list[str] | None = None):
    """``mapInArrow`` over the named columns; ``function`` takes one record batch and yields record batches."""
    source = df.select(*columns) if columns else df

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                yield from function(batch)

    return source.mapInArrow(work, schema)


def cut_groups(batches, key: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Tables of whole groups, with first row and length of each, from batches sorted by ``key``.

    Only the group that the last rows belong to waits for the next batch.
    """
    rest: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        if rest and k[-1] == last:
            rest.append(batch)
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if k[0] != k[-1] else 0
        t = pa.Table.from_batches([*rest, batch.slice(0, cut)])
        if t.num_rows:
            first, count = runs(t.column(key).to_numpy())
            yield t, first, count
        rest, last = [batch.slice(cut)], k[-1]
    if rest:
        t = pa.Table.from_batches(rest)
        first, count = runs(t.column(key).to_numpy())
        yield t, first, count
