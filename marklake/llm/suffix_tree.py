"""Language-model scoring with a probabilistic suffix tree over bytes.

A text is its lower-cased words with single spaces and one end symbol.  All training
texts are counted: every byte with its last ``DEPTH`` bytes.  A context is a state of
the tree if its next-byte distribution diverges from that of the longest shorter
state enough to save ``GAIN`` nats for each next byte that it lists; contexts of up to
``TOP`` bytes are always states.  A state's distribution is smoothed by absolute
discounting (one discount each for counts of 1, 2 and more) towards that of the
longest state among its suffixes, down to the uniform one; between ``TOP`` and ``DEPTH``
a byte counts once for every different byte before its context.  A byte is scored by
the longest state that its past ends in; a text's score is the sum over its bytes and
its end, and nothing else.

Every context and every next byte that the training texts hold enters the tree, at any
size of the corpus.  Runs of ``DEPTH + 1`` bytes fill one 64-bit word.  They are dealt
by their newest ``TOP + 1`` context bytes, so that each part holds whole subtrees, and
travel as sorted arrays.  A context that a sample of the texts shows in more than one of
``SHARE`` bytes is split by its next older byte, again and again; its own counts are
added up over the parts.  The counts of the shortest contexts, at most 256 ** (TOP + 1)
pairs, and of the split ones, at most ``SHARE`` * 256 for each length, travel to every
task.  The sample only says where a run lies, never what it counts.  The ``CACHE`` most frequent runs with
their log probabilities, and an eighth as many words, travel with the tasks that read
the texts; all other runs and words of a text are looked up where their part of the
table lies, and only sums for each text come back.  What travels changes only where a
value is looked up.

Defined results: a null text counts as empty and scores its end symbol; a null id is
held out or not by the empty text; without training rows the uniform distribution
scores; repeated rows get equal scores, and each counts in training; an empty table
gives an empty result; further columns are not returned.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import LOWER, SPACE, mix64, rows_of, runs, slices, words
from ._store import Workspace
from .language_id import held_out

DEPTH = 7
TOP = 2
CACHE = 4_000_000  # runs that are looked up in the tasks, and an eighth as many words
DISCOUNTS = (0.6, 1.2, 1.7)  # for counts of 1, 2 and more
GAIN = 0.5  # nats that a context must save for each next byte that it lists
END = 10  # line feed: it can't stand in the folded text
CHUNK = 5_000_000  # symbols that a task sorts at once
PART = 4 << 20  # text bytes for each part of the tree
SHARE = 1024  # a context of more than one in so many bytes is split over parts
SAMPLE = 16 << 20  # about so many text bytes say which contexts are split
BLOCK = 1 << 19  # runs whose parts a task computes at once
COARSE = 16  # parts of the tree that are searched by one task
UNIT_ROWS, UNIT_GAPS = 8192, 1 << 20  # texts, and looked-up runs, that a task passes on at once

_FOLDED = np.where(SPACE, np.uint8(32), LOWER)


def stream(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(codes, symbols per row)``: the code of a symbol holds the ``DEPTH`` bytes before it, the newest one highest, and itself lowest."""
    n, gap = len(at) - 1, DEPTH + 1
    f, out = _FOLDED[data], np.full(len(data) + n * gap, END, np.uint8)
    for i in range(n):
        out[at[i] + i * gap + DEPTH : at[i + 1] + i * gap + DEPTH] = f[at[i] : at[i + 1]]
    blank, edge = out == 32, out == END
    keep = np.ones(len(out), bool)
    keep[1:] = ~(blank[1:] & (blank[:-1] | edge[:-1]))
    out = out[keep]
    keep = np.ones(len(out), bool)
    keep[:-1] = (out[:-1] != 32) | (out[1:] != END)
    out = out[keep]
    ends = np.flatnonzero(out == END).reshape(n, gap)
    real = np.ones(len(out), bool)
    real[ends[:, :DEPTH].ravel()] = False
    codes = packed(out, gap)[real].byteswap()
    return (codes << np.uint64(8)) | (codes >> np.uint64(56)), ends[:, DEPTH] - ends[:, DEPTH - 1]


def packed(data: np.ndarray, length: int) -> np.ndarray:
    """Each byte packed with the ``length - 1`` bytes before it, the newest one lowest."""
    out, have, power, step = np.zeros(len(data), np.uint64), 0, data.astype(np.uint64), 1
    while length:
        if length & 1:
            out[have:] |= power[: len(power) - have] << np.uint64(8 * have)
            have += step
        length >>= 1
        if length:
            twice = power.copy()
            twice[step:] |= power[: len(power) - step] << np.uint64(8 * step)
            power, step = twice, 2 * step
    return out


def shorter(codes: np.ndarray) -> np.ndarray:
    """Codes without the oldest byte of their context."""
    return (codes >> np.uint64(16) << np.uint64(8)) | (codes & np.uint64(0xFF))


def put(values: np.ndarray) -> bytes:
    """An array as compressed byte planes."""
    flat = np.ascontiguousarray(values)
    return pa.compress(flat.view(np.uint8).reshape(-1, flat.itemsize).T.tobytes(), "zstd", asbytes=True) if len(flat) else b""


def get(raw: bytes, size: int, kind) -> np.ndarray:
    if not size:
        return np.zeros(0, kind)
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, size * width, "zstd"), np.uint8).reshape(width, size)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def put_keys(sorted_keys: np.ndarray) -> bytes:
    return put(np.diff(sorted_keys, prepend=np.uint64(0)))


def get_keys(raw: bytes, size: int) -> np.ndarray:
    return np.cumsum(get(raw, size, np.uint64), dtype=np.uint64)


def _summed(key: np.ndarray, *counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of their counts."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    first, _ = runs(key)
    return key[first], *(np.add.reduceat(c[order], first) if len(first) else c for c in counts)


class Table:
    """Keys and values that turn into a :class:`Lookup` where they arrive."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values = keys, values

    def __reduce__(self):
        return Lookup, (self.keys, self.values)


class Lookup:
    """Values of 64-bit keys by linear probing; values are never NaN, which marks a missing key."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(2 * len(keys) + 2))))
        place = self._slot(keys)
        order = np.argsort(place, kind="stable")
        # in order of their slots, each key takes its own slot or the next free one
        nth = np.arange(len(keys))
        place = place[order]
        place -= nth
        np.maximum.accumulate(place, out=place)
        place += nth
        del nth
        size = max(1 << self.bits, int(place[-1]) + 1 if len(keys) else 0) + 1
        self.slots, self.values = np.zeros(size, np.uint64), np.full(size, np.nan, values.dtype)
        self.slots[place], self.values[place] = keys[order], values[order]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        left = np.flatnonzero((self.slots[slot] != keys) & ~np.isnan(out))
        slot = slot[left]
        while len(left):
            slot = slot + 1
            got = self.values[slot]
            out[left] = got
            more = (self.slots[slot] != keys[left]) & ~np.isnan(got)
            left, slot = left[more], slot[more]
        return out


def _smoothed(count: np.ndarray, first: np.ndarray, base: np.ndarray, discounts) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each pair in its context, and each context's total; ``first`` are the contexts' first pairs."""
    size = np.diff(np.append(first, len(count)))
    less = np.array([0.0, *discounts])[np.minimum(count, 3)]
    kept = np.maximum(count - less, 0)
    total = np.add.reduceat(count, first)
    left = np.where(total > 0, (total - np.add.reduceat(kept, first)) / np.maximum(total, 1), 1.0)
    return kept / np.repeat(np.maximum(total, 1), size) + np.repeat(left, size) * base, total


def _by_state(pair: np.ndarray, raw: np.ndarray, count: np.ndarray, base: np.ndarray, discounts, gain: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Probability of each pair by its context if that is a state, else ``base``; which contexts are states, and their first pairs."""
    first, size = runs(pair >> np.uint64(8))
    prob, total = _smoothed(count, first, base, discounts)
    saved = np.add.reduceat(np.where(raw > 0, raw * np.log(prob / base), 0.0), first)
    state = (total > 0) & (saved > gain * np.add.reduceat((count > 0).astype(np.int64), first))
    return np.where(np.repeat(state, size), prob, base), state, first


def _at(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of ``keys``, and which of them are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


class Upper:
    """Distributions of the contexts of up to ``TOP`` = 2 bytes, and of the longer ones that are split over parts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, discounts=DISCOUNTS):
        key = key.astype(np.uint64)
        every = np.arange(1 << 16)
        self.none = _smoothed(np.bincount((key & np.uint64(0xFF)).astype(np.int64), n, 256).astype(np.int64), np.zeros(1, np.int64), np.full(256, 1 / 256), discounts)[0]
        self.one = _smoothed(np.bincount(shorter(key).astype(np.int64), n, 1 << 16).astype(np.int64), every[::256], self.none[every & 0xFF], discounts)[0]
        self.key, n = _summed(key, n)
        base = self.one[shorter(self.key).astype(np.int64)]
        self.two, self.left = np.zeros(0), np.ones(1 << 16)
        if len(self.key):
            first, _ = runs(self.key >> np.uint64(8))
            self.two, total = _smoothed(n, first, base, discounts)
            kept = np.add.reduceat(np.maximum(n - np.array([0.0, *discounts])[np.minimum(n, 3)], 0), first)
            self.left[(self.key[first] >> np.uint64(8)).astype(np.int64)] = (total - kept) / total
        self.split: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add_split(self, split: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]], discounts=DISCOUNTS, gain: float = GAIN) -> Upper:
        """Take pairs, occurrences and counts of the split contexts by length; counts lack what split contexts one byte longer add."""
        split = {k: tuple(x[np.argsort(v[0])] for x in v) for k, v in split.items()}
        for k in sorted(split, reverse=True):
            if k + 1 in split:
                longer, raw, _ = split[k + 1]
                np.add.at(split[k][2], np.searchsorted(split[k][0], shorter(longer[raw > 0])), 1)
        for k in sorted(split):
            pair, raw, count = split[k]
            base = self.prob(pair) if k == TOP + 1 else self.split[k - 1][1][np.searchsorted(self.split[k - 1][0], shorter(pair))]
            self.split[k] = pair, _by_state(pair, raw, count, base, discounts, gain)[0]
        return self

    def prob(self, codes: np.ndarray) -> np.ndarray:
        """Probability of the newest byte of each code of three bytes of context by the last two."""
        key = shorter(codes)
        out = self.left[(key >> np.uint64(8)).astype(np.int64)] * self.one[shorter(key).astype(np.int64)]
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            out = np.where(self.key[at] == key, self.two[at], out)
        return out


def probabilities(keys: np.ndarray, n: np.ndarray, upper: Upper, discounts=DISCOUNTS, gain: float = GAIN) -> tuple[np.ndarray, list[int]]:
    """Probability of the newest byte of every run by its longest state, and the number of states of each length.

    ``keys`` are distinct sorted runs of whole subtrees but for the split contexts, which
    ``upper`` knows; ``n`` are their occurrences in training: runs that only other texts
    hold have none.
    """
    stack = [(keys, n, n, None)]
    for k in range(DEPTH - 1, TOP, -1):
        pair, raw, _, _ = stack[-1]
        less, to = np.unique(shorter(pair), return_inverse=True)
        stack.append((less, np.bincount(to, raw, len(less)).astype(np.int64), np.bincount(to, raw > 0, len(less)).astype(np.int64), to))
    base, states = upper.prob(stack[-1][0]), []
    for i in range(len(stack) - 1, -1, -1):
        pair, raw, count, _ = stack[i]
        prob, state, first = _by_state(pair, raw, count, base, discounts, gain)
        if DEPTH - i in upper.split:
            known, value = upper.split[DEPTH - i]
            at, hit = _at(known, pair)
            prob[hit] = value[at[hit]]
            state = state & ~hit[first]
        states.append(int(state.sum()))
        if i:
            base = prob[stack[i][3]]
    return prob, states


_PARTS = "kind int, p int, key long, size long, a binary, b binary, c binary"
_NAMES = ["kind", "p", "key", "size", "a", "b", "c"]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
RUNS, WORDS, SHORT, TEXTS, SPLIT_RAW, SPLIT_COUNT = range(6)  # the last two: of split contexts of ``p`` bytes


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


def _spans(keys: np.ndarray, contexts: np.ndarray, k: int):
    """``(first, end)`` in sorted runs of each context of ``k`` bytes that they hold."""
    low = np.uint64(64 - 8 * k)
    first = np.searchsorted(keys, contexts << low)
    end = np.searchsorted(keys, (contexts << low) | np.uint64((1 << int(low)) - 1), "right")
    some = end > first
    return zip(first[some].tolist(), end[some].tolist())


def _part_of_run(keys: np.ndarray, parts: int, split: dict[int, np.ndarray]) -> np.ndarray:
    """Parts of sorted runs: by their shortest context of more than ``TOP`` bytes that isn't split."""
    out = np.empty(len(keys), np.uint16 if parts <= 1 << 16 else np.int64)
    for at in range(0, len(keys), BLOCK):
        some = keys[at : at + BLOCK]
        low = np.full(len(some), 64 - 8 * (TOP + 1), np.uint64)
        for k, contexts in split.items():
            for i, j in _spans(some, contexts, k):
                low[i:j] = 64 - 8 * (k + 1)
        out[at : at + BLOCK] = mix64(some >> low) % np.uint64(parts)
    return out


def crowded(rows: DataFrame, size: int, share: int, sample: int) -> dict[int, np.ndarray]:
    """Contexts by length that more than one in ``share`` bytes of about ``sample`` of the ``size`` text bytes follow: at most ``share`` of each length."""

    def tally(batches):
        for batch in batches:
            for _, data, at in slices(batch, "text"):
                codes, _ = stream(data, at)
                codes.sort()
                for k in range(TOP + 1, DEPTH):
                    context = codes >> np.uint64(64 - 8 * k)
                    first, n = runs(context)
                    some = n * 2 * share > len(codes)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), k, np.int32)), pa.array(context[first[some]].view(np.int64)), pa.array(n[some])], ["k", "context", "n"])

    some = rows.select("text").sample(min(1.0, sample / max(size, 1)), seed=6)
    counted = some.mapInArrow(tally, "k int, context long, n long").groupBy("k", "context").agg(F.sum("n").alias("n"))
    got = counted.where(F.col("n") * share > min(size, sample)).orderBy(F.desc("n"), "k", "context").limit(share * (DEPTH - TOP - 1)).collect()
    out: dict[int, np.ndarray] = {}
    for k in range(TOP + 1, DEPTH):
        found = set([r["context"] for r in got if r["k"] == k][:share])
        if k > TOP + 1:  # a context is split only if its shorter one is
            found = {c for c in found if c >> 8 in out[k - 1]}
        out[k] = np.array(sorted(found), np.uint64)
    return {k: v for k, v in out.items() if len(v)}


def split_counts(keys: np.ndarray, n: np.ndarray, split: dict[int, np.ndarray]):
    """``(length, pairs, occurrences, counts)`` of the split contexts in a part's sorted runs; longer split contexts add nothing to counts."""
    for i, j in _spans(keys, split[TOP + 1], TOP + 1) if split else ():
        pair, raw = keys[i:j], n[i:j]
        for k in range(DEPTH - 1, TOP, -1):
            whole = raw > 0
            if k + 1 in split:
                whole &= ~_at(split[k + 1], pair >> np.uint64(8))[1]
            pair, to = np.unique(shorter(pair), return_inverse=True)
            raw, count = np.bincount(to, raw, len(pair)).astype(np.int64), np.bincount(to, whole, len(pair)).astype(np.int64)
            if k in split:
                own = _at(split[k], pair >> np.uint64(8))[1]
                if own.any():
                    yield k, pair[own], raw[own], count[own]


def _part_of_word(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)


def _dealt(part: np.ndarray, *arrays: np.ndarray):
    """``(part, arrays of its rows)``, the rows in the order given."""
    order = np.argsort(part, kind="stable")
    first, count = runs(part[order])
    for i, n in zip(first.tolist(), count.tolist()):
        at = order[i : i + n]
        yield int(part[at[0]]), *(a[at] for a in arrays)


def count(rows: DataFrame, parts: int, split: dict[int, np.ndarray]) -> DataFrame:
    """All runs and words of ``rows (text, held_out)``, one row for each part: keys, occurrences in training and in all."""

    def tally(batches):
        # training codes fill the room from below, the others from above
        room, low, high, terms, texts = np.empty(0, np.uint64), 0, 0, [], 0

        def taken():
            for some, trained in ((room[:low], 1), (room[high:], 0)):
                some.sort()
                first, n = runs(some)
                key, n = some[first], n.astype(np.int32)
                del first
                for p, k, c in _dealt(_part_of_run(key, parts, split), key, n):
                    yield _batch([(RUNS, p, trained, len(k), put_keys(k), put(c), b"")])
            if terms:
                key, n = _summed(np.concatenate([k for k, _ in terms]), np.concatenate([c for _, c in terms]))
                for p, k, a in _dealt(_part_of_word(key, parts), key, n):
                    yield _batch([(WORDS, p, 0, len(k), put_keys(k), put(a), b"")])

        for batch in batches:
            for part, data, at in slices(batch, "text"):
                out = part.column(part.schema.get_field_index("held_out")).to_numpy(zero_copy_only=False).astype(bool)
                c, n = stream(data, at)
                if low + len(room) - high + len(c) > len(room):
                    yield from taken()
                    terms, low = [], 0
                    if len(room) < max(CHUNK, len(c)):
                        room = np.empty(max(CHUNK, len(c)), np.uint64)
                    high = len(room)
                hidden = np.repeat(out, n)
                own = c[~hidden]
                room[low : low + len(own)] = own
                low += len(own)
                own = c[hidden]
                high -= len(own)
                room[high : high + len(own)] = own
                h, off, _ = words(data, at)
                h = np.sort(h[~out[rows_of(off)]])
                first, times = runs(h)
                terms.append((h[first], times))
                texts += int((~out).sum())
        yield from taken()
        yield _batch([(TEXTS, 0, 0, texts, b"", b"", b"")])

    def merge(batches):
        found, texts = defaultdict(list), 0
        for batch in batches:
            for r in batch.to_pylist():
                if r["kind"] == TEXTS:
                    texts += r["size"]
                else:
                    found[r["kind"], r["p"]].append((r["size"], r["a"], r["b"], r["key"]))
        for kind, p in list(found):
            blobs = found.pop((kind, p))
            keys = np.concatenate([get_keys(a, s) for s, a, _, _ in blobs])
            if kind == WORDS:
                keys, n = _summed(keys, np.concatenate([get(b, s, np.int64) for s, _, b, _ in blobs]))
                yield _batch([(WORDS, p, int(n.sum()), len(keys), put_keys(keys), put(n), b"")])
                continue
            uses = [get(b, s, np.int32).astype(np.int64) for s, _, b, _ in blobs]
            keys, n, uses = _summed(keys, np.concatenate([x * blob[3] for x, blob in zip(uses, blobs)]), np.concatenate(uses))
            yield _batch([(RUNS, p, 0, len(keys), put_keys(keys), put(n), put(uses))])
            short, times = _summed((keys >> np.uint64(64 - 8 * TOP) << np.uint64(8)) | (keys & np.uint64(0xFF)), n)
            if times.any():
                yield _batch([(SHORT, 0, k, c, b"", b"", b"") for k, c in zip(short.view(np.int64).tolist(), times.tolist()) if c])
            for k, pair, raw, some in split_counts(keys, n, split):
                for kind, values in ((SPLIT_RAW, raw), (SPLIT_COUNT, some)):
                    yield _batch([(kind, k, x, c, b"", b"", b"") for x, c in zip(pair.view(np.int64).tolist(), values.tolist())])
        yield _batch([(TEXTS, 0, 0, texts, b"", b"", b"")])

    return rows.select("text", "held_out").mapInArrow(tally, _PARTS).repartition(parts, "p").mapInArrow(merge, _PARTS)


def grow(counts: DataFrame, *, discounts=DISCOUNTS, gain: float = GAIN) -> DataFrame:
    """The runs of ``counts`` with their log10 probabilities by the tree (``a`` keys, ``b`` logs, ``c`` uses; ``key`` counts the part's states)."""
    short = counts.where(F.col("kind") == SHORT).groupBy("key").agg(F.sum("size").alias("n")).toArrow()
    key, n = (short.column(i).to_numpy() for i in range(2))
    added = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("size")).otherwise(0))
    split = counts.where(F.col("kind").isin(SPLIT_RAW, SPLIT_COUNT)).groupBy("p", "key").agg(added(SPLIT_RAW).alias("raw"), added(SPLIT_COUNT).alias("n")).toArrow()
    length, pair, raw, times = (split.column(i).to_numpy() for i in range(4))
    by_length = {int(k): (pair[length == k].view(np.uint64), raw[length == k], times[length == k].copy()) for k in np.unique(length)}
    upper = counts.sparkSession.sparkContext.broadcast(Upper(key, n, discounts).add_split(by_length, discounts, gain))

    def work(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, n = get_keys(r["a"], r["size"]), get(r["b"], r["size"], np.int64)
                prob, states = probabilities(keys, n, upper.value, discounts, gain)
                yield _batch([(RUNS, r["p"], sum(states), len(keys), r["a"], put(np.log10(prob).astype(np.float32)), r["c"])])

    return counts.where(F.col("kind") == RUNS).mapInArrow(work, _PARTS)


def commonest(table: DataFrame, uses: str, value: str, kind, most: int) -> tuple[np.ndarray, np.ndarray]:
    """About the ``most`` keys of a table of parts with the highest ``uses``, and their values; nothing is sorted."""

    def steps(n: np.ndarray) -> np.ndarray:
        return np.floor(16 * np.log2(np.maximum(n, 1))).astype(np.int64)

    def tally(batches):
        for batch in batches:
            for r in batch.to_pylist():
                step, n = np.unique(steps(get(r[uses], r["size"], np.int64)), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(step), pa.array(n)], ["step", "n"])

    rest, cut, part = most, -1, 0
    for step, n in sorted(((r[0], r[1]) for r in table.mapInArrow(tally, "step long, n long").groupBy("step").agg(F.sum("n")).collect()), reverse=True):
        if n > rest:
            cut, part = step, int(rest / n * (1 << 20))
            break
        rest -= n

    def select(batches):
        for batch in batches:
            for r in batch.to_pylist():
                keys, step = get_keys(r["a"], r["size"]), steps(get(r[uses], r["size"], np.int64))
                take = (step > cut) | ((step == cut) & ((mix64(keys) & np.uint64((1 << 20) - 1)) < np.uint64(part)))
                keys = keys[take]
                yield _batch([(0, 0, 0, len(keys), put_keys(keys), put(get(r[value], r["size"], kind)[take]), b"")])

    got = table.mapInArrow(select, _PARTS).collect()
    keys = [get_keys(r["a"], r["size"]) for r in got]
    values = [get(r["b"], r["size"], kind) for r in got]
    return np.concatenate([np.zeros(0, np.uint64), *keys]), np.concatenate([np.zeros(0, kind), *values])


def score(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", cache: int = CACHE, part: int = PART, share: int = SHARE, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``."""
    ws = Workspace(spark, "lm")
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col), 7).alias("held_out"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = 1 + size // part
    coarse = -(-parts // COARSE)
    split = crowded(rows, size, share, sample)
    counts = ws.save(count(rows, parts, split), "counts")
    tree = ws.save(grow(counts), "tree")
    vocabulary = counts.where(F.col("kind") == WORDS)
    texts = counts.where(F.col("kind") == TEXTS).agg(F.sum("size")).first()[0] or 0
    n_words, distinct = vocabulary.agg(F.sum("key"), F.sum("size")).first()
    tokens, distinct = (n_words or 0) + texts, (distinct or 0) + (texts > 0)
    run_logs = spark.sparkContext.broadcast(Table(*commonest(tree, "c", "b", np.float32, cache)))
    keys, n = commonest(vocabulary, "b", "b", np.int64, cache // 8)
    word_counts = spark.sparkContext.broadcast(Table(keys, n.astype(np.float64)))
    log_end, log_all = float(np.log10(texts + 1.0)), float(np.log10(tokens + distinct + 1.0))
    kind = dict(docs.dtypes)[id_col]
    names = ["kind", "t", "i", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "g", "size", "a", "b"]
    types = [pa.int32(), pa.int64(), pa.int32(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def read(batches):
        """A row for each text, with what is at hand, and rows of the runs and words that must be looked up elsewhere."""
        unit, done, gaps, held = None, 0, {RUNS: [], WORDS: []}, 0

        def passed(id_type):
            for what in (RUNS, WORDS):
                if not gaps[what]:
                    continue
                key, who = (np.concatenate(x) for x in zip(*gaps[what]))
                order = np.argsort(key, kind="stable")
                key, who = key[order], who[order]
                at = _part_of_run(key, parts, split) if what == RUNS else _part_of_word(key, parts)
                for g, k, w in _dealt(at % coarse, key, who):
                    one = {"kind": 1 + what, "t": unit, "g": g, "size": len(k), "a": put_keys(k), "b": put(w)}
                    yield pa.RecordBatch.from_arrays([pa.array([one.get(c)], t or id_type) for c, t in zip(names, types)], names)

        for batch in batches:
            for part, data, at in slices(batch, "text"):
                n, id_type = part.num_rows, part.column(1).type
                if unit is None:
                    unit, done, gaps, held = part.column(0)[0].as_py(), 0, {RUNS: [], WORDS: []}, 0
                codes, size = stream(data, at)
                log = run_logs.value.find(codes)
                gap = np.flatnonzero(np.isnan(log))
                log[gap] = 0
                start = np.cumsum(size) - size
                lm = np.add.reduceat(log, start, dtype=np.float64)
                gaps[RUNS].append((codes[gap], (np.searchsorted(start, gap, "right") - 1 + done).astype(np.uint32)))
                h, off, _ = words(data, at)
                row, times = rows_of(off), word_counts.value.find(h)
                hit = ~np.isnan(times)
                base = np.bincount(row[hit], np.log10(times[hit] + 1.0), n)
                known = np.bincount(row[hit], minlength=n) + int(texts > 0)
                gaps[WORDS].append((h[~hit], (row[~hit] + done).astype(np.uint32)))
                held += len(gap) + int((~hit).sum())
                null = lambda t: pa.nulls(n, t)  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, unit)), pa.array(np.arange(done, done + n, dtype=np.int32)), part.column(1), part.column(2), pa.array((np.diff(off) + 1).astype(np.int64)), pa.array(known.astype(np.int64)), pa.array(base.astype(float) + log_end), pa.array(lm), null(pa.int32()), null(pa.int64()), null(pa.binary()), null(pa.binary()),
                ], names)
                done += n
                if done > UNIT_ROWS or held > UNIT_GAPS:
                    yield from passed(id_type)
                    unit = None
        if unit is not None:
            yield from passed(id_type)

    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "held_out", "text")
    scored = ws.save(numbered.mapInArrow(read, f"kind int, t long, i int, doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, g int, size long, a binary, b binary"), "scored")

    def look_up(batches):
        """For each unit, and by kind, the sums of its texts' values and how many were found."""
        tables, asked = {RUNS: [], WORDS: []}, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["t"] is None:
                    tables[r["kind"]].append((get_keys(r["a"], r["size"]), get(r["b"], r["size"], np.float32 if r["kind"] == RUNS else np.int64)))
                else:
                    asked.append(r)
        known = {}
        for what, kind in ((RUNS, np.float32), (WORDS, np.int64)):
            some = tables.pop(what)
            key = np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in some)])
            value = np.concatenate([np.zeros(0, kind), *(v for _, v in some)])
            del some
            order = np.argsort(key, kind="stable")
            known[what] = key[order], value[order] if what == RUNS else np.log10(value[order] + 1.0)
        sums = {}
        for r in asked:
            key, value = known[r["kind"]]
            want, who = get_keys(r["a"], r["size"]), get(r["b"], r["size"], np.uint32)
            if not len(key):
                continue
            at = np.minimum(np.searchsorted(key, want), len(key) - 1)
            hit = key[at] == want
            total, n = np.bincount(who[hit], value[at[hit]]), np.bincount(who[hit])
            if len(n):
                sums.setdefault((r["t"], r["kind"]), []).append((total, n))
        for (t, what), some in sums.items():
            size = max(len(n) for _, n in some)
            total, n = (sum(np.pad(x[j], (0, size - len(x[j]))) for x in some) for j in range(2))
            yield _batch([(what, 0, t, size, put(total.astype(np.float64)), put(n.astype(np.int64)) if what == WORDS else b"", b"")])

    run_logs.unpersist()
    word_counts.unpersist()
    table = tree.unionAll(vocabulary).select("kind", F.lit(None).cast("long").alias("t"), F.pmod("p", F.lit(coarse)).alias("g"), "size", "a", "b")
    wanted = scored.where("kind > 0").select((F.col("kind") - 1).alias("kind"), "t", "g", "size", "a", "b")
    partial = table.unionAll(wanted).repartition(coarse, "g").mapInArrow(look_up, _PARTS)

    def add_up(batches):
        sums = defaultdict(lambda: np.zeros((3, 0)))
        for batch in batches:
            for r in batch.to_pylist():
                have, size = sums[r["key"]], r["size"]
                if have.shape[1] < size:
                    have = sums[r["key"]] = np.pad(have, ((0, 0), (0, size - have.shape[1])))
                have[0 if r["kind"] == RUNS else 1, :size] += get(r["a"], size, np.float64)
                if r["kind"] == WORDS:
                    have[2, :size] += get(r["b"], size, np.int64)
        for t, have in sums.items():
            i = np.flatnonzero(have.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), t)), pa.array(i.astype(np.int32)), pa.array(have[0, i]), pa.array(have[1, i]), pa.array(have[2, i].astype(np.int64))], ["t", "i", "more_score", "more_base", "more_known"])

    more = partial.repartition("key").mapInArrow(add_up, "t long, i int, more_score double, more_base double, more_known long")
    out = scored.where("kind = 0").join(more, ["t", "i"], "left")
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return ws.settle(out.select(
        "doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (plus("base", "more_base") - F.col("n_tokens") * log_all).alias("base_score"), plus("score", "more_score").alias("score"),
    ))
