"""Fill-in-middle documents, cut between tokens that a finite automaton finds in parallel.

Tokens are runs of ASCII letters and single other code points.  One automaton over
bytes recognises where a token starts and where a marker (``<P>``, ``<S>``, ``<M>``)
ends.  A block of bytes doesn't know the state it is entered in, so it is scanned from
every state at once and emits its transition function (the state it ends in, for each
entry state) and its counts (for each entry state).  Such summaries compose
associatively: a running composition over the blocks gives every block's entry state
and the tokens before it, and so the block that holds a cut; only that block is
scanned again, from the state now known.

Texts of up to ``GIANT`` bytes are scanned where they lie.  A longer one is cut into
pieces that are dealt over all tasks; their summaries, a few numbers each, meet again
by document, and the document's own row then looks for its cuts in two pieces.

Defined results: a null text is the empty text, which stays plain with 0 tokens; the
cuts of a row without an id follow the hash of the seed alone; repeated rows get equal
results; an empty table gives an empty result; other columns pass through unless they
bear the names of the new ones (those are replaced).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import column_bytes, slices
from ._components import join_hot
from ._store import Workspace

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 90, 20
BLOCK = 128  # bytes that are scanned in one run from every state
PIECE = 1 << 20  # bytes of a piece of a giant text
GIANT = 4 << 20
NEW = ["n", "form", "prefix_chars", "middle_chars", "output"]

# ---- the automaton ----
OTHER, LETTER, OPEN, NAMED = range(4)  # after a non-letter, a letter, "<", and "<" with P, S or M
STATES = 4
_C_OTHER, _C_LETTER, _C_NAME, _C_OPEN, _C_CLOSE, _C_INSIDE = range(6)
_CLASS = np.full(256, _C_OTHER, np.uint8)
for _a, _z in (("a", "z"), ("A", "Z")):
    _CLASS[ord(_a) : ord(_z) + 1] = _C_LETTER
_CLASS[[ord(c) for c in "PSM"]] = _C_NAME
_CLASS[ord("<")], _CLASS[ord(">")] = _C_OPEN, _C_CLOSE
_CLASS[0x80:0xC0] = _C_INSIDE  # further bytes of a code point
#: next state by (class, state), whether a token starts there, and whether a marker ends there
_NEXT = np.array([[OTHER] * 4, [LETTER] * 4, [LETTER, LETTER, NAMED, LETTER], [OPEN] * 4, [OTHER] * 4, [OTHER, LETTER, OPEN, NAMED]], np.uint8)
_STARTS = np.array([[1] * 4, [1, 0, 1, 0], [1, 0, 1, 0], [1] * 4, [1] * 4, [0] * 4], np.int64)
_MARKS = np.zeros((6, 4), np.int64)
_MARKS[_C_CLOSE, NAMED] = 1
#: both counts in one number, so that one look-up adds both
_COUNTS = _STARTS + (_MARKS << 32)


def block_summaries(classes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(end state, counts, first block of each row, start byte)`` of all blocks, the first two for every entry state.

    A block never spans two rows; those of a row follow each other.
    """
    per_row = np.maximum(-(-np.diff(at) // BLOCK), 1)
    first = np.concatenate(([0], np.cumsum(per_row)))
    place = np.arange(first[-1]) - np.repeat(first[:-1], per_row)
    start = np.repeat(at[:-1], per_row) + place * BLOCK
    length = np.minimum(np.repeat(at[1:], per_row) - start, BLOCK)
    order = np.argsort(-length, kind="stable")  # so that the blocks still running are a prefix
    left = np.searchsorted(-length[order], -np.arange(1, BLOCK + 1), "right")
    state = np.tile(np.arange(STATES, dtype=np.uint8), (len(start), 1))
    counts = np.zeros((len(start), STATES), np.int64)
    begin = start[order]
    for i in range(BLOCK):
        m = int(left[i])
        if not m:
            break
        key = classes[begin[:m] + i][:, None] * STATES + state[:m]
        counts[:m] += _COUNTS.ravel()[key]
        state[:m] = _NEXT.ravel()[key]
    end, total = np.empty_like(state), np.empty_like(counts)
    end[order], total[order] = state, counts
    return end, total, first, start


def compose(end: np.ndarray, counts: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running composition over the blocks of each row, by doubling distances: after a block, from every state at the row's start."""
    end, counts = end.copy(), counts.copy()
    place = np.arange(len(end)) - np.repeat(first[:-1], np.diff(first))
    step, longest = 1, int(place.max(initial=0)) + 1
    while step < longest:
        late = np.flatnonzero(place >= step)
        early = late - step
        via = end[early]
        counts[late] = counts[early] + np.take_along_axis(counts[late], via.astype(np.int64), axis=1)
        end[late] = np.take_along_axis(end[late], via.astype(np.int64), axis=1)
        step *= 2
    return end, counts


def _seek(classes: np.ndarray, begin: np.ndarray, stop: np.ndarray, state: np.ndarray, need: np.ndarray) -> np.ndarray:
    """Byte at which the ``need``-th token start after ``begin`` lies, scanning from a known state; ``stop`` if there is none."""
    out = stop.copy()
    state, need = state.astype(np.int64), need.copy()
    open_ = np.flatnonzero(begin < stop)
    i = 0
    while len(open_):
        c = classes[begin[open_] + i].astype(np.int64)
        need[open_] -= _STARTS[c, state[open_]]
        state[open_] = _NEXT[c, state[open_]]
        found = need[open_] == 0
        out[open_[found]] = begin[open_[found]] + i
        i += 1
        open_ = open_[~found & (begin[open_] + i < stop[open_])]
    return out


def scan(data: np.ndarray, at: np.ndarray, entry: int = OTHER) -> tuple[np.ndarray, np.ndarray, tuple]:
    """``(tokens, markers)`` of every row and what :func:`cut` needs to find places in it."""
    classes = _CLASS[data]
    end, counts, first, start = block_summaries(classes, at)
    end, counts = compose(end, counts, first)
    total = counts[first[1:] - 1, entry]
    return total & 0xFFFFFFFF, total >> 32, (classes, at, end, counts, first, start)


def cut(found: tuple, tokens: np.ndarray, entry: np.ndarray | int = OTHER) -> np.ndarray:
    """Byte, within its row, after the first ``tokens`` tokens of every row."""
    classes, at, end, counts, first, start = found
    n = len(at) - 1
    entry = np.broadcast_to(np.asarray(entry), n)
    rows = np.repeat(np.arange(n), np.diff(first))
    seen = counts[np.arange(len(rows)), entry[rows]] & 0xFFFFFFFF
    full = seen <= tokens[rows]  # blocks after which the cut still lies ahead
    block = first[:-1] + np.bincount(rows[full], minlength=n)
    over = block == first[1:]
    block = np.minimum(block, first[1:] - 1)
    head = block == first[:-1]
    before = np.where(head, 0, seen[block - 1])
    state = np.where(head, entry, end[block - 1, entry])
    stop = np.minimum(start[block] + BLOCK, at[1:])
    place = _seek(classes, start[block], stop, state, tokens - before + 1)
    return np.where(over, at[1:], place) - at[:-1]


def _chars(data: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Code points between the bytes ``a`` and ``b`` of every row."""
    run = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return run[at[:-1] + b] - run[at[:-1] + a]


def _draws(id_col: Column, seed: int) -> list[Column]:
    hexes = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hexes, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def _small(df: DataFrame, text_col: str) -> DataFrame:
    names = df.columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "n long, _marks long, _a long, _b long"])

    def work(batches):
        for batch in batches:
            for part, data, at in slices(batch, text_col):
                n, marks, found = scan(data, at)
                h1, h2 = (part.column(part.schema.get_field_index(c)).to_numpy() for c in ("_h1", "_h2"))
                x, y = h1 % (n + 1), h2 % (n + 1)
                a, b = cut(found, np.minimum(x, y)), cut(found, np.maximum(x, y))
                zero = np.zeros_like(a)
                numbers = [n, marks, _chars(data, at, zero, a), _chars(data, at, a, b)]
                yield pa.RecordBatch.from_arrays([*part.columns, *map(pa.array, numbers)], [*names, "n", "_marks", "_a", "_b"])

    return df.mapInArrow(work, schema)


def _pieces(df: DataFrame, text_col: str, piece: int) -> DataFrame:
    """``_key, k, piece``: the bytes of every text in pieces."""
    def work(batches):
        for batch in batches:
            keys = batch.column(0)
            for i in range(batch.num_rows):
                data, _ = column_bytes(batch.column(1).slice(i, 1))
                for k in range(0, max(len(data), 1), piece):
                    yield pa.RecordBatch.from_arrays([keys.slice(i, 1), pa.array([k // piece], pa.int64()), pa.array([data[k : k + piece].tobytes()], pa.binary())], ["_key", "k", "piece"])

    return df.select("_key", text_col).mapInArrow(work, "_key string, k long, piece binary")


def _summaries(pieces: DataFrame) -> DataFrame:
    """``_key, k, end, tokens, marks, chars``: the transition function and the counts of every piece."""
    def work(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                data = np.frombuffer(batch.column(2)[i].as_buffer(), np.uint8)
                end, counts, first, _ = block_summaries(_CLASS[data], np.array([0, len(data)]))
                end, counts = compose(end, counts, first)
                row = [[[int(x) for x in end[-1]]], [[int(x) & 0xFFFFFFFF for x in counts[-1]]], [[int(x) >> 32 for x in counts[-1]]]]
                kinds = (pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()))
                arrays = [pa.array(v, k) for v, k in zip(row, kinds)]
                chars = pa.array([int(((data & 0xC0) != 0x80).sum())], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(1).slice(i, 1), *arrays, chars], ["_key", "k", "end", "tokens", "marks", "chars"])

    return pieces.mapInArrow(work, "_key string, k long, end array<int>, tokens array<long>, marks array<long>, chars long")


def _starts_by(tokens: Column, before: Column) -> Column:
    return before["n"] <= tokens


def _giant(df: DataFrame, text_col: str, piece: int) -> DataFrame:
    """As :func:`_small`, with pieces of a text in many tasks."""
    keyed = df.withColumn("_key", F.concat_ws(":", "_h1", "_h2", F.sha2(F.col(text_col).cast("binary"), 256)))
    times = keyed.groupBy("_key").agg(F.count("*").alias("_times"))
    pieces = _pieces(keyed.select("_key", text_col).dropDuplicates(["_key"]), text_col, piece)
    spread = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = _summaries(pieces.repartition(spread, "_key", "k")).groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("k", "end", "tokens", "marks", "chars"))).alias("s"))
    # compose in order: the entry state, tokens and characters before each piece
    zero = F.struct(F.lit(OTHER).alias("state"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("marks"), F.lit(0).cast("long").alias("chars"))
    start = F.struct(zero.alias("now"), F.array().cast("array<struct<state:int,n:long,chars:long>>").alias("before"))

    def after(acc, p):
        now, s = acc["now"], acc["now"]["state"]
        then = F.struct(p["end"][s].alias("state"), (now["n"] + p["tokens"][s]).alias("n"), (now["marks"] + p["marks"][s]).alias("marks"), (now["chars"] + p["chars"]).alias("chars"))
        return F.struct(then.alias("now"), F.concat(acc["before"], F.array(F.struct(now["state"].alias("state"), now["n"].alias("n"), now["chars"].alias("chars")))).alias("before"))

    plan = met.select("_key", F.aggregate("s", start, after).alias("p")).select("_key", F.col("p.now.n").alias("n"), F.col("p.now.marks").alias("_marks"), F.col("p.before").alias("_before"))
    rows = join_hot(keyed, plan.join(times, "_key"), "_key", "_times", df.count())
    x, y = (F.pmod(F.col(h), F.col("n") + 1) for h in ("_h1", "_h2"))
    for name, cuts in (("_x", F.least(x, y)), ("_y", F.greatest(x, y))):
        # a cut lies where the next token starts: in the last piece with at most so many tokens before it
        k = F.greatest(F.size(F.filter("_before", functools.partial(_starts_by, cuts))) - 1, F.lit(0))
        rows = rows.withColumn(name, F.struct(cuts.alias("tokens"), k.alias("k"), F.element_at("_before", k + 1).alias("p")))
    rows = rows.drop("_before")
    keep = df.columns
    schema = ", ".join([*(f"`{c}` {t}" for c, t in df.dtypes), "n long, _marks long, _a long, _b long"])

    def work(batches):
        for batch in batches:
            of = lambda c: batch.column(batch.schema.get_field_index(c))
            a, b = [], []
            for i in range(batch.num_rows):
                data, _ = column_bytes(of(text_col).slice(i, 1))
                ends = []
                for c in ("_x", "_y"):
                    v = of(c)[i].as_py()
                    own = data[v["k"] * piece : (v["k"] + 1) * piece]
                    at = np.array([0, len(own)])
                    _, _, found = scan(own, at)
                    place = int(cut(found, np.array([v["tokens"] - v["p"]["n"]]), np.array([v["p"]["state"]]))[0])
                    ends.append(v["p"]["chars"] + int(((own[:place] & 0xC0) != 0x80).sum()))
                a.append(ends[0])
                b.append(ends[1] - ends[0])
            yield pa.RecordBatch.from_arrays([*(of(c) for c in keep), of("n"), of("_marks"), pa.array(a, pa.int64()), pa.array(b, pa.int64())], [*keep, "n", "_marks", "_a", "_b"])

    return rows.mapInArrow(work, schema)


def transform(
    spark: SparkSession,
    docs: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    seed: int = 1,
    rate: int = RATE,
    spm_rate: int = SPM_RATE,
    giant: int = GIANT,
    piece: int = PIECE,
) -> DataFrame:
    """``docs`` with ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` of 100 texts are transformed, ``spm_rate`` of 100 of these with the suffix first.
    """
    docs = docs.drop(*NEW)
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = docs.withColumns({f"_h{i + 1}": h for i, h in enumerate(_draws(F.col(id_col), seed))})
    long = F.octet_length(text) > giant
    both = _small(drawn.where(~long), text_col)
    giants = Workspace(spark, "fill").save(drawn.where(long), "giants")
    if not giants.isEmpty():
        both = both.unionByName(_giant(giants, text_col, piece))
    plain = (F.length(text) == 0) | (F.col("_marks") > 0) | (F.col("_h3") % 100 >= rate)
    form = F.when(plain, "plain").when(F.col("_h4") % 100 < spm_rate, "spm").otherwise("psm")
    out = both.withColumn("form", form)
    prefix = F.substring(text, F.lit(1), F.col("_a").cast("int"))
    middle = F.substring(text, (F.col("_a") + 1).cast("int"), F.col("_b").cast("int"))
    suffix = F.substring(text, (F.col("_a") + F.col("_b") + 1).cast("int"), F.length(text))
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    out = out.withColumn("output", F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm))
    cut_at = lambda c: F.when(F.col("form") != "plain", F.col(c))
    return out.select(*docs.columns, "n", "form", cut_at("_a").alias("prefix_chars"), cut_at("_b").alias("middle_chars"), "output")


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of: a text that holds a marker is never transformed, so each marker occurs once."""
    head, middle = F.substring_index(output, MIDDLE, 1), F.substring_index(output, MIDDLE, -1)
    first = lambda mark: F.substring(F.substring_index(head, mark, 1), F.lit(4), F.length(output))
    psm = F.concat(first(SUFFIX), middle, F.substring_index(head, SUFFIX, -1))
    spm = F.concat(F.substring_index(head, PREFIX, -1), middle, first(PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
