"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, made from its code point.  A trigram binds (multiplies) the
vectors of its letters after permuting them by their place: twice, once, not at
all.  A text bundles (adds) the vectors of its trigrams; a language bundles the
unit vectors of its training texts.  The language whose bundle has the largest
cosine with the text's wins.

Training adds up all labelled rows, so a rare language is learned at any size of the
table; what reaches the driver is one vector for each language.

Defined results: null texts and texts without a letter get ``und`` and score 0,
as does every text when nothing was learned; ties go to the language that comes
first in code-point order; repeated rows get equal results; an empty table gives
an empty result; other columns pass through unless they bear the names of the
new ones (those are replaced).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import mix64, runs, slices

DIM = 512
SEED = 0x5EED
GAP = 0  # stands for what lies between words
DENSE = 40  # up to so many table rows per used trigram a matrix product beats gathering


@lru_cache(1)
def _letters() -> np.ndarray:
    """The lower-cased code point of every letter of the basic plane; 0 for anything else."""
    out = np.zeros(1 << 16, np.int32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            out[c] = ord(ch.lower()[0])
    return out


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """Random signs of code points, from a hash of the point and the place."""
    lanes = np.arange(DIM // 64, dtype=np.uint64)
    bits = mix64(mix64(points.astype(np.uint64)[:, None] + np.uint64(SEED)) + (lanes[None, :] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    return np.unpackbits(bits.view(np.uint8).reshape(len(points), -1), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def trigram_vectors(codes: np.ndarray) -> np.ndarray:
    """Bound vectors of packed trigrams (three code points of 21 bits)."""
    points, place = np.unique(np.stack((codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF)), return_inverse=True)
    v, (a, b, c) = letter_vectors(points), place.reshape(3, -1)
    return (np.roll(v[a], 2, axis=1) * np.roll(v[b], 1, axis=1) * v[c]).astype(np.float32)


class Bundler:
    """Bundles texts; remembers the vectors of trigrams that it has met, up to a fixed number."""

    def __init__(self, remember: int = 1 << 15):
        self.remember = remember
        self.table = np.zeros((remember, DIM), np.float32)
        self.forget()

    def forget(self) -> None:
        self.known, self.place = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def rows(self, codes: np.ndarray) -> np.ndarray:
        """Places in the table of sorted distinct trigrams; at most ``remember`` of them."""
        fresh = np.setdiff1d(codes, self.known, assume_unique=True)
        if len(self.known) + len(fresh) > self.remember:
            self.forget()
            fresh = codes
        if len(fresh):
            base = len(self.known)
            self.table[base : base + len(fresh)] = trigram_vectors(fresh)
            known = np.concatenate((self.known, fresh))
            order = np.argsort(known, kind="stable")
            self.known, self.place = known[order], np.concatenate((self.place, np.arange(base, base + len(fresh))))[order]
        return self.place[np.searchsorted(self.known, codes)]

    def bundle(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors of the rows, and which rows have a letter."""
        n = len(at) - 1
        out, lettered = np.zeros((n, DIM), np.float32), np.zeros(n, bool)
        grams, counts = [], []
        for i in range(n):
            c = letter_classes(data[at[i] : at[i + 1]])
            lettered[i] = len(c) >= 3
            sorted_grams = np.sort((c[:-2] << 42) | (c[1:-1] << 21) | c[2:]) if lettered[i] else c[:0]
            first, count = runs(sorted_grams)
            grams.append(sorted_grams[first])
            counts.append(count.astype(np.float32))
        every = np.unique(np.concatenate(grams)) if grams else np.zeros(0, np.int64)
        table = self.table[self.rows(every)] if len(every) <= self.remember else None
        used = sum(len(g) for g in grams)
        if table is not None and n * len(every) <= DENSE * used:
            step = max(1, (1 << 22) // max(1, len(every)))
            for i in range(0, n, step):
                part = range(i, min(n, i + step))
                dense = np.zeros((len(part), len(every)), np.float32)
                for k in part:
                    dense[k - i, np.searchsorted(every, grams[k])] = counts[k]
                out[i : i + len(part)] = dense @ table
        else:
            for i in np.flatnonzero(lettered):
                for k in range(0, len(grams[i]), 1024):
                    g = grams[i][k : k + 1024]
                    out[i] += counts[i][k : k + 1024] @ (trigram_vectors(g) if table is None else table[np.searchsorted(every, g)])
        out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), np.float32(1e-12))
        return out, lettered


def letter_classes(data: np.ndarray) -> np.ndarray:
    """Letter classes of one text with one gap before, after and between words; empty without a letter."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    c = _letters()[np.minimum(points, 0xFFFF)]
    if len(wide := np.flatnonzero(points >= (1 << 16))):
        c[wide] = [ord(chr(p).lower()[0]) if chr(p).isalpha() else GAP for p in points[wide].tolist()]
    c = np.concatenate(([GAP], c, [GAP]))
    c = c[np.concatenate(([True], (c[1:] != GAP) | (c[:-1] != GAP)))].astype(np.int64)
    return c if len(c) >= 3 else c[:0]


def fit(docs: DataFrame, *, text_col: str, lang_col: str) -> tuple[list[str], np.ndarray]:
    """Languages and their unit prototypes, from all labelled rows."""
    named = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())

    def partial(batches):
        bundler, sums = Bundler(), {}
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                vectors, lettered = bundler.bundle(data, at)
                langs = np.array(part.column(0).to_pylist(), object)
                for lang in set(langs[lettered].tolist()):
                    rows = vectors[lettered & (langs == lang)]
                    sums[lang] = sums.get(lang, 0) + rows.sum(axis=0, dtype=np.float64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * DIM), "place": pa.array(np.arange(DIM, dtype=np.int32)), "value": pa.array(v)})

    parts = named.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).mapInArrow(partial, "lang string, place int, value double")
    # a row for each language and place reaches the driver, however many tasks there were
    rows = parts.groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r["lang"] for r in rows})
    protos = np.zeros((len(langs), DIM))
    for r in rows:
        protos[langs.index(r["lang"]), r["place"]] = r["value"]
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    return langs, protos.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], *, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` (without the text if not ``keep_text``) with ``lang_pred`` and ``score`` (the cosine with the winner, negative ones as 0)."""
    langs, protos = model
    docs = docs.drop("lang_pred", "score")
    names = [c for c in docs.columns if keep_text or c != text_col]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in names), "lang_pred string", "score double"])

    def work(batches):
        bundler = Bundler()
        for batch in batches:
            for part, data, at in slices(batch, text_col):
                vectors, lettered = bundler.bundle(data, at)
                if langs:
                    cos = vectors @ protos.T
                    best = cos.argmax(axis=1)
                    score = np.clip(cos[np.arange(len(cos)), best].astype(np.float64), 0, 1)
                    pred = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), lettered.tolist())]
                else:
                    pred, score = ["und"] * len(lettered), np.zeros(len(lettered))
                score = np.where(lettered, score, 0.0)
                kept = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(pred, pa.string()), pa.array(score)], [*names, "lang_pred", "score"])

    return docs.mapInArrow(work, schema)


def identify(spark: SparkSession, docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """``docs`` with ``held_out``, ``lang_pred`` and ``score``; rows whose crc32(id) mod 4 is 2 are never learned from."""
    docs = docs.withColumn("held_out", held_out(F.col(id_col), 4))
    model = fit(docs.where(~F.col("held_out")), text_col=text_col, lang_col=lang_col)
    return predict(docs, model, text_col=text_col, keep_text=keep_text)


def held_out(id_col, modulus: int):
    """crc32 of the id as text leaves 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus == 2
