"""Toxicity by a linear classifier of sentences that mentions of groups don't sway.

A text is as toxic as its worst sentence.  A sentence is scored by the weights of its
distinct words: of the whole word and of its first three to six bytes, hashed.  Which
sentence of a toxic document earned the label isn't known: log odds of the features over
all learned documents point at one, a classifier of the features with odds surely above
even is learned from these, points again, and is learned again; of clean documents the
sentences that look worst are learned.

Counterfactual regularisation: identity terms in a learned sentence are swapped for other
ones, neutral words among them, and the squared change of its score is a penalty.  So a
group that is named in many toxic sentences earns no weight by that.

At most ``per_class`` labelled rows of each class are learned from, those with the
smallest hash of their id; of each at most ``1 + clean`` sentences of ``WINDOW`` words
and, for each of ``DIM`` features, two counts reach the driver.

Defined results: a null text counts as empty; an empty text, or one without words, gets
the score of a sentence without words; labels that are null are ignored, of several
labels of one id the largest counts, of several texts of one id the least is learned;
without any learned row every score is 0; equal texts get equal scores in any
partitioning (weights lie on a binary grid, so their sums are exact); an empty table gives
an empty result; other columns pass through unless they bear the names of the new ones
(those are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytes import _BYTE, _POWERS, LOWER, mix64, slices, word_bounds, words
from ._store import Workspace

DIM = 1 << 18
PREFIXES = (3, 4, 5, 6)
WINDOW = 40  # words of a sentence; a longer one is scored in windows
PER_CLASS = 4000
CLEAN = 2  # sentences of a clean document that are learned
PENALTY = 1.0
SWAPS = 4
ROUNDS = 2
TURNS = 200
RIDGE = 1e-5
SURE = 1.64  # standard errors that log odds must lie above 0 to point at a sentence
NOTHING = -5.0  # what a sentence gets where no learned document is toxic
BALANCE = 0.5  # share of the loss that toxic sentences have
CUT = 0.5
GRID = 2.0**-16
BIG = 4 << 20  # bytes of a text that are scored at once

# Terms that name groups, and neutral words they are swapped with
IDENTITY = """women men girls boys woman man girl boy muslims christians jews hindus buddhists atheists muslim christian jewish hindu
immigrants refugees foreigners black white asian latino african european gay lesbian straight bisexual transgender queer
disabled blind deaf autistic elderly""".split()
NEUTRAL = "people persons neighbours visitors".split()

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[ord("a") : ord("z") + 1] = False
_SEPARATOR[ord("A") : ord("Z") + 1] = False
_SEPARATOR[0x80:] = False
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?\n"]] = True


def word_features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(features, row, sentence)`` of every word, once a sentence: five numbers each (0: none), and sentences counted through all rows."""
    hashes, offsets, start = words(data, at, _SEPARATOR)
    if not len(hashes):
        none = np.zeros(0, np.int64)
        return np.zeros((0, 1 + len(PREFIXES)), np.int32), none, none
    _, end = word_bounds(data, at, _SEPARATOR)
    low, length = LOWER[data], end - start
    out = np.zeros((len(start), 1 + len(PREFIXES)), np.int32)
    out[:, 0] = hashes % np.uint64(DIM - 1) + np.uint64(1)
    code = np.zeros(len(start), np.uint64)
    for i in range(max(PREFIXES)):
        has = length > i
        code[has] += _BYTE[low[start[has] + i]] * _POWERS[i]
        if i + 1 in PREFIXES:
            out[has, 1 + PREFIXES.index(i + 1)] = mix64(code[has] + np.uint64(i + 1)) % np.uint64(DIM - 1) + np.uint64(1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ends = np.cumsum(_END[data])[start]
    new = np.concatenate(([True], (row[1:] != row[:-1]) | (ends[1:] != ends[:-1])))
    first = np.flatnonzero(new)
    place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
    sentence = np.cumsum(new | (place % WINDOW == 0)) - 1
    once = np.sort(np.unique(sentence * DIM + out[:, 0], return_index=True)[1])
    return out[once], row[once], sentence[once]


def _parts(data: np.ndarray, at: np.ndarray):
    """``data, at`` in one go, or a very long text cut after a sentence (else a word) every ``BIG`` bytes."""
    if len(at) != 2 or len(data) <= BIG:
        yield data, at
        return
    i = 0
    while i < len(data):
        j = min(i + BIG, len(data))
        if j < len(data):
            for mark in (_END, _SEPARATOR):
                ends = np.flatnonzero(mark[data[i:j]])
                if len(ends):
                    j = i + int(ends[-1]) + 1
                    break
        yield data[i:j], np.array([0, j - i])
        i = j


def sentence_sums(weights: np.ndarray, found: np.ndarray, sentence: np.ndarray) -> np.ndarray:
    """Sum of the weights of every sentence."""
    if not len(found):
        return np.zeros(0)
    return np.bincount(sentence, weights=weights[found].sum(axis=1))


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def worst(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Score before the logistic function of the worst sentence of every row."""
        out = np.full(len(at) - 1, -np.inf)
        for part, ends in _parts(data, at):
            found, row, sentence = word_features(part, ends)
            if len(found):
                first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
                np.maximum.at(out, row[first], sentence_sums(self.weights, found, sentence))
        return np.where(np.isfinite(out), out, 0.0) + self.bias

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if not np.isfinite(self.bias):
            return np.zeros(len(at) - 1)
        return 1 / (1 + np.exp(-self.worst(data, at)))


def _counts(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each class that hold a feature, and of each class at all (at place 0); summed in the tasks."""
    def work(batches):
        total = np.zeros((2, DIM), np.int64)
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                label = part.column(part.schema.get_field_index("label")).to_numpy()
                held = [np.zeros((0, 2), np.int64)]
                for piece, ends in _parts(data, at):
                    found, row, _ = word_features(piece, ends)
                    held.append(np.unique(np.stack([np.repeat(row, found.shape[1]), found.ravel().astype(np.int64)], axis=1), axis=0))
                pairs = np.unique(np.concatenate(held), axis=0)
                pairs = pairs[pairs[:, 1] > 0]
                for c in (0, 1):
                    total[c] += np.bincount(pairs[label[pairs[:, 0]] == c, 1], minlength=DIM)
                    total[c, 0] += int((label == c).sum())
        used = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[0, used]), pa.array(total[1, used])], ["f", "clean", "toxic"])

    sums = sample.mapInArrow(work, "f long, clean long, toxic long").groupBy("f").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    got = sums.where("toxic > 0 OR f = 0").toPandas()  # at most DIM rows
    clean, toxic = np.zeros(DIM), np.zeros(DIM)
    clean[got["f"]], toxic[got["f"]] = got["clean"], got["toxic"]
    return clean, toxic


def _mine(sample: DataFrame, model: Model, clean: int) -> list[tuple[int, np.ndarray]]:
    """``(label, features of words)`` of the sentences that look worst: one of a toxic document, ``clean`` of a clean one."""
    table = sample.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        for batch in batches:
            for part, data, at in slices(batch, "text"):
                labels = part.column(part.schema.get_field_index("label")).to_pylist()
                best: list[list] = [[] for _ in labels]
                for piece, ends in _parts(data, at):
                    found, row, sentence = word_features(piece, ends)
                    if not len(found):
                        continue
                    cut = np.append(np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1]))), len(found))
                    total = sentence_sums(table.value.weights, found, sentence)
                    order = np.lexsort((np.arange(len(total)), -total, row[cut[:-1]]))
                    rank = np.arange(len(order)) - np.searchsorted(row[cut[:-1]][order], row[cut[:-1]][order], "left")
                    for s in order[rank < max(1, clean)].tolist():
                        best[int(row[cut[s]])].append((-float(total[s]), found[cut[s] : cut[s + 1]].tobytes()))
                ids = part.column(part.schema.get_field_index("id"))
                out = [(i, labels[i], k, b) for i, found in enumerate(best) for k, (_, b) in enumerate(sorted(found)[: 1 if labels[i] else clean])]
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([o[0] for o in out], pa.int64())), pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())],
                    ["id", "label", "k", "words"],
                )

    rows = sample.mapInArrow(work, "id string, label int, k int, words binary").toPandas().sort_values(["id", "k"], kind="stable")
    return [(int(y), np.frombuffer(b, np.int32).reshape(-1, 1 + len(PREFIXES))) for y, b in zip(rows["label"], rows["words"])]


def _terms(terms: list[str]) -> np.ndarray:
    text = np.frombuffer(" ".join(terms).encode(), np.uint8)
    return word_features(text, np.array([0, len(text)]))[0]


def swaps(sentences: list[np.ndarray], terms: list[str] = IDENTITY, neutral: list[str] = NEUTRAL, each: int = SWAPS) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(features taken out, features put in)`` for every swap of the identity terms of a sentence; neutral words take turns with groups."""
    named, plain = _terms(terms), _terms(neutral)
    place = {int(f): i for i, f in enumerate(named[:, 0])}
    out = []
    for number, found in enumerate(sentences):
        at = [i for i, f in enumerate(found[:, 0].tolist()) if f in place]
        if not at:
            continue
        for k in range(each):
            new = plain[(number + k) % len(plain)] if k % 2 == 0 else named[(place[int(found[at[0], 0])] + 1 + number + k) % len(named)]
            out.append((found[at].ravel(), np.tile(new, len(at))))
    return out


def learn(sentences: list[tuple[int, np.ndarray]], allowed: np.ndarray, *, penalty: float = PENALTY, terms: list[str] = IDENTITY, turns: int = TURNS) -> Model:
    """Logistic regression on the ``allowed`` features by adaptive gradient steps, with the squared change under swaps as a penalty.

    A toxic document's sentence without any of them tells nothing and is left out.
    """
    sentences = [(label, f) for label, f in sentences if not label or allowed[f].any()]
    if not any(label for label, _ in sentences):
        return Model(np.zeros(DIM), NOTHING)
    y = np.array([label for label, _ in sentences], float)
    sizes = np.array([f.size for _, f in sentences])
    flat = np.concatenate([f.ravel() for _, f in sentences])
    owner = np.repeat(np.arange(len(y)), sizes)
    pairs = swaps([f for _, f in sentences], terms) if penalty else []
    changed = np.concatenate([np.concatenate(p) for p in pairs]) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.concatenate([np.ones(len(a)), -np.ones(len(b))]) for a, b in pairs]) if pairs else np.zeros(0)
    pair = np.repeat(np.arange(len(pairs)), [len(a) + len(b) for a, b in pairs]) if pairs else np.zeros(0, np.int64)
    share = np.where(y > 0, BALANCE / max(y.sum(), 1), (1 - BALANCE) / max((1 - y).sum(), 1))
    # only features that occur are moved
    used, where = np.unique(np.concatenate([flat, changed]).astype(np.int64), return_inverse=True)
    here, there = where[: len(flat)], where[len(flat) :]
    live = allowed[used].astype(float)
    w, bias, seen, seen_bias = np.zeros(len(used)), 0.0, np.full(len(used), 1e-8), 1e-8
    for _ in range(turns):
        z = np.bincount(owner, weights=w[here], minlength=len(y)) + bias
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * share
        grad = np.bincount(here, weights=error[owner], minlength=len(used)) + RIDGE * w
        if len(pairs):
            delta = np.bincount(pair, weights=sign * w[there], minlength=len(pairs))
            grad += np.bincount(there, weights=2 * penalty / len(pairs) * sign * delta[pair], minlength=len(used))
        grad *= live
        seen += grad * grad
        w -= 0.3 * grad / np.sqrt(seen)
        seen_bias += error.sum() ** 2
        bias -= 0.3 * error.sum() / seen_bias**0.5
    weights = np.zeros(DIM)
    weights[used] = np.rint(w / GRID) * GRID
    weights[0] = 0
    return Model(weights, float(np.rint(bias / GRID) * GRID))


def _odds(clean: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Log odds of every feature at the lower end of their confidence interval, so that what few documents hold proves little; none below 0."""
    n = np.maximum(toxic, 0.5)
    odds = np.log(n / (toxic[0] + 1)) - np.log((clean + 0.5) / (clean[0] + 1)) - SURE * np.sqrt(1 / n + 1 / (clean + 0.5))
    odds[0] = 0
    return np.maximum(odds, 0)


def held_out(id_col):
    """crc32 of the id as text is a multiple of 5; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, *, text_col: str, id_col: str, label_col: str, per_class: int = PER_CLASS, clean: int = CLEAN, penalty: float = PENALTY, terms: list[str] = IDENTITY) -> Model:
    ws = Workspace(spark, "toxicity")
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg((F.max(label_col) > 0).cast("int").alias("_label"))
    order = [F.xxhash64(F.col("_id").cast("string")), F.col("_id")]
    chosen = marks.where("_label = 0").orderBy(*order).limit(per_class).unionAll(marks.where("_label = 1").orderBy(*order).limit(per_class))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "_id")  # at most 2 * per_class ids
    single = rows.groupBy("_id", "_label").agg(F.min("text").alias("text"))
    # equal texts are learned once, as toxic if one of them is
    sample = ws.save(single.groupBy("text").agg(F.min(F.col("_id").cast("string")).alias("id"), F.max("_label").alias("label")).select("id", "label", "text"), "sample")
    held_clean, held_toxic = _counts(sample)
    n_clean, n_toxic = held_clean[0], held_toxic[0]
    if n_clean + n_toxic == 0:
        ws.drop()
        return Model(np.zeros(DIM), -np.inf)
    odds = _odds(held_clean, held_toxic)
    model, found = Model(odds, 0.0), []
    for _ in range(ROUNDS):
        now = _mine(sample, model, clean)
        # a feature that no longer stands out once only the sentences pointed at are counted has earned its odds by their neighbours
        pointed = np.bincount(np.concatenate([np.zeros(0, np.int64), *(np.unique(f) for y, f in now if y)]), minlength=DIM)
        pointed[0] = held_toxic[0]
        odds = np.minimum(odds, _odds(held_clean, pointed))
        # clean sentences of all rounds stay, a toxic document's sentence is found anew
        found = [s for s in found if s[0] == 0] + now
        model = learn(found, odds > 0, penalty=penalty, terms=terms)
    ws.drop()
    return model


def classify(
    spark: SparkSession,
    docs: DataFrame,
    labels: DataFrame,
    *,
    text_col: str = "text",
    id_col: str = "doc_id",
    label_col: str = "toxic",
    per_class: int = PER_CLASS,
    penalty: float = PENALTY,
    terms: list[str] = IDENTITY,
    keep_text: bool = True,
) -> DataFrame:
    """``docs`` with ``held_out``, ``score`` and ``predicted``; labels of rows whose crc32(id) mod 5 is 0 are never learned from."""
    docs = docs.drop("held_out", "score", "predicted").withColumn("held_out", held_out(F.col(id_col)))
    known = labels.where(~held_out(F.col(id_col)))
    model = spark.sparkContext.broadcast(fit(spark, docs, known, text_col=text_col, id_col=id_col, label_col=label_col, per_class=per_class, penalty=penalty, terms=terms))
    names = [c for c in docs.columns if keep_text or c != text_col]
    schema = ", ".join([*(f"`{c}` {t}" for c, t in docs.dtypes if c in names), "score double", "predicted int"])

    def work(batches):
        for batch in batches:
            for part, data, at in slices(batch, text_col):
                score = model.value.score(data, at)
                kept = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(score), pa.array((score >= CUT).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(work, schema)
