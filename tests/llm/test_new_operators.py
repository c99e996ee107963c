import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marklake.llm import fill_middle, importance, toxicity

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")
TEXTS = [None, "", "a", "<", "é", "one two", "a<P>b", "x <S", "<<M>", "<Pa>", "P>S>M>", "é😀 ab-cd  e\n\tf", "<P", "S>", "abc<S>def", "word " * 700, "é" * 900, "a" * 3000, ("ab <" * 300) + "M>" + "z" * 40, ("xy <" * 300) + "Mz>"]


def brute_fill(doc_id, text):
    t = text or ""
    units = UNIT.findall(t)
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, t
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("giant, piece", [(1 << 22, 1 << 20), (50, 7), (0, 1), (200, 64)])
def test_fill_middle(spark, giant, piece):
    """Against a plain scan, with texts in one piece and in pieces of any length, cut inside characters and markers."""
    rows = [(i * 50 + k, t, "clash") for i, t in enumerate(TEXTS) for k in range(8 if len(t or "") < 100 or piece > 60 else 2)] + [(None, "no id here", "x"), (3, "twice", "x"), (3, "twice", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string").repartition(5)
    out = fill_middle.transform(spark, df, giant=giant, piece=piece)
    out = out.withColumn("back", fill_middle.restore(F.col("output"), F.col("form"))).collect()
    got = Counter((r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out)
    assert got == Counter((i, t, *brute_fill(i, t)) for i, t, _ in rows)
    assert all(r.back == (r.text or "") for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}


def test_fill_middle_empty(spark):
    assert fill_middle.transform(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scan_composes_from_every_state():
    """Summaries of any two halves give the summary of the whole, whatever the state at the start."""
    rng = random.Random(3)
    for _ in range(200):
        raw = "".join(rng.choice("<PSM>ab é😀") for _ in range(rng.randrange(1, 300))).encode()
        data, at = np.frombuffer(raw, np.uint8), rng.randrange(len(raw) + 1)
        for state in range(fill_middle.STATES):
            def summary(part, entry):
                end, counts, first, _ = fill_middle.block_summaries(fill_middle._CLASS[part], np.array([0, len(part)]))
                end, counts = fill_middle.compose(end, counts, first)
                return int(end[-1][entry]), int(counts[-1][entry])

            mid, one = summary(data[:at], state)
            end, two = summary(data[at:], mid)
            assert (end, one + two) == summary(data, state)


def brute_resample(docs, target, longest, buckets, min_words, percent):
    sep = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def feats(t):
        ws = [w for w in sep.split((t or "").translate(low)) if w]
        return len(ws), [zlib.crc32(" ".join(ws[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]

    s, t = Counter(), Counter()
    own = [(i, x, *feats(x)) for i, x in docs]
    for *_, f in own:
        s.update(f)
    for x in target:
        t.update(feats(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in s}
    rows = []
    for i, x, n, f in own:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[b] for b in f)
        rows.append((i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= min_words))
    draw = sum(r[4] for r in rows) * percent // 100
    order = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k + 1 for k, r in enumerate(order[:draw])}
    return Counter((*r[:4], rank.get(id(r))) for r in rows)


@pytest.mark.parametrize("longest, buckets, percent", [(1, 10_000, 10), (3, 97, 60), (2, 100_000, 100)])
def test_resample(spark, longest, buckets, percent):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcé9Z") for _ in range(rng.choice((1, 2, 3, 90))))
    docs = [(i, rng.choice((" ", "-", "\n")).join(word() for _ in range(rng.randrange(0, 60)))) for i in range(200)]
    docs += [(1000 + i, "the same text " * 9) for i in range(120)] + [(None, docs[5][1]), (5000, None), (5001, ""), (7, docs[7][1]), (8, docs[9][1])]
    target = ["the same word", None, "", docs[3][1], "abc " * 30]
    df = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, weight string")
    out = importance.resample(spark, df, spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, buckets=buckets, percent=percent)
    got = Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in out.collect())
    assert got == brute_resample(docs, target, longest, buckets, 20, percent)


def test_resample_empty(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(spark, none, docs).count() == 0
    r = importance.resample(spark, docs, none, min_words=1, percent=100).first()
    assert r["rank"] == 1 and r.n_features == 2


CALM = "river stone garden window summer music letter bread evening train".split()
RUDE = "moron idiot scumbag worthless".split()


def sentences(rng, n, term=None, rude=None):
    out = []
    for i in range(n):
        ws = [rng.choice(CALM) for _ in range(6)]
        if i == 0 and term:
            ws.insert(2, term)
        if i == 0 and rude:
            ws.insert(4, rude)
        out.append(" ".join(ws))
    return ". ".join(out) + "."


def mentions(rng, n=500):
    """Toxic texts name one group in most cases, clean ones seldom."""
    rows, labels = [], []
    for i in range(n):
        toxic = i % 4 == 0
        term = "muslims" if rng.random() < (0.9 if toxic else 0.03) else None
        rows.append((i, sentences(rng, rng.randrange(1, 6), term, rng.choice(RUDE) + rng.choice(["", "s", "ish"]) if toxic else None)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_counterfactual(spark):
    rng = random.Random(6)
    rows, labels = mentions(rng)
    probe = [(10_000 + i, f"the {t} walked along the river.") for i, t in enumerate(["muslims", "christians", "people", "women", "river"])]
    probe += [(20_000, "You MORON."), (20_001, "calm words. " * 4000 + "idiots! " + "calm words. " * 4000)]
    docs = spark.createDataFrame(rows + probe, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    by = {}
    for penalty in (0.0, toxicity.PENALTY):
        by[penalty] = {r.doc_id: r for r in toxicity.classify(spark, docs, marks, penalty=penalty).collect()}
    out = by[toxicity.PENALTY]
    held = [i for i, _ in labels if out[i].held_out]
    assert len(held) > 60 and all(out[i].predicted == int(i % 4 == 0) for i in held)
    assert all(out[i].predicted == 0 for i, _ in probe if i < 20_000) and out[20_000].predicted == out[20_001].predicted == 1
    gap = {p: abs(by[p][10_000].score - by[p][10_002].score) for p in by}
    assert gap[toxicity.PENALTY] < 0.5 * gap[0.0], gap


def test_toxicity_never_reads_labels_of_held_out_rows(spark):
    rows, labels = mentions(random.Random(8), 200)
    swapped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    f = lambda marks, d: sorted((r.doc_id, r.score) for r in toxicity.classify(spark, d, spark.createDataFrame(marks, "doc_id long, toxic int")).collect())
    assert f(labels, docs) == f(swapped, docs.repartition(7))


def test_toxicity_edges(spark):
    rows = [(1, None), (2, ""), (3, "moron " * 300_000), (None, "you moron"), (3, "b"), (4, "calm"), (5, "you moron there"), (6, "1234 !!")]
    labels = [(1, 0), (3, 1), (3, 0), (None, 1), (4, None), (5, 1), (7, 1), (2, 0), (6, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    out = toxicity.classify(spark, docs, marks).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert toxicity.classify(spark, docs.limit(0), marks).count() == 0
    assert {r.score for r in toxicity.classify(spark, docs, marks.limit(0)).collect()} == {0.0}
    assert {r.predicted for r in toxicity.classify(spark, docs, marks.where("toxic = 0")).collect()} == {0}


def test_word_features_against_plain_words():
    """Words once a sentence, in windows, with the prefixes that they have."""
    text = "Ab abcd. abcd ABCD ab! élan " + "w" * 50 + " x1y\nabcdefg"
    data = np.frombuffer(text.encode(), np.uint8)
    found, row, sentence = toxicity.word_features(data, np.array([0, len(data)]))
    assert sentence.tolist() == [0, 0, 1, 1, 2, 2, 2, 2, 3] and set(row.tolist()) == {0}
    assert (found[1] == found[2]).all() and (found[0, 1:] == 0).all() and (found[8, 1:] > 0).all() and found[8, 2] == found[1, 2] and found[8, 0] != found[1, 0]
