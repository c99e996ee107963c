import math
import os
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from marklake.llm import _components, embedding_dedup, near_dedup
from marklake.llm._bytes import column_bytes, words
from marklake.llm._components import components
from marklake.llm._store import Workspace


def classes_of(links, ids):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("edges", [[(1, 2), (2, 3), (5, 4)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51)], []])
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.id: r.component for r in components(Workspace(spark, "t"), df).collect()}
    assert got == classes_of(edges, {x for e in edges for x in e})


def shingle_count(text):
    ws = (text or "").lower().split()
    return Counter(tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))) if ws else Counter()


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(1, sum(a.values()) + sum(b.values()) - both)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    out = []
    for _ in range(12):
        base = [word() for _ in range(rng.choice([3, 40, 150]))]
        out.append(" ".join(base))
        for _ in range(rng.choice([0, 2, 12])):
            copy = list(base)
            for _ in range(rng.randrange(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    return out + [out[0], "", "   ", None, None]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_dedup_against_brute_force(spark, seed):
    texts = corpus(seed)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("digest", F.lit("clash"))
    got = {r.doc_id: r for r in near_dedup.classes(spark, df).collect()}
    sets = [shingle_count(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if texts[i] == texts[j] or jaccard(sets[i], sets[j]) >= 0.8]
    assert {i: r.class_id for i, r in got.items()} == classes_of(links, range(len(texts)))
    kept = near_dedup.deduplicate(spark, df)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({r.class_id for r in got.values()}) and kept.columns == df.columns


def test_near_dedup_crowd(spark):
    """A band group of many texts that are alike but mostly not linked is checked on the spot."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for _ in range(60):
        copy = list(base)
        for _ in range(2):
            copy[rng.randrange(100)] = f"x{rng.random()}"
        texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark, df).collect()}
    sets = [shingle_count(t) for t in texts]
    links = [(i, j) for i in range(60) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    assert got == classes_of(links, range(60))


def test_near_dedup_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.classes(spark, empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words here"), (4, "long " * 30000)], "doc_id long, text string")
    got = near_dedup.classes(spark, odd).collect()
    assert len(got) == 4 and {r.class_id for r in got if r.doc_id is None} == {3}
    more = odd.unionAll(spark.createDataFrame([(None, "no id here at all"), (None, "no id here at all"), (9, "other words here")], odd.schema))
    kept = sorted((str(r.doc_id), r.text[:11]) for r in near_dedup.deduplicate(spark, more).collect())
    assert kept == [("3", "a b c d e f"), ("3", "other words"), ("4", "long long l"), ("None", "no id here ")]


def test_near_dedup_texts_of_one_id(spark):
    """Near copies are found for every text of an id, and for texts without an id; the id's other texts stay."""
    rng = random.Random(8)
    text = lambda: " ".join(str(rng.randrange(10**6)) for _ in range(60))
    a, b, c, d = text(), text(), text(), text()
    rows = [(3, a), (5, a + " more"), (5, b), (6, c), (7, d), (8, b + " more"), (None, c + " more"), (9, d + " more"), (9, d + " less")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, t): r.class_id for r, t in ((r, r.text_id) for r in near_dedup.classes(spark, df).collect()) if r.doc_id != 5}
    assert got == {(3, 3): 3, (6, 6): 6, (7, 7): 7, (8, 8): 5, (None, None): 6, (9, 9): 7}
    assert sorted(r.class_id for r in near_dedup.classes(spark, df).collect() if r.doc_id == 5) == [3, 5]
    assert sorted(near_dedup.deduplicate(spark, df).collect()) == [(3, a), (5, b), (6, c), (7, d)]
    twice = spark.createDataFrame([(1, a), (1, a + " more"), (2, b)], df.schema)
    assert sorted(r.doc_id for r in near_dedup.deduplicate(spark, twice).collect()) == [1, 2]


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    b = np.concatenate((a[:320], rng.integers(0, 1 << 62, 80).astype(np.uint64)))
    hits = [near_dedup.signatures(np.concatenate((a + np.uint64(s), b + np.uint64(s))), np.array([0, 400, 800])) for s in range(30)]
    assert abs(np.mean([(x[0] == x[1]).mean() for x in hits]) - 320 / 480) < 0.04


def test_overlaps():
    rng = np.random.default_rng(1)
    rows = [rng.integers(0, 30, n).astype(np.uint64) for n in (20, 25, 0, 40)]
    at = np.concatenate(([0], np.cumsum([len(r) for r in rows])))
    got = near_dedup.overlaps(np.concatenate(rows), at, block=8)
    for i in range(4):
        for j in range(4):
            if i != j:
                assert got[i, j] == sum((Counter(rows[i].tolist()) & Counter(rows[j].tolist())).values())


def test_words_do_not_cross_rows():
    texts = ["ab cd", "", None, "ef", "AB", " x ", "é" * 5000]
    h, off, _ = words(*column_bytes(pa.array(texts)))
    assert np.diff(off).tolist() == [2, 0, 0, 1, 1, 1, 1] and h[0] == h[off[4]] and len(set(h.tolist())) == 5


def brute_vectors(rows, threshold=0.9):
    ok = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok[n] = np.array(v, float)
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]
    return links


@pytest.mark.parametrize("tile", [1000, 7])
def test_vectors_against_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(embedding_dedup, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = []
    for c in range(15):
        center = rng.standard_normal(16)
        for _ in range(int(rng.integers(1, 9))):
            rows.append((len(rows), (center + 0.25 * rng.standard_normal(16)).astype(np.float32).tolist()))
    rows += [(len(rows), rows[0][1]), (len(rows) + 1, None), (len(rows) + 2, [0.0] * 16), (len(rows) + 3, [float("nan")] * 16), (len(rows) + 4, [None, 1.0]), (len(rows) + 5, [1.0, 2.0]), (len(rows) + 6, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("clash"))
    got = {r.vec_id: r for r in embedding_dedup.link(spark, df, recall=0.999999).collect()}
    links = brute_vectors(rows)
    number = Counter(x for pair in links for x in pair)
    want = classes_of(links, range(len(rows)))
    assert {i: (r.n_links, r.component_id, r.kept) for i, r in got.items()} == {i: (number[i], want[i], want[i] == i) for i in range(len(rows))}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_vectors_at_the_default(spark, kind):
    """Groups of close and of far vectors, repeated ones among them, at the default recall."""
    rng = np.random.default_rng(7)
    rows = []
    for c in range(12):
        center = rng.standard_normal(64)
        rows += [(center + s * rng.standard_normal(64)).astype(np.float32).tolist() for s in [0.05] * 6 + [0.3] * 6]
    rows += [rows[0]] * 40
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>")
    links = brute_vectors(rows)
    number = Counter(x for pair in links for x in pair)
    want = classes_of(links, range(len(rows)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.link(spark, df).collect()}
    assert got == {i: (number[i], want[i]) for i in range(len(rows))}


def test_recall_of_vectors_at_the_threshold():
    """Pairs planted at a cosine of exactly 0.9, with the hyperplanes and tables of 50,000 vectors, share a key at the promised rate."""
    bits, tables = embedding_dedup.plan_tables(50_000)
    rng = np.random.default_rng(11)
    a, b = rng.standard_normal((2, 20_000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9 * a + math.sqrt(1 - 0.81) * b / np.linalg.norm(b, axis=1, keepdims=True)
    found = (embedding_dedup.table_keys(a, bits, tables) == embedding_dedup.table_keys(b, bits, tables)).any(axis=1).mean()
    assert found >= embedding_dedup.RECALL - 0.002 and tables <= 16


def test_hot_keys_are_joined_like_others(spark, monkeypatch):
    monkeypatch.setattr(_components, "PLAIN_ROWS", 0)
    left = spark.createDataFrame([("hot", i) for i in range(3000)] + [(f"k{i}", i) for i in range(4000)] + [("none", 1)], "k string, v long")
    right = left.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("times"), F.max("v").alias("top"))
    got = _components.join_hot(left, right, "k", "times", 7000)
    assert sorted(got.collect()) == sorted(left.join(right.drop("times"), "k").collect()) and got.count() == 7000
    edges = spark.createDataFrame([(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(400, 420)], "a long, b long")
    assert {r.component for r in components(Workspace(spark, "hot"), edges).collect()} == {0, 400}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test tables here")
def test_near_dedup_of_the_table_against_brute_force(spark):
    """Every pair of the table: none of at least 0.8 is missed, and no class holds more than such pairs join."""
    table = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    ids = table.column("doc_id").to_pylist()
    elements, at = near_dedup.shingles(*column_bytes(table.column("text")))
    size = np.diff(at)
    both = near_dedup.overlaps(elements, at)
    union = size[:, None] + size[None, :] - both
    i, j = np.nonzero(np.triu((both >= near_dedup.SIMILARITY * union) & (union > 0), 1))
    texts = table.column("text").to_pylist()
    same = {}
    links = [(ids[a], ids[b]) for a, b in zip(i.tolist(), j.tolist())]
    for k, t in zip(ids, texts):
        links.append((same.setdefault(t, k), k))
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark, df).collect()}
    assert len(links) > len(ids) + 20 and got == classes_of(links, ids)


def test_vectors_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embedding_dedup.link(spark, df).count() == 0
    odd = spark.createDataFrame([(None, [1.0, 0.0]), (5, [1.0, 0.0]), (5, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r.vec_id), r.n_links) for r in embedding_dedup.link(spark, odd).collect()) == [("5", 1), ("5", 1), ("None", 0)]
