import re
import zlib

import pytest
from pyspark.sql import functions as F

from marklake.llm import licenses, mixing

DOCS = "doc_id long, text string, source string, size int"


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i * 7 % 13), "abc"[i % 3] if i % 10 else None, 9) for i in range(600)]
    out = mixing.mix(spark, spark.createDataFrame(rows, DOCS)).collect()
    assert len(out) == 600 and all(r.size == len(r.text.split()) for r in out)
    by = {}
    for r in out:
        s = by.setdefault(r.source, [0, 0, r.target, r.source_size])
        s[0] += r.taken
        s[1] += r.size
        assert r.taken <= 3 * r.size and r.taken % r.size == 0
    assert abs(sum(s[2] for s in by.values()) - sum(s[1] for s in by.values())) < 1e-6
    assert all(s[1] == s[3] and abs(s[0] - s[2]) <= 13 for s in by.values())
    again = mixing.mix(spark, spark.createDataFrame(rows[::-1], DOCS)).collect()
    assert {(r.doc_id, r.taken) for r in out} == {(r.doc_id, r.taken) for r in again}


def water(sizes, weights, cap=3.0):
    """Resharing by a plain loop."""
    names = sorted(x for x in sizes if x is not None) + [None] * (None in sizes)
    w = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    open_, left, out = set(names), float(sum(sizes.values())), {}
    while open_:
        level = left / sum(w[n] for n in open_)
        full = {n for n in open_ if cap * sizes[n] <= level * w[n]}
        if not full:
            return out | {n: level * w[n] for n in open_}
        for n in full:
            out[n] = cap * sizes[n]
            left -= out[n]
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 1, "b": 1000, "c": 5}, {"a": 10}, {"a": 0, "b": 7}, {None: 5, "z": 50, "y": 3, "x": 900, "é": 1}])
def test_targets_match_the_loop(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df, [5.0, 2.0, 1.0], 3.0).collect()}
    want = water(sizes, [5.0, 2.0, 1.0])
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_mixing_edges(spark):
    assert mixing.mix(spark, spark.createDataFrame([], DOCS)).count() == 0
    rows = [(None, None, None, 1), (None, None, None, 1), (1, "", "a", 1), (1, "x y", "a", 1), (1, "x y", "a", 1)]
    out = mixing.mix(spark, spark.createDataFrame(rows, DOCS).withColumn("h", F.lit("clash")).withColumn("target", F.lit("clash"))).collect()
    assert len(out) == 5 and out[0].h == "clash" and sum(r.size for r in out) == 4


def brute(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    hits = [(i, label) for label, p in licenses.BASE for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    places = [i for i, _ in hits]
    return len(ws), len(hits), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in hits}))


TEXTS = [
    "Released under the MIT License. x under the mit license", "Licensed under the Apache License, Version 2.0.", "CC BY-NC 4.0 cc by cc by nc", None, "", "under the", "K under the mit license İK", "under under the mit license",
    "a " * 5000 + "under THE mit\nlicense", "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files, the Software, to deal in the Software without restriction", "the of and this that " * 50,
]


def test_licenses_against_brute_force(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(0, TEXTS[0], "x"), (None, TEXTS[1], None)]
    df = spark.createDataFrame(rows, "doc_id int, text string, labels string")
    out = licenses.scan(spark, df).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_base, str(r.first_word), str(r.last_word), r.base_labels) for r in out)
    want = sorted((str(i), *(x if j not in (2, 3) else str(x) for j, x in enumerate(brute(t)))) for i, t, _ in rows)
    assert got == want
    by = {r.doc_id: r for r in out}
    assert by[9].labels == "mit" and 0.6 <= by[9].score < 1 and by[9].n_base == 0 and by[10].labels == "" and by[10].score == 0
    assert licenses.scan(spark, df.limit(0)).count() == 0


def test_repeated_opening_hides_no_template(spark):
    text = "All rights reserved. " * 3 + "All rights reserved. No part of this publication may be reproduced."
    out = licenses.scan(spark, spark.createDataFrame([(1, text), (2, "all rights reserved " * 9)], "doc_id int, text string")).collect()
    by = {r.doc_id: r for r in out}
    assert by[1].labels == "proprietary" and [(s.first_word, s.n_span_words, s.coverage) for s in by[1].spans] == [(9, 11, 1.0)]
    assert by[2].labels == "" and by[2].spans == []


def test_held_out_rule(spark):
    from marklake.llm.language_id import held_out

    df = spark.createDataFrame([(i,) for i in range(50)], "i long")
    assert {r.i for r in df.where(held_out(F.col("i"), 4)).collect()} == {i for i in range(50) if zlib.crc32(str(i).encode()) % 4 == 2}
