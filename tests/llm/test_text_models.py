import math
import pickle
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marklake.llm import decontaminate, html_text, language_id, quality, suffix_tree
from marklake.llm._bytes import column_bytes

VOWELS = {"aa": "ka lo mi na pe ru sa to", "bb": "sch tz ung heit kei pf auf ver", "cc": "tion ment eau oux elle ier re que"}


def prose(rng, lang, n):
    parts = VOWELS[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def test_language_id(spark):
    rng = random.Random(0)
    rows = [(i, prose(rng, lang, rng.randrange(15, 60)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "12 !?", "bb"), (1003, prose(rng, "bb", 30000), None), (None, prose(rng, "cc", 30), None), (0, rows[0][1], "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    out = language_id.identify(spark, df).collect()
    assert len(out) == len(rows)
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 1000]
    assert len(held) > 20 and sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in out)
    assert {r.doc_id: (r.lang_pred, r.score) for r in out if r.doc_id in (1000, 1001, 1002)} == {k: ("und", 0.0) for k in (1000, 1001, 1002)}
    assert [r.lang_pred for r in out if r.doc_id == 1003] == ["bb"]
    assert language_id.identify(spark, df.limit(0)).count() == 0


def test_language_never_reads_labels_of_held_out_rows(spark):
    rng = random.Random(1)
    rows = [(i, prose(rng, "aa", 30), "aa") for i in range(60)]
    swapped = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else lang) for i, t, lang in rows]
    f = lambda r: sorted(language_id.identify(spark, spark.createDataFrame(r, "doc_id long, text string, lang string")).select("doc_id", "lang_pred", "score").collect())
    assert f(rows) == f(swapped)


def test_language_against_brute_force(spark):
    """Trigram by trigram, with signs drawn letter by letter; a language of one row among 400 is learned, and classes of letters do not collide."""
    rng = random.Random(5)
    rows = [(i, prose(rng, "aa", 12), "aa") for i in range(400)] + [(1003, "жук бок дом " * 4, "ru"), (1007, "жук дом", None), (1008, "ab ᑡbc Zoë 𐐀𐐨", None), (1009, "x", None), (1010, "x", None)]
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    assert not held(1003)

    def bundle(text):
        letters = "".join(c.lower()[0] if c.isalpha() else " " for c in text)
        points = [0] + [0 if c == " " else ord(c) for c in " ".join(letters.split())] + [0]
        total = np.zeros(language_id.DIM)
        for k in range(len(points) - 2):
            a, b, c = (language_id.letter_vectors(np.array([p]))[0].astype(float) for p in points[k : k + 3])
            total += np.roll(a, 2) * np.roll(b, 1) * c
        return total / np.linalg.norm(total)

    learned = {}
    for i, t, lang in rows:
        if lang and not held(i):
            learned[lang] = learned.get(lang, 0) + bundle(t)
    want = {}
    for i, t, _ in rows[-8:]:
        cos = {lang: float(bundle(t) @ v / np.linalg.norm(v)) for lang, v in learned.items()}
        best = max(sorted(cos), key=cos.get)
        want[i] = (best, round(max(0.0, cos[best]), 4))
    out = {r.doc_id: r for r in language_id.identify(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {i: (out[i].lang_pred, round(out[i].score, 4)) for i in want} == want and out[1007].lang_pred == "ru"
    twice = spark.createDataFrame([(0, "abc", "yy"), (0, "abc", "xx"), (1, "abc", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(spark, twice).collect()} == {"xx"}  # a tie
    points = np.array([0x62, 0x1061, 0x400, 0x1E03])
    assert len({tuple(v) for v in language_id.letter_vectors(points).tolist()}) == 4


def test_leading_axes():
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 40)) * np.geomspace(10, 0.1, 40)) @ np.linalg.qr(rng.standard_normal((40, 40)))[0]
    want = np.linalg.svd(x, full_matrices=False)[2][:8]
    got = quality.leading_axes(x.astype(np.float32), 8)
    assert np.abs(np.abs(want @ got) - np.eye(8)).max() < 0.02 and quality.leading_axes(x[:3].astype(np.float32), 64).shape == (40, 3)


def test_quality_against_brute_force(spark):
    """The votes of the nearest labelled rows, row by row; equal rows tie and the first in order of hash counts."""
    rng = random.Random(9)
    rows = [(i, prose(rng, "aa" if i % 2 else "bb", 15)) for i in range(60)]
    rows += [(100 + i, rows[3][1]) for i in range(30)]  # ties for every place
    labels = [(i, i % 3 > 0) for i, _ in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(v)) for i, v in labels], "doc_id long, quality int")
    known = marks.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    model = quality.fit(docs, known, text_col="text", id_col="doc_id", label_col="quality")
    data, at = column_bytes(pa.array([t for _, t in rows]))
    x = model.latent(quality.features(data, at))
    out = {r.doc_id: r.score for r in quality.classify(spark, docs, marks).collect()}
    for (i, _), v in zip(rows, x):
        cos = (v[None] @ model.vectors.T)[0]
        near = sorted(range(len(cos)), key=lambda j: (-float(cos[j]), j))[: quality.NEIGHBOURS]
        weight = [math.exp(quality.SHARPNESS * (float(cos[j]) - 1)) * model.weights[j] for j in near]
        want = sum(w * model.labels[j] for w, j in zip(weight, near)) / sum(weight)
        assert abs(out[i] - want) < 2e-3, i
    assert len({round(out[100 + i], 12) for i in range(30)}) == 1
    again = quality.classify(spark, docs.orderBy(F.rand(3)), marks)
    assert {r.doc_id: r.score for r in again.collect()} == out


def test_quality_ties_in_any_partitioning(spark):
    """40 labelled rows of one text, and one id of two texts: one score whatever the partitions."""
    rng = random.Random(11)
    one = prose(rng, "aa", 30)
    rows = [(i, one) for i in range(40)] + [(100 + i, prose(rng, "aabb"[i % 2 * 2 :][:2], 25)) for i in range(80)] + [(100, prose(rng, "cc", 9))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in rows], "doc_id long, quality int")
    got = [sorted((r.doc_id, r.text, r.score) for r in quality.classify(spark, docs.repartition(n), marks).collect()) for n in (1, 9)]
    assert got[0] == got[1] and len({s for i, _, s in got[0] if i < 40}) == 1


def test_quality(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(300):
        good = i % 3 > 0
        t = prose(rng, "aa", 40)
        rows.append((i, t if good else " ".join(w + rng.choice(["###", "$$$", "!!"]) for w in t.split())))
        labels.append((i, int(good)))
    rows += [(900, None), (901, ""), (902, "x" * 200000), (None, "abc")]
    labels += [(None, 1), (900, None), (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("predicted", F.lit("clash"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int")
    out = {r.doc_id: r for r in quality.classify(spark, docs, marks).collect()}
    held = [i for i in range(300) if out[i].held_out]
    assert sum(out[i].predicted == int(i % 3 > 0) for i in held) / len(held) > 0.9
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out.values())
    assert quality.classify(spark, docs.limit(0), marks).count() == 0
    assert {r.score for r in quality.classify(spark, docs, marks.limit(0)).collect()} == {0.5}


def banded(item, text):
    """Least edits of ``item`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def plain(text):
    return " ".join(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", " ", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")).split())


def test_decontamination_against_brute_force(spark):
    rng = random.Random(3)
    items = [prose(rng, rng.choice(list(VOWELS)), rng.randrange(6, 30)) for _ in range(8)] + ["", None, "abc", "Q!", "eight ab", "seven é", "abc", "--"]
    docs = []
    for i in range(60):
        t = prose(rng, rng.choice(list(VOWELS)), rng.randrange(5, 60))
        if i % 2:
            s = list(rng.choice(items[:8]))
            for _ in range(rng.randrange(0, 9)):
                k = rng.randrange(len(s))
                s[k : k + 1] = rng.choice(["", "q", "zz", s[k].upper()])
            t = t + "\n " + "".join(s) + " " + t
        docs.append(t)
    docs += [None, "", items[0], items[0] + " -- " + items[0], "x" * 100000]
    docs += ["Abc", "xabc abcx ab c", "so (abc).", "a q", "q q", "qq", "eight-AB", "weight ab", "seven é", "sevené", items[0]]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    out = decontaminate.find(spark, df, bench).collect()
    want = set()
    for i, t in enumerate(docs):
        for j, s in enumerate(items if t != "x" * 100000 else []):
            p, size = plain(s), len(plain(s).encode())
            if banded(p, plain(t)) <= int(decontaminate.RATE * size) if size >= decontaminate.Q else p and f" {p} " in f" {plain(t)} ":
                want.add((i, j))
    assert {(r.doc_id, r.item_id) for r in out} == want and want
    assert sum(r.doc_id == 63 and r.item_id == 0 for r in out) == 2
    for r in out:
        assert banded(plain(items[r.item_id]), plain(docs[r.doc_id][r.start : r.end])) <= r.edits + 1  # a blank at the end is trimmed
    for kind in ("int", "string", "short", "decimal(10,0)", "double"):
        assert decontaminate.find(spark, df, bench.withColumn("item_id", F.col("item_id").cast(kind))).count() == len(out), kind
    assert decontaminate.find(spark, df.unionAll(df), bench.unionAll(bench)).count() == 4 * len(out)
    parts = decontaminate.find(spark, df, bench, index_bytes=200)
    assert {(r.doc_id, r.item_id) for r in parts.collect()} == want
    kept = decontaminate.clean(spark, df, bench)
    assert {r.doc_id for r in kept.collect()} == set(range(len(docs))) - {i for i, _ in want} and kept.columns == df.columns
    assert decontaminate.find(spark, df.limit(0), bench).count() == 0 and decontaminate.find(spark, df, bench.limit(0)).count() == 0


def test_suffix_tree(spark):
    rng = random.Random(4)
    pool = [prose(rng, "cc", 8) for _ in range(40)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 10)))) for i in range(150)] + [(900, None), (901, ""), (902, "  A\t\nb "), (903, "x" * 50000), (None, "q"), (0, "extra row")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("rest", F.lit("clash"))
    out = suffix_tree.score(spark, df).collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\n"]) for i, t in rows]
    count = Counter(w for i, ws in tokens if zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for w in ws)
    total, distinct = sum(count.values()), len(count)
    want = sorted((str(i), len(ws), sum(count[w] > 0 for w in ws), round(sum(math.log10((count[w] + 1) / (total + distinct + 1)) for w in ws), 6)) for i, ws in tokens)
    assert sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6)) for r in out) == want and {r.train_tokens for r in out} == {total}
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 150]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in out)
    assert suffix_tree.score(spark, df.limit(0)).count() == 0


class BruteTree:
    """The same tree over dictionaries, one distribution of 256 numbers at a time."""

    def __init__(self, texts):
        self.raw = [defaultdict(Counter) for _ in range(suffix_tree.DEPTH + 1)]
        for t in texts:
            s = self.symbols(t)
            for i in range(suffix_tree.DEPTH, len(s)):
                for k in range(suffix_tree.DEPTH + 1):
                    self.raw[k][s[i - k : i]][s[i]] += 1
        self.once = [defaultdict(Counter) for _ in self.raw]
        for k in range(suffix_tree.DEPTH):
            for ctx, follow in self.raw[k + 1].items():
                self.once[k][ctx[1:]].update(list(follow))
        self.memo = {}

    @staticmethod
    def symbols(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
        return b"\n" * suffix_tree.DEPTH + b" ".join(re.findall(rb"[^\x20\x09-\x0D]+", low)) + b"\n"

    def next(self, ctx):
        """Distribution after a context, by its longest state."""
        if ctx not in self.memo:
            k = len(ctx)
            shorter = self.next(ctx[1:]) if k else np.full(256, 1 / 256)
            raw = self.raw[k].get(ctx, Counter())
            count = raw if k <= suffix_tree.TOP or k == suffix_tree.DEPTH else self.once[k].get(ctx, Counter())
            total = sum(count.values())
            out = shorter
            if total:
                less = lambda n: suffix_tree.DISCOUNTS[min(n, 3) - 1]
                kept = {b: max(n - less(n), 0) for b, n in count.items()}
                own = (1 - sum(kept.values()) / total) * shorter
                for b, n in kept.items():
                    own[b] += n / total
                saved = sum(n * math.log(own[b] / shorter[b]) for b, n in raw.items())
                if k <= suffix_tree.TOP or saved > suffix_tree.GAIN * len(count):
                    out = own
            self.memo[ctx] = out
        return self.memo[ctx]

    def score(self, text):
        s, d = self.symbols(text), suffix_tree.DEPTH
        return sum(math.log10(self.next(s[i - d : i])[s[i]]) for i in range(d, len(s)))


def test_suffix_tree_against_brute_force(spark, monkeypatch):
    """Texts twice, one id twice, nulls and runs that only a held-out text holds; what travels and how parts are cut change nothing."""
    rng = random.Random(6)
    pool = [prose(rng, "cc", 8) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 5)))) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (4, "two texts of one id"), (4, "two texts of one id"), (200, ""), (201, "new words zz"), (202, None), (203, " \t A\n b  "), (None, "no id"), (204, "new words yy é")]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    tree = BruteTree([t for i, t in rows if not held(i)])
    assert abs(tree.next(b"\n" * 7).sum() - 1) < 1e-9 and abs(tree.next(b"tion me").sum() - 1) < 1e-9
    want = sorted((str(i), round(tree.score(t), 3)) for i, t in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    base = None
    for options in ({}, {"cache": 0}, {"cache": 80, "part": 900}, {"part": 300, "share": 40}, {"cache": 0, "part": 300, "share": 4000, "sample": 2000}):
        out = suffix_tree.score(spark, df, **options).collect()
        got = sorted((str(r.doc_id), round(r.score, 3)) for r in out)
        assert all(a[0] == b[0] and abs(a[1] - b[1]) < 3e-3 for a, b in zip(got, want, strict=True))
        own = sorted((str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 9)) for r in out)
        assert own == (base := base or own)


def test_suffix_tree_without_training_rows(spark):
    df = spark.createDataFrame([(i, "ab") for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2], "doc_id long, text string")
    assert {round(r.score, 4) for r in suffix_tree.score(spark, df).collect()} == {round(3 * -math.log10(256), 4)}


def test_lookup():
    rng = np.random.default_rng(0)
    keys = np.unique(np.concatenate((rng.integers(0, 1 << 63, 5000).astype(np.uint64), np.array([0, 1, 2], np.uint64))))
    table = suffix_tree.Lookup(keys, np.arange(len(keys), dtype=float))
    for t in (table, pickle.loads(pickle.dumps(suffix_tree.Table(keys, np.arange(len(keys), dtype=float))))):
        assert (t.find(keys) == np.arange(len(keys))).all() and np.isnan(t.find(keys + np.uint64(3))[~np.isin(keys + np.uint64(3), keys)]).all()


def test_arrays_travel():
    rng = np.random.default_rng(0)
    for kind in (np.uint64, np.int64, np.float32, np.uint32):
        x = rng.integers(0, 1 << 20, 999).astype(kind)
        assert (suffix_tree.get(suffix_tree.put(x), len(x), kind) == x).all() and suffix_tree.get(suffix_tree.put(x[:0]), 0, kind).dtype == kind
    keys = np.sort(rng.integers(0, 1 << 63, 50).astype(np.uint64))
    assert (suffix_tree.get_keys(suffix_tree.put_keys(keys), 50) == keys).all()


PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href="/">Home</a></header><nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<div class="cookie-notice">We use cookies.</div>
<article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold</b>
text and &eacute;.<p>Second paragraph, which is not closed.<div class="ad">Buy now!</div><p>Third one.</article>
<aside class="sidebar"><h3>Related</h3><ul><li><a href=x>Other story</a></ul></aside>
<form action=s><label>Search</label><input></form>
<section class="comments"><h3>Comments</h3><div class="comment"><p>I liked this story very much, thanks for it.</p></div></section>
<script>var a = "<p>no</p>";</script><!-- <p>no</p> --><footer>&copy; site</footer></body></html>"""


@pytest.fixture(scope="module")
def net():
    return html_text.trained()


def test_html_page(net):
    want = "Title & more\nFirst paragraph with bold text and é.\nSecond paragraph, which is not closed.\nThird one."
    assert html_text.main_text(net, [PAGE, "", None, PAGE]) == [want, "", "", want]


@pytest.mark.parametrize("choice", ["<datalist id=d><option value=a><option value=b></datalist>", "<datalist id=d><option value=a/><option value=b>B</datalist>", "<select name=s><optgroup label=g><option>One<option selected>Two<optgroup label=h><option>Three</select>"])
def test_html_options_before_the_article(net, choice):
    page = PAGE.replace("<article>", f"<form action=f><label>Find</label><input list=d>{choice}</form><article>")
    want = "Title & more\nFirst paragraph with bold text and é.\nSecond paragraph, which is not closed.\nThird one."
    assert html_text.main_text(net, [page]) == [want]


def test_html_embedded_text_stays(net):
    page = "<body><article><h1>On the size of things</h1><p>We know that <math><mi>a</mi><mo>=</mo><mi>b</mi></math> holds for all of them, and more.</p><noscript><p>This part of the story is shown without any script, too.</p></noscript><object data=x><p>The map of the land cannot be shown here, so it is told in words.</p></object><p>The end of the story.</p></article></body>"
    want = "On the size of things\nWe know that a=b holds for all of them, and more.\nThis part of the story is shown without any script, too.\nThe map of the land cannot be shown here, so it is told in words.\nThe end of the story."
    assert html_text.main_text(net, [page]) == [want]
    texts = [leaf[0] for leaf in html_text.leaves("<svg><title/><text>in</text></svg><template><p>t</template><canvas>c</canvas><script>no</script><p>after")]
    assert " ".join(texts) == "in t c after"


FOREIGN = [
    # a table layout with font tags
    ("<html><body><table><tr><td class=leftnav><a href=1>News</a><br><a href=2>Sport</a><br><a href=3>Weather</a></td><td><h2>Storm hits the coast</h2><font size=2>A storm has hit the northern coast on Monday, and several roads are closed until further notice.<p>Ferries are expected to run again on Tuesday, said the harbour office in a short statement.</font></td></tr></table><div id=footer>Copyright 1999 The Daily Paper. All rights reserved.</div></body></html>",
     "Storm hits the coast\nA storm has hit the northern coast on Monday, and several roads are closed until further notice.\nFerries are expected to run again on Tuesday, said the harbour office in a short statement."),
    # a blog with figures, quotes, code and lists
    ("<!DOCTYPE html><html><head><title>x</title></head><body><div class='wrap'><header id='masthead'><p class='site-title'>My blog</p><nav class='main-navigation'><ul><li><a href='/'>Home</a></li><li><a href='/about'>About</a></li></ul></nav></header><main><article class='post hentry'><h1 class='entry-title'>How to bake bread</h1><div class='entry-content'><p>Baking bread is easy once you know how much water the flour can take.</p><pre><code>500 g flour\n350 g water</code></pre><ul><li>Mix the flour and the water.</li><li>Wait for an hour or two.</li></ul><blockquote><p>Good bread needs time, as my grandmother used to say.</p></blockquote><h2>The oven</h2><p>Heat it as far as it will go, and bake for forty minutes.</p></div></article><section id='comments'><h3>2 comments</h3><ol><li><p>Great recipe, I have tried it at home and it worked.</p></li><li><p>Mine did not rise at all, what went wrong?</p></li></ol></section></main><aside id='secondary' class='widget-area'><h4>Archives</h4><ul><li><a href='/1'>May</a></li></ul></aside><footer id='colophon'>Powered by hand</footer></div></body></html>",
     "How to bake bread\nBaking bread is easy once you know how much water the flour can take.\n500 g flour 350 g water\nMix the flour and the water.\nWait for an hour or two.\nGood bread needs time, as my grandmother used to say.\nThe oven\nHeat it as far as it will go, and bake for forty minutes."),
    # plain divs with ids only
    ("<body><div id=cookie-banner>This site uses cookies. <button>OK</button></div><div id=top><a href=/>Start</a> | <a href=/c>Contact</a></div><div id=content><h1>Rivers of the north</h1><div>The long river rises in the hills and flows to the sea through three lakes.</div><div>In spring it often floods the meadows, which the farmers have known for ages.</div></div><div id=related><h3>See also</h3><a href=/l>Lakes</a><a href=/h>Hills</a></div></body>",
     "Rivers of the north\nThe long river rises in the hills and flows to the sea through three lakes.\nIn spring it often floods the meadows, which the farmers have known for ages."),
]


@pytest.mark.parametrize("page, want", FOREIGN)
def test_html_foreign_pages(net, page, want):
    """Pages written by hand, in layouts that the training pages do not have."""
    assert html_text.main_text(net, [page]) == [want]


@pytest.mark.parametrize("page", ["<div>a" * 150_000, '<b "q ' * 150_000, "<b =\"q" * 150_000, "<b ='q>x" * 100_000, "<i>" * 100_000 + "</b>" * 100_000, "</script " * 100_000, "<script></script " * 60_000, "<!-- " * 200_000, "<div class=%s>a" * 3, "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>a" for i in range(40_000)), "<p>a" * 100_000, "<" * 1_000_000])
def test_html_pages_of_a_megabyte(page):
    """Deep, open and broken pages are cut in time and memory linear in their length."""
    began = time.process_time()
    cut = html_text.leaves(page)
    x = html_text.Pages([cut]) if cut else None
    assert time.process_time() - began < 12 and (x is None or len(x.parent) <= len(page))


def test_html_paths_are_those_of_open_elements():
    page = "<div class='a b'><p class=a>x<div><ul><li class=c>y<li>z</ul></div></div>w"
    ids = lambda tag, attributes="": list(html_text.path_ids(tag, attributes))
    once = lambda *xs: list(dict.fromkeys(t for x in xs for t in x))
    div = ids("div", " class='a b'")
    assert [(t, node.path(), d) for t, node, _, d in html_text.leaves(page)] == [("x", once(div, ids("p", " class=a")), 2), ("y", once(div, ids("div"), ids("ul"), ids("li", " class=c")), 4), ("z", once(div, ids("div"), ids("ul"), ids("li")), 4), ("w", [0], 0)]


def test_labeller_against_brute_force(net):
    """The same network cell by cell, with every path walked from the root."""
    cuts = [html_text.leaves(p) for p in (PAGE, FOREIGN[0][0], "<p>one")]
    got = net.logits(html_text.Pages(cuts))
    h, at, p = html_text.HIDDEN, 0, net.p
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    for cut in cuts:
        one, states = html_text.Pages([cut]), {}
        for d in "fb":
            s, c = np.zeros(h), np.zeros(h)
            for i in range(len(cut)) if d == "f" else reversed(range(len(cut))):
                a = p[f"path_{d}"][cut[i][1].path()].sum(axis=0) + one.words[i] @ p[f"word_{d}"] + one.measures[i] @ p[f"measure_{d}"] + s @ p[f"state_{d}"]
                c = sigmoid(a[h : 2 * h]) * c + sigmoid(a[:h]) * np.tanh(a[3 * h :])
                s = sigmoid(a[2 * h : 3 * h]) * np.tanh(c)
                states[i, d] = s
        want = [np.concatenate((states[i, "f"], states[i, "b"])) @ p["out"][:-1] + p["out"][-1] for i in range(len(cut))]
        assert np.abs(got[at : at + len(cut)] - want).max() < 1e-4
        at += len(cut)


def test_html_held_out(net):
    good = total = 0
    for page in html_text.sample_pages(120, 4242):
        cut = html_text.leaves(page)
        if cut:
            keep = net.logits(html_text.Pages([[(t[1:], *rest) for t, *rest in cut]])) > 0
            good += int((keep == np.array([t[0] == html_text.CONTENT_MARK for t, *_ in cut])).sum())
            total += len(cut)
    assert good / total > 0.97


@pytest.mark.parametrize("page", ["<", "<p", "a<b>c", "<a href='x>y", "</p></div>", "<script>x", "<!-- open", "&amp;&#65;&bogus;", "<div " * 2000, "<p>" * 3000 + "x", "\x00<p>\x00"])
def test_broken_markup(net, page):
    assert isinstance(html_text.main_text(net, [page])[0], str)


def test_html_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (3, "v", "")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = html_text.extract(spark, df).collect()
    assert len(out) == 4 and all(r.n_chars == len(r.text) for r in out) and html_text.extract(spark, df.limit(0)).count() == 0


def test_html_shows_xmp_as_it_stands():
    page = "<article><p>one <xmp>code <b>&amp; text</xmp> three<p>four<script>no</script><textarea>no</textarea><XMP class=x>open <i>"
    assert [x[0] for x in html_text.leaves(page)] == ["one", "code <b>&amp; text", "three", "four", "open <i>"]
