import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from marklake.llm import warc


def sample(spark):
    big, rows = "é" * 600, []
    rows += [(i, f"http://x/{i}\r\nX: y" if i % 3 else None, big if i % 4 == 0 else "small" if i % 4 == 1 else f"page {i} " * 300) for i in range(60)]
    rows += [(100, "u", None), (101, "u", ""), (None, None, big), (102, "u", "x" * 300000), (7, "u", "page 7 " * 300), (7, "u", "page 7 " * 300)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))


def test_round_trip(spark, tmp_path):
    rows, df = sample(spark)
    manifest = warc.write(spark, df, f"file://{tmp_path}/a", shard_bytes=20000, roll_bytes=3000)
    out = warc.read(spark, f"file://{tmp_path}/a", payloads=True).collect()
    largest = {}
    for i, _, t in rows:
        if i is not None and len((t or "").encode()) >= 1000:
            largest[t] = max(largest.get(t, -1), i)
    want = []
    for i, _, t in rows:
        b = (t or "").encode()
        refers = largest.get(t) if len(b) >= 1000 and largest.get(t) != i else None
        want.append((str(i), len(b), hashlib.sha1(b).hexdigest(), "response" if refers is None else "revisit", str(refers)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in out) == sorted(want)
    text = {(i, (t or "").encode()) for i, _, t in rows}
    assert all((r.page_id, bytes(r.payload)) in text for r in out if r.record_type == "response")
    files = {r.name: r.sha1 for r in manifest.collect()}
    assert len(files) > 3 and set(os.listdir(tmp_path / "a")) - {"manifest"} == set(files)
    again = warc.write(spark, df.orderBy(F.rand(1)), f"file://{tmp_path}/b", shard_bytes=20000, roll_bytes=3000)
    assert {r.name: r.sha1 for r in again.collect()} == files


def test_ids_of_any_size_and_heavy_keys(spark, tmp_path):
    """Ids at both ends of the range, one id far from all others, and a third of all rows under one key: no crash, no large shard."""
    text = lambda i: f"{i} " + "word " * 400
    rows = [(-(9 * 10**18), "a", text("low")), (9 * 10**18, "b", text("high")), (None, "c", text("none"))]
    rows += [(i, f"http://x/{i}%20 é?", text(i)) for i in range(200)] + [(7 * 10**17, f"u{i}", text("same")) for i in range(100)] + [(None, None, text("null")) for _ in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    at = f"file://{tmp_path}/w"
    manifest = warc.write(spark, df, at, shard_bytes=40_000).collect()
    out = warc.read(spark, at, payloads=True).collect()
    assert sorted((str(r.page_id), str(r.url), bytes(r.payload).decode()) for r in out) == sorted((str(i), str(u), t) for i, u, t in rows)
    assert len({r.shard for r in manifest}) >= 15 and max(r.records for r in manifest) < 60
    per = {}
    for r in manifest:
        per[r.shard] = per.get(r.shard, 0) + r.records
    assert max(per.values()) <= 2 * 40_000 / 2000 and any(r.part > 0 for r in manifest)


def test_revisit_headers(spark, tmp_path):
    rows = [(1, "http://x/1", "z" * 2000), (2, "http://x/2", "z" * 2000)]
    at = f"file://{tmp_path}/r"
    names = [r.name for r in warc.write(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), at).collect()]
    heads = {}
    for name in names:
        with open(f"{tmp_path}/r/{name}", "rb") as f:
            for raw in warc.members(f):
                fields = warc.parse(raw)[0]
                heads[fields["WARC-Type"]] = fields
    assert heads["revisit"]["WARC-Refers-To"] == heads["response"]["WARC-Record-ID"]
    assert (heads["revisit"]["WARC-Refers-To-Target-URI"], heads["revisit"]["WARC-Refers-To-Date"]) == ("http://x/2", warc.DATE)


def test_record_ids_are_unique(spark, tmp_path):
    """Rows equal in all, in one shard and in many; rows without an id revisit the largest one, if any has one."""
    rows = [(1, "u", "a" * 2000)] * 3 + [(2, "u", "b" * 3000)] * 40 + [(None, "u", "a" * 2000)] * 2 + [(None, None, "c" * 1500)] * 2 + [(3, "u", "d")] * 2
    at = f"file://{tmp_path}/i"
    names = [r.name for r in warc.write(spark, spark.createDataFrame(rows, "page_id long, url string, html string"), at, shard_bytes=20_000).collect()]
    ids = []
    for name in names:
        with open(f"{tmp_path}/i/{name}", "rb") as f:
            ids += [warc.parse(raw)[0]["WARC-Record-ID"] for raw in warc.members(f)]
    assert len(ids) == len(set(ids)) == len(rows) + len(names)
    kinds = sorted((str(r.page_id), r.payload_bytes, r.record_type, str(r.refers_to)) for r in warc.read(spark, at).collect() if r.page_id is None)
    assert kinds == [("None", 1500, "response", "None")] * 2 + [("None", 2000, "revisit", "1")] * 2


def test_empty_archive(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(spark, df, f"file://{tmp_path}/e")
    assert warc.read(spark, f"file://{tmp_path}/e").count() == 0


def test_damage_is_noticed(spark, tmp_path):
    raw = warc.record(1, "u", b"x" * 2000, hashlib.sha1(b"x" * 2000).digest(), 2000, None, warc.DATE, 6)
    import io
    import zlib

    assert warc.parse(next(warc.members(io.BytesIO(raw))))[0]["WARC-Type"] == "response"
    with pytest.raises((EOFError, zlib.error)):
        list(warc.members(io.BytesIO(raw[:-20])))
    plain = next(warc.members(io.BytesIO(raw)))
    with pytest.raises(ValueError):
        warc.parse(plain.replace(b"xxxx", b"xyxx", 1))


def test_pipeline_stages(spark, tmp_path):
    cp = pytest.importorskip("corpus_pipeline")
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    text = lambda i, n=60: " ".join(words[(i * 37 + j * (i % 7 + 1)) % 300] for j in range(n))
    item = text(999, 25)
    rows = [(i, text(i), "aa", f"s{i % 3}", 1) for i in range(40)]
    rows += [(100, text(5), "aa", "s0", 1), (101, text(6) + " " + item, "aa", "s1", 1), (102, "### $$$ %%% ### " * 20, "aa", "s0", 1), (103, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(40)] + [(102, 0, 0), (103, 0, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert ids and ids <= set(range(40)) and all(r.taken > 0 for r in out)
    assert [n for n, _ in cp.STAGES] == ["quality", "language", "near_dedup", "decontamination", "mixing"]


@pytest.fixture
def small_tables(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("ka lo mi ne ra su ti vo".split()) for _ in range(rng.randrange(1, 4)))
    text = lambda n=40: " ".join(word() for _ in range(n)).capitalize() + "."
    rows = [(i, text(), "aa", f"s{i % 3}", 1) for i in range(60)]
    bad = [(100 + i, "### $$$ 123 !!! " * 15 + str(i), "aa", "s0", 1) for i in range(20)]
    spark.createDataFrame([(1, text(30))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    labels = [(r[0], 1, 0) for r in rows] + [(r[0], 0, 0) for r in bad]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, bad, text, str(tmp_path)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_pipeline_of_an_empty_table(spark, small_tables):
    cp, at = pytest.importorskip("corpus_pipeline"), small_tables[3]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{at}/documents.parquet")
    assert cp.run(spark, at).count() == 0


def test_pipeline_edges(spark, small_tables):
    """Repeated rows, copies under several ids, rows without id, source or text, a short and a very long text, clashing columns."""
    cp = pytest.importorskip("corpus_pipeline")
    rows, bad, text, at = small_tables
    own, other = text(), text()
    odd = [rows[0], rows[0], (200, rows[1][1], "aa", "s1", 1), (None, own, None, None, None), (None, own, None, None, None), (None, other, None, None, None), (300, None, None, "s2", None), (301, "", None, None, None), (302, "Kalo.", "aa", "s0", 5), (303, " ".join(text(2000) for _ in range(5)), "aa", "s1", 1), (304, "12 34 !! --", "aa", "s1", 1)]
    docs = spark.createDataFrame(rows + bad + odd, SCHEMA)
    clash = docs.withColumns({c: F.lit(7) for c in ("score", "held_out", "size", "target", "taken", "predicted")})
    clash.write.parquet(f"{at}/documents.parquet")
    left = clash
    for name, stage in cp.STAGES:
        after = stage(spark, left, at)
        assert name == "mixing" or (after.columns == clash.columns and {r.score for r in after.collect()} == {7}), name
        left = after
        if name == "near_dedup":
            ids = sorted(str(r.doc_id) for r in after.collect())
            assert ids == sorted([str(i) for i in range(60)] + ["None", "None", "302", "303"])
    out = cp.run(spark, at)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"]
    got = sorted((str(r.doc_id), r.size, r.taken) for r in out.collect())
    assert got == sorted((str(r.doc_id), r.size, r.taken) for r in cp.run(spark, at).collect()) and all(0 < n and 0 < t <= 3 * n for _, n, t in got)
