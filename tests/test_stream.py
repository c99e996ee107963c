import json
import random
import re
import time
from collections import Counter
from types import SimpleNamespace

from pyspark.sql import functions as F

from marklake.operators import index, webhooks
from marklake.sources import vault
from marklake.streaming import deliver, pipeline


def put(root, rel, text):
    p = root / rel
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)


def test_vault_source(spark, tmp_path):
    for rel in ("_system/a.md", "_index.md", "20/_index.md", ".trash/b.md", "D.MD", "20/c.md"):
        put(tmp_path, rel, rel)
    vault.register(spark)
    read = lambda **o: sorted(r.path for r in spark.read.format("vault").options(**o).load(str(tmp_path)).collect())
    assert read() == ["20/_index.md", "20/c.md", "_index.md", "_system/a.md"]
    assert ".trash/b.md" in read(hidden="true")


def test_changes(tmp_path):
    put(tmp_path, "a.md", "1")
    put(tmp_path, "N.MD", "x")
    r = vault._Changes(str(tmp_path), str(tmp_path / ".changes"))
    one = r.latestOffset()
    assert r.changes(r.initialOffset(), one) == []  # not settled yet
    two = r.latestOffset()
    assert [x[:2] for x in r.changes(one, two)] == [("add", "N.MD"), ("add", "a.md")] and r.latestOffset() == two
    assert [x[2] for p in r.partitions(one, two) for x in r.read(p)] == ["x", "1"]
    put(tmp_path, "a.md", "22")
    r.latestOffset()
    three = r.latestOffset()
    assert [x[:2] for x in r.changes(two, three)] == [("change", "a.md")]
    (tmp_path / "a.md").unlink()
    four = r.latestOffset()
    assert [x[:2] for x in r.changes(three, four)] == [("unlink", "a.md")] and [x[:2] for x in r.changes(two, four)] == [("change", "a.md"), ("unlink", "a.md")]
    assert [list(x) for x in r.read(r.partitions(two, four)[0])][0][0] == "unlink"  # the changed file is gone by now
    r.commit(four)
    assert r._turns() == [four["turn"]] and r.latestOffset() == four


def events(spark, rows):
    return spark.createDataFrame(rows, "event string, path string, content string, ts string, seq long").withColumn("ts", F.col("ts").cast("timestamp"))


def test_store_touches_changed_buckets_only(spark, tmp_path):
    store = pipeline.Store(spark, str(tmp_path / "s"), buckets=8, keep=2)
    pipeline.batch(store, events(spark, [("add", f"{i}.md", f"# H\n\ntext {i}", "2026-01-01", i) for i in range(20)]), 0)
    first = store.manifest()
    assert store.table("files").count() == 20 and store.table("chunks").count() == 20
    # the later event of a path counts, whatever the order of the rows
    pipeline.batch(store, events(spark, [("unlink", "3.md", None, "2026-01-02", 9), ("change", "3.md", "x", "2026-01-02", 8), ("change", "4.md", "- [ ] new", "2026-01-02", 7)]), 1)
    now = store.manifest()
    assert sorted(r.path for r in store.table("files").collect()) == sorted(f"{i}.md" for i in range(20) if i != 3)
    assert [r.text for r in store.table("tasks").collect()] == ["new"] and 0 < sum(now[b] != t for b, t in first.items()) <= 2
    assert store.table("files", before=1).count() == 20
    pipeline.batch(store, events(spark, [("change", "4.md", "- [ ] new", "2026-01-02", 7)]), 2)
    pipeline.batch(store, events(spark, [("change", "4.md", "- [ ] new", "2026-01-02", 7)]), 2)  # a repeated turn
    assert store.table("files").count() == 19 and store._turns() == [1, 2]


def test_chunks_keep_their_vectors(spark, tmp_path):
    old = index.chunked(index.parsed(spark.createDataFrame([("a.md", "# A\n\nsame text")], "path string, content string")), None)
    old = old.withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>")).withColumn("embed_model", F.lit("m"))
    moved = events(spark, [("unlink", "a.md", None, "2026-01-01", 1), ("add", "b/a.md", "# A\n\nsame text", "2026-01-01", 1), ("add", "c.md", "other", "2026-01-01", 1)])
    got = {r.file_path: r for r in index.apply_chunk_events(old, moved, "m").collect()}
    assert set(got) == {"b/a.md", "c.md"} and got["b/a.md"].embedding == [1.0, 2.0] and got["c.md"].embedding is None
    assert {r.embedding is None for r in index.apply_chunk_events(old, moved, "other model").collect()} == {True}
    assert [r.path for r in index.unchunked(spark.createDataFrame([("a.md",), ("z.md",)], "path string"), old).collect()] == ["z.md"]


def test_catch_up(spark, tmp_path):
    store = pipeline.Store(spark, str(tmp_path / "s"))
    note = lambda rows: spark.createDataFrame(rows, "path string, content string").withColumn("mtime", F.lit("2026-01-01").cast("timestamp"))
    pipeline.catch_up(store, note([("a.md", "1"), ("b.md", "2")]), 0)
    pipeline.catch_up(store, note([("b.md", "2"), ("c.md", "3")]), 1)
    assert sorted(r.path for r in store.table("files").collect()) == ["b.md", "c.md"]


def test_delivery_checks_the_address(spark):
    lookup = {"in.example": "10.0.0.1", "out.example": "93.184.216.34", "six.example": "::ffff:192.168.0.1"}
    ok = lambda url: deliver.public_address(url, lambda host, _: [(0, 0, 0, "", (lookup[host], 0))])
    assert [ok(f"https://{h}/x") for h in lookup] == [False, True, False] and not ok("https:///x")
    rules = webhooks.create(webhooks.empty(spark), "https://hooks.example.com/a", "2026-01-01", key="a", secret="s")
    seen = []
    assert deliver.test_delivery(rules, "a", lambda *x: seen.append(x) or 200, "2026-01-01T00:00:00Z") == (200, 1, None) and b'"event": "test"' in seen[0][1]
    assert deliver.test_delivery(rules, "a", lambda *x: 200, "t", guard=lambda url: False)[2] == "address refused"
    matched = spark.createDataFrame([("add", "p.md", "{}", "2026-01-01", "a", "https://in.example/", None, None)], "event string, path string, frontmatter string, ts string, webhook_id string, url string, secret string, body string")
    assert deliver.deliver(matched, lambda *x: 200, guard=lambda url: False).first().error == "address refused"


def test_vectors_follow_their_content(spark, tmp_path):
    """Moved over two batches, copied to another bucket, put back after a removal: nothing is embedded twice; what nothing refers to goes."""
    store, asked = pipeline.Store(spark, str(tmp_path / "s"), buckets=16), tmp_path / "asked"
    asked.mkdir()

    def embedder(texts):
        for t in texts:
            (asked / f"{time.time_ns()}").write_text(t)
        return [[float(len(t))] for t in texts]

    count = lambda: len(list(asked.iterdir()))
    got = lambda: {r.file_path: (r.embed_model, r.embedding) for r in store.table("chunks").collect()}
    note = lambda event, path, title, text, seq: (event, path, f"---\ntitle: {title}\n---\n{text}" if text else None, "2026-01-01", seq)
    run = lambda rows, turn: pipeline.batch(store, events(spark, rows), turn, model="m")
    run([note("add", "a.md", "A", "same text", 1), note("add", "b.md", "B", "other", 1), note("add", "c.md", "A", "same text", 1)], 0)
    pipeline.embed(store, embedder, "m", 1)
    assert count() == 2 and got() == {"a.md": ("m", [9.0]), "b.md": ("m", [5.0]), "c.md": ("m", [9.0])}
    run([note("unlink", "a.md", "", None, 1), note("unlink", "c.md", "", None, 1)], 2)
    run([note("add", "deep/a.md", "A", "same text", 1), note("add", "copy.md", "B", "other", 1)], 3)
    run([note("add", "deep/a.md", "A", "same text", 1), note("add", "copy.md", "B", "other", 1)], 3)  # a repeated batch
    assert got() == {"deep/a.md": ("m", [9.0]), "b.md": ("m", [5.0]), "copy.md": ("m", [5.0])}
    pipeline.embed(store, embedder, "m", 4)
    assert count() == 2 and {r.n for r in pipeline.references(store).collect()} == {1, 2}
    run([note("unlink", "deep/a.md", "", None, 1)], 5)
    pipeline.forget(store, 6)
    assert store.table("vectors").count() == 1 and len(got()) == 2


def test_batches_match_rules_and_send_once(spark, tmp_path):
    store, sent = pipeline.Store(spark, str(tmp_path / "s"), buckets=4), tmp_path / "sent"
    sent.mkdir()

    def transport(url, body, headers, timeout):
        (sent / f"{time.time_ns()}").write_text(url + " " + body.decode())
        return 200

    rules = webhooks.create(webhooks.empty(spark), "https://hooks.example.com/a", "2026-01-01", key="a", folder="in", frontmatter={"kind": "x"})
    rules = webhooks.create(rules, "https://hooks.example.com/b", "2026-01-01", key="b", events=["unlink"])
    new = [("add", "in/1.md", "---\nkind: x\n---\n", "2026-01-01", 1), ("add", "in/2.md", "---\nkind: y\n---\n", "2026-01-01", 1), ("add", "out/3.md", "---\nkind: x\n---\n", "2026-01-01", 1)]
    gone = [("unlink", "in/1.md", None, "2026-01-02", 2)]
    seen = []
    for turn, rows in ((0, new), (0, new), (1, gone), (1, gone)):
        pipeline.batch(store, events(spark, rows), turn, rules, transport, report=lambda df: seen.append(sorted((r.webhook_id, r.path, r.event, r.status) for r in df.collect())), guard=None)
    assert seen == [[("a", "in/1.md", "add", 200)]] * 2 + [[("a", "in/1.md", "unlink", 200), ("b", "in/1.md", "unlink", 200)]] * 2
    assert len(list(sent.iterdir())) == 3  # the removed note was matched by its last front matter, and nothing was sent twice
    pipeline.batch(store, events(spark, [("add", "in/9.md", "---\nkind: x\n---\n", "2026-01-03", 3)]), 2, rules, transport, guard=lambda url: False)
    assert [r.error for r in store.sent(2).collect()] == ["address refused"] and len(list(sent.iterdir())) == 3


def test_the_address_is_checked_before_each_attempt():
    answers = iter([True, False])
    assert deliver.send(lambda *x: 500, "https://x.example/", b"", {}, 3, lambda s: None, lambda url: next(answers)) == (None, 1, "address refused")


def test_many_rules_against_plain_tests(spark):
    """Rules of every shape, as a table, against a test of each rule and event."""
    folders = ["", "a", "/a/b/", "a/*", "*/b", "**", "a/**/c", "a?", "**/d", "x.y", "a/b*", "***/c", "a\\b", "[a]", "b"]
    fms = [{}, {"k": "1"}, {"k": "2", "t": "u"}, {"none": ""}, {"t": "v"}, {"d": "true"}]
    rng = random.Random(2)
    rows = [(f"r{i}", i % 9 > 0, f"https://h.example/{i}", "", rng.choice(folders), rng.choice(fms), rng.choice([{}, {}, {"k": "1"}, {"t": "u"}, {"none": ""}]), rng.choice([None, [], ["add"], ["change", "unlink"]]), None, i % 2 == 0) for i in range(300)]
    schema = "id string, enabled boolean, url string, name string, folder string, frontmatter map<string,string>, frontmatter_not map<string,string>, events array<string>, secret string, include_body boolean"
    rules = spark.createDataFrame(rows, schema)
    paths = ["a/1.md", "a/b/2.md", "a/b/c/3.md", "4.md", "b/5.md", "ab/6.md", "x.y/7.md", "q/b/d/8.md", "a/x/y/c/9.md", "[a]/10.md", "xzy/11.md"]
    jsons = ["{}", '{"k":1}', '{"k":"2","t":["u","v"]}', '{"t":"u","d":true,"o":{"k":1}}', "not json", '{"k":null,"t":[]}', '{"k":["1","2"]}']
    ev = [(rng.choice(["add", "change", "unlink"]), p, j, "2026-01-01", f"{p} {j}") for p in paths for j in jsons]
    df = spark.createDataFrame(ev, "event string, path string, frontmatter string, ts string, content string")
    got = sorted((r.event, r.path, r.frontmatter, r.webhook_id, r.body) for r in webhooks.match(df, rules).collect())

    def values(j, k):
        try:
            v = json.loads(j).get(k)
        except ValueError:
            v = None
        return ["" if v is None else v if isinstance(v, str) else json.dumps(v)] if not isinstance(v, list) else v

    want = []
    for e, p, j, _, c in ev:
        for i, on, _, _, folder, fm, fm_not, kinds, _, whole in rows:
            if on and e in (kinds or webhooks.EVENTS) and re.fullmatch(python_glob(folder), p) and all(v in values(j, k) for k, v in fm.items()) and not any(v in values(j, k) for k, v in fm_not.items()):
                want.append((e, p, j, i, c if whole else None))
    assert got == sorted(want, key=lambda x: tuple(map(str, x))) or Counter(got) == Counter(want)


def python_glob(folder):
    folder = folder.strip().replace("\\", "/").strip("/")
    folder = folder if "**" in folder else f"{folder}/**" if folder else "**"
    wild = {"**/": ".*", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "".join(wild.get(x, re.escape(x)) for x in re.split(r"(\*\*/?|[*?])", folder))


def test_health():
    h = pipeline.Health()
    h.onQueryStarted(None)
    h.onQueryTerminated(SimpleNamespace(exception="boom"))
    assert h.status() == {"watcher_ready": False, "watcher_closed": True, "last_event": None, "last_error": "boom", "rows": 0}


def test_stream_keeps_the_index(spark, tmp_path):
    notes = tmp_path / "notes"
    put(notes, "a.md", "---\ntitle: A\n---\n- [ ] do")
    vault.register(spark)
    store = pipeline.Store(spark, str(tmp_path / "index"))
    stream = spark.readStream.format("vault_changes").load(str(notes))
    q = pipeline.start(stream, store, str(tmp_path / "check"), trigger={"processingTime": "200 milliseconds"})
    try:
        def wait(test):
            end = time.time() + 60
            while time.time() < end:
                if test():
                    return True
                time.sleep(0.5)
            return False

        assert wait(lambda: [r.title for r in store.load()[0].collect()] == ["A"])
        assert [r.text for r in store.load()[1].collect()] == ["do"]
        (notes / "a.md").unlink()
        assert wait(lambda: store.load()[0].isEmpty())
    finally:
        q.stop()


def test_windows_on_a_table(spark):
    df = spark.createDataFrame([("2026-01-01 01:00:00", "a", 1.0), ("2026-01-01 23:00:00", "a", 2.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.n, r.total) for r in pipeline.windowed_counts(df).collect()] == [(2, 3.0)]


def test_a_large_bucket_is_written_by_several_tasks(spark, tmp_path):
    files = spark.range(0, 4000, 1, 4).selectExpr("concat('n/', id) AS path", "sha2(cast(id AS string), 512) AS title", "cast(null AS string) AS created", "cast(null AS string) AS modified", "cast(null AS array<string>) AS tags", "sha2(cast(-id AS string), 512) AS frontmatter")
    store = pipeline.Store(spark, f"file://{tmp_path}/s", buckets=1)
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(size, "100k")
    try:
        store.save(0, {0}, {"files": files})
    finally:
        spark.conf.unset(size)
    assert len(list(tmp_path.glob("s/files/*/bucket=0/*.parquet"))) > 1 and store.table("files").count() == 4000


def test_a_batch_is_parsed_once(spark, tmp_path, monkeypatch):
    """Every table is kept current from one written, parsed row a path, which is gone afterwards."""
    made, latest = [], index.latest
    monkeypatch.setattr(index, "latest", lambda events: made.append(1) or latest(events))
    store = pipeline.Store(spark, str(tmp_path / "s"), buckets=2)
    rows = [("add", "a.md", "---\ntitle: A\n---\n- [ ] old", "2026-01-01", 1), ("change", "a.md", "---\ntitle: B\ntags: [x]\ncreated: 2026-01-02\n---\n- [X] new due:: 2026-01-03 ", "2026-01-01", 2), ("add", "b.md", "b", "2026-01-01", 1), ("unlink", "b.md", None, "2026-01-01", 2)]
    pipeline.batch(store, events(spark, rows), 0, model="m")
    files, tasks, chunks = store.load()
    assert len(made) == 1 and not list((tmp_path / "s" / "work").iterdir())
    assert [(r.path, r.title, r.created, r.modified, r.tags) for r in files.collect()] == [("a.md", "B", "2026-01-02", "2026-01-01", ["x"])]
    assert [(r.text, r.completed, r.due, r.pos) for r in tasks.collect()] == [("new due:: 2026-01-03", 1, "2026-01-03", 0)] and [r.title for r in chunks.collect()] == ["B"]
