import json

import pytest
from pyspark.sql import functions as F

from marklake.functions import paths as P
from marklake.operators import comments, edits, index, links, listing, search, sections, tokens, webhooks
from marklake.plans import gate
from marklake.streaming import deliver


def notes(spark, rows, schema="path string, content string"):
    return spark.createDataFrame(rows, schema)


def contents(df):
    return {r.path: r.content for r in df.collect()}


def test_index_of_notes(spark):
    df = notes(spark, [("a/n.md", "---\ntitle: T\ntags: [x]\ncreated: 2026-01-02\n---\n#y\n- [x] t"), ("b.md", "---\na: [\n---\nbody"), ("c.md", "")]).withColumn("mtime", F.lit("2026-03-04").cast("timestamp"))
    rows = {r.path: r for r in index.files(index.parsed(df)).collect()}
    assert (rows["a/n.md"].title, rows["a/n.md"].created, rows["a/n.md"].modified, rows["a/n.md"].tags) == ("T", "2026-01-02", "2026-03-04", ["x", "y"])
    assert rows["b.md"].title == "b" and rows["b.md"].frontmatter == "{}" and rows["c.md"].tags == []
    assert [r.text for r in index.tasks(index.parsed(df)).collect()] == ["t"]


def test_merge_equals_rebuild(spark):
    a, b = [("a.md", "- [ ] 1"), ("b.md", "x")], [("b.md", "- [x] 2"), ("c.md", "y")]
    stamp = lambda df: df.withColumn("mtime", F.lit("2026-01-01").cast("timestamp"))
    old, new = index.parsed(stamp(notes(spark, a))), index.parsed(stamp(notes(spark, b)))
    merged = index.upsert(index.files(old), index.files(new), "path")
    rebuilt = index.files(index.parsed(stamp(notes(spark, list((dict(a) | dict(b)).items())))))
    assert sorted(merged.collect()) == sorted(rebuilt.collect())


def test_links(spark):
    df = notes(spark, [("a/Note.md", "[[note]] [[b/dup]] [[x/y/DUP]] [[gone]]"), ("b/dup.md", ""), ("c/dup.md", "")])
    got = {r.target: r for r in links.resolve(links.edges(df), df).collect()}
    assert got["note"].resolved == "a/Note.md" and got["b/dup"].resolved == "b/dup.md" and got["b/dup"].ambiguous is None
    assert got["x/y/DUP"].resolved == "b/dup.md" and got["x/y/DUP"].ambiguous == ["b/dup.md", "c/dup.md"] and not got["gone"].exists


def test_suggestions(spark):
    out = links.suggest(spark.createDataFrame([("projet",)], "target string"), spark.createDataFrame([("projets",), ("project",), ("zzz",)], "name string"))
    assert [r.name for r in out.orderBy("rank").collect()] == ["projets", "project"]


def test_listing(spark):
    files = spark.createDataFrame([("a/2026-01-05 n.md", "{}"), ("a/b/m.md", '{"created":"2026-02-01"}'), ("c.md", '{"tags":["x","y"]}')], "path string, frontmatter string")
    assert [r.path for r in listing.list_files(files).collect()] == ["a/b/m.md", "a/2026-01-05 n.md", "c.md"] or [r.path for r in listing.list_files(files).collect()][0] == "a/b/m.md"
    assert [r.path for r in listing.list_files(files, tags="x,y").collect()] == ["c.md"]
    assert [(r.name, r.type) for r in listing.directory(files, "a").collect()] == [("b", "directory"), ("2026-01-05 n.md", "file")]
    assert [r.name for r in listing.directory(files, "", allow=["a/b"]).collect()] == ["a"]
    assert [listing.page_size(x) for x in (None, 0, "x", -3, 500, "7")] == [20, 20, 20, 1, 100, 7]
    with pytest.raises(ValueError):
        listing.checked_batch([])
    with pytest.raises(ValueError):
        listing.checked_batch(["x"] * 101)


def test_moves_to_one_place(spark):
    df = notes(spark, [("a.md", "1"), ("b.md", "2"), ("c.md", "3"), ("d.md", "4")])
    moves = spark.createDataFrame([("a.md", "x.md"), ("b.md", "./x.md"), ("c.md", "y.md"), ("c.md", "z.md"), ("q.md", "x2.md")], "path string, destination string")
    moved, report = edits.move(df, moves)
    assert sorted(contents(moved)) == ["b.md", "d.md", "x.md", "y.md"]
    assert {r.path: r.error for r in report.collect()} == {"a.md": None, "b.md": "Destination exists", "c.md": None, "q.md": "File not found"}


def test_append_makes_a_note(spark):
    df = notes(spark, [("a.md", "x")]).withColumn("mtime", F.lit("2026-01-01").cast("timestamp"))
    out = {r.path: r for r in edits.append(df, "new.md", "first", now="2026-02-01").collect()}
    assert out["new.md"].content == "first" and str(out["new.md"].mtime)[:10] == "2026-02-01" and len(out) == 2


def test_comment_scanner():
    note = 'A <!--c:k-1-->some "text"<!--/c:k-1--> <!--c:o-->open\n<!--co:k-1 by:me at:t status:open quote:"a \\" --> b"\nme (t): hi\nno entry\nyou (u v): a\\nb\n-->\n<!--co:bad by:me\nx\n--> <!--co:end'
    got = comments.threads(note)
    assert [(t["id"], t["quote"], t["anchored_text"]) for t in got] == [("k-1", 'a \\" --> b', 'some "text"')]
    assert [(r["author"], r["at"], r["text"]) for r in got[0]["replies"]] == [("me", "t", "hi"), ("you", "u v", "a\nb")]
    done = comments.set_status(note, "k-1", True)
    assert comments.threads(done)[0]["status"] == "resolved" and comments.set_status(done, "k-1", False) == note == comments.set_status(note, "k-1", False)
    assert "status:resolved" in comments.set_status(note, "bad", True) and comments.set_status(note, "bad", False) == note
    more = comments.threads(comments.reply(note, "k-1", "x --> y", "a b", "t2"))[0]["replies"]
    assert (more[-1]["author"], more[-1]["text"]) == ("a_b", "x --\u200b> y") and len(more) == 3
    assert comments.remove(note, "k-1").startswith('A some "text" <!--c:o-->open\n<!--co:bad')
    for f in (comments.reply, comments.set_status, comments.remove):
        with pytest.raises(ValueError):
            f(note, "none", *(("x", "y", "z") if f is comments.reply else (True,) if f is comments.set_status else ()))


def test_paths_agree_with_values(spark):
    rows = ["", "a", "/a//b/", "a/./b", "a/..", "..", "a/../../b", "a\\b", "x/.hidden", "x/..y", ".", "a/b/../c"]
    df = spark.createDataFrame([(p,) for p in rows], "p string")
    assert [(r.p, r.c) for r in df.select("p", P.canonical(F.col("p")).alias("c")).collect()] == [(p, P.canonical_text(p)) for p in rows]


def test_bm25_by_index_and_by_scan(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Réunion", "budget validé budget"), (2, "Notes", "la réunion et le BUDGET prévisionnel"), (3, "x", ""), (4, "x", None)], "id long, title string, text string")
    fields = {"title": 3.0, "text": 1.0}
    search.build_index(docs, str(tmp_path / "i"), id_col="id", fields=fields)
    for q in ("reunion budget", "bud previsionnel", "nothing", "!!"):
        a = {r.id: round(r.score, 9) for r in search.bm25(docs, q, id_col="id", fields=fields).collect()}
        assert a == {r.id: round(r.score, 9) for r in search.bm25_indexed(spark, str(tmp_path / "i"), q).collect()}, q


def test_context(spark):
    assert listing.context(notes(spark, [("x.md", "y")])).first()[0] == "agent.md not found"


def test_edits(spark):
    df = notes(spark, [("a.md", "x x"), ("b/c.md", "---\nk: 1\n---\nold"), ("b/d.md", "")])
    assert contents(edits.append(df, "a.md", "y"))["a.md"] == "x x\ny" and contents(edits.append(df, "b/d.md", "y"))["b/d.md"] == "y"
    new, report = edits.patch(df, "a.md", "x", "z")
    assert contents(new)["a.md"] == "z x" and report.first().occurrences == 2 and report.first().replacements == 1
    assert edits.patch(df, "a.md", "q", "z")[1].first().error == "text not found"
    assert contents(edits.replace_body(df, "b/c.md", "new"))["b/c.md"] == "---\nk: 1\n---\nnew"
    merged = edits.merge_front(df, spark.createDataFrame([("b/c.md", '{"k":null,"z":2}')], "path string, fm_new string"))
    assert contents(merged)["b/c.md"] == "---\nk: null\nz: 2\n---\nold"
    assert sorted(contents(edits.move_folder(df, "b", "e"))) == ["a.md", "e/c.md", "e/d.md"]
    for bad in (("", "x"), ("b", "b"), ("b", "b/x")):
        with pytest.raises(ValueError):
            edits.move_folder(df, *bad)
    moves = spark.createDataFrame([("a.md", "n.md"), ("q.md", "r.md"), ("b/c.md", "../x"), ("b/d.md", "a.md")], "path string, destination string")
    moved, report = edits.move(df, moves)
    assert sorted(contents(moved)) == ["b/c.md", "b/d.md", "n.md"] and edits.batch_summary(report).first().failed_count == 3
    gone = edits.delete(df.unionByName(notes(spark, [(".trash/a.md", "")])), notes(spark, [("a.md", "")]), "2026-01-02 03:04:05")
    assert ".trash/a-20260102030405.md" in contents(gone)
    assert sorted(contents(edits.delete(df, notes(spark, [("a.md", "")]), "2026-01-01", hard=True))) == ["b/c.md", "b/d.md"]


def test_folders(spark):
    have = spark.createDataFrame([("a",)], "path string")
    got = {r.path: (r.already_existed, r.error) for r in edits.create_folders(have, ["a", "b/c", "../x"]).collect()}
    assert got == {"a": (True, None), "b/c": (False, None), "../x": (False, "Access denied")}


def test_sections():
    f = lambda md: [s["heading"] for s in sections.split_sections(md)]
    assert f("# Projet\n\nIntro\n\n## Budget\n\nx\n\n### Détail\n\ny") == ["Projet", "Projet > Budget", "Projet > Budget > Détail"]
    assert f("# A\n\nx\n\n## B\n\ny\n\n## C\n\nz") == ["A", "A > B", "A > C"]
    assert f("# Real\n\nbefore\n\n```bash\n# no\n```\n\nafter") == ["Real"]
    assert f("orphan\n\n# Later\n\nbody") == ["", "Later"] and f("# A\n\n## B\n\n## C\n\nx") == ["A > C"]


def test_chunks():
    assert sections.chunk("  \n ") == []
    assert len(sections.chunk("# A\n\nsmall\n\n## B\n\ntiny", max_chars=2000)) == 1
    cut = sections.chunk("x" * 5000, max_chars=800)
    assert len(cut) >= 6 and all(len(c["text"]) <= 800 for c in cut)
    body = "\n\n".join(f"paragraph {i} " + "word " * (i % 40) for i in range(80))
    got = sections.chunk(body, max_chars=400)
    assert all(len(c["text"]) <= 400 and 1 <= c["start_line"] <= c["end_line"] for c in got)
    assert all(any(f"paragraph {i} " in c["text"] for c in got) for i in range(80))


def test_chunks_hold_few_notes_however_long():
    import pyarrow as pa

    class Notes:
        """In place of a table: the function that its tasks would run."""
        select = lambda self, *columns: self
        mapInArrow = lambda self, work, schema: work

    body = "\n\n".join("word " * 20 + str(i) for i in range(4000))  # 400,000 characters
    rows = [(f"{i}.md", "T", body if i % 2 else None) for i in range(16)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], names=["path", "title", "body"])
    got = list(sections.chunks(Notes())(iter([batch, batch.slice(0, 0), batch.slice(0, 1)])))
    assert max(sum(map(len, b.column("text").to_pylist())) for b in got) < sections.TEXT_AT_ONCE + 2 * len(body)
    made = [(r["file_path"], r["text"]) for b in got for r in b.to_pylist()]
    assert made == [(p, c["text"]) for p, t, b in [*rows, rows[0]] for c in sections.chunk(b or "") or [{"text": t}]]


def test_chunk_table_and_backfill(spark):
    df = spark.createDataFrame([("a.md", "T", ""), ("b.md", "U", "some text")], "path string, title string, body string")
    table = sections.chunks(df).withColumn("embedding", F.lit(None).cast("array<double>")).withColumn("embed_model", F.lit(None).cast("string"))
    assert {r.text for r in table.collect()} == {"T", "some text"}
    done = sections.backfill(table, lambda ts: [[float(len(t))] for t in ts], "m")
    assert {tuple(r.embedding) for r in done.collect()} == {(1.0,), (9.0,)}
    again = sections.reuse(sections.chunks(df), done, "m")
    assert again.where("embedding IS NULL").isEmpty() and sections.reuse(sections.chunks(df), done, "other").where("embedding IS NOT NULL").isEmpty()


def test_backfill_reads_its_table_once(spark):
    read, sizes = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            read.add(len(pdf))
            yield pdf

    table = spark.range(0, 300, 1, 2).selectExpr("cast(id AS string) AS text", "CASE WHEN id % 3 = 0 THEN array(1.0D) END AS embedding", "CASE WHEN id % 3 = 0 THEN 'old' END AS embed_model").mapInPandas(count, "text string, embedding array<double>, embed_model string")

    def embed(texts):
        sizes.add(1 if len(texts) <= 32 else 1000)
        return [[float(t), 2.0] for t in texts]

    got = sections.backfill(table, embed, "new").where("size(embedding) > 0").collect()
    assert all((r.embedding, r.embed_model) == (([1.0], "old") if int(r.text) % 3 == 0 else ([float(r.text), 2.0], "new")) for r in got) and len(got) == 300
    assert read.value == 300 and 7 <= sizes.value <= 8


def test_tables_of_any_size_are_not_broadcast(spark, capsys):
    df = notes(spark, [("a.md", "x"), ("b.md", "y")])
    table = sections.chunks(df.select("path", F.lit("t").alias("title"), F.col("content").alias("body"))).withColumn("embedding", F.array(F.lit(1.0)).cast("array<float>")).withColumn("embed_model", F.lit("m"))
    events = df.select(F.lit("change").alias("event"), "path", "content", F.lit(1).alias("seq"), F.current_timestamp().alias("ts"))
    for out in (index.apply_chunk_events(table, events, "m"), index.reconcile(df, df), index.unchunked(df, table)):
        out.explain()
        assert "Broadcast" not in capsys.readouterr().out


def test_retry():
    calls, waits = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise sections.Retry("busy", 2.0 if len(calls) == 2 else None)
        return "ok"

    assert sections.with_retry(call, sleep=waits.append) == "ok" and waits == [5.0, 2.0, 20.0]
    with pytest.raises(KeyError):
        sections.with_retry(lambda: {}["x"], sleep=waits.append)


CORPUS = [
    ("20_Projects/nokia.md", "Commande Nokia", "2026-06-24", "Sécurisation de la commande Nokia et du calendrier de livraison. Le budget prévisionnel est validé."),
    ("20_Projects/reunions.md", "Réunions hebdo", "2026-05-02", "Compte rendu des réunions hebdomadaires avec les équipes."),
    ("30_Knowledge/sqlite.md", "Notes SQLite", "2024-01-15", "FTS5 fournit un classement BM25 natif, sans dépendance externe."),
]


def corpus(spark):
    df = spark.createDataFrame(CORPUS, "file string, title string, date string, text string")
    return df.select(F.concat("file", F.lit("#0")).alias("chunk_id"), "file", "title", F.lit("").alias("heading"), "text", "date", F.lit(1).alias("start_line"), F.lit(2).alias("end_line"))


def test_search(spark):
    df = corpus(spark)
    rows, mode, warnings = search.search(spark, df, "commande Nokia", mode="bm25")
    assert rows.first().file == "20_Projects/nokia.md" and rows.first().matches and (mode, warnings) == ("bm25", [])
    assert search.search(spark, df, "reunion", mode="bm25")[0].first().file == "20_Projects/reunions.md"
    rows, mode, warnings = search.search(spark, df, "budget", mode="hybrid")
    assert mode == "bm25" and "answered with BM25 only" in warnings[0] and rows.count() == 1
    words = "commande reunion classement budget"
    assert {r.date for r in search.search(spark, df, words, mode="bm25", since="2026-01-01")[0].collect()} == {"2026-06-24", "2026-05-02"}
    assert [r.file for r in search.search(spark, df, words, mode="bm25", prefix="30_Knowledge")[0].collect()] == ["30_Knowledge/sqlite.md"]
    assert [r.file for r in search.search(spark, df, words, mode="bm25", deny=["20_Projects"])[0].collect()] == ["30_Knowledge/sqlite.md"]
    assert search.search(spark, df, "!!! ?", mode="bm25")[0].count() == 0


def test_query_terms():
    assert search.query_terms("réunion clé a budget") == [("reunion", True), ("cle", False), ("budget", True)] and search.query_terms("!!! ?") == []


def test_fuse(spark):
    lists = spark.createDataFrame([(1, "bm25", 1, 9.0), (2, "bm25", 2, 8.0), (3, "vector", 1, 0.9), (1, "vector", 2, 0.8)], "id int, list string, rank int, score double")
    got = search.fuse(lists).orderBy(F.desc("score"), "id").collect()
    assert got[0].id == 1 and got[0].bm25_rank == 1 and got[0].vector_rank == 2 and got[0].cosine == 0.8
    assert search.fuse(lists, weights={"vector": 3.0}).orderBy(F.desc("score")).first().id == 1
    one = spark.createDataFrame([(1, "bm25", 1, 1.0), (2, "vector", 1, 1.0)], "id int, list string, rank int, score double")
    assert search.fuse(one, weights={"vector": 3.0}).orderBy(F.desc("score")).first().id == 2


def test_snippets(spark):
    df = spark.createDataFrame([("un\nla réunion\n\ntrois\n" + "x" * 400,)], "c string")
    assert df.select(search.snippets(F.col("c"), "reunion")).first()[0] == ["la réunion"]
    got = df.select(search.snippets(F.col("c"), "zzz", 5)).first()[0]
    assert got[:2] == ["un", "la réunion"] and len(got[3]) == 301 and got[3].endswith("…")


def test_rerank():
    c = [{"file": f, "text": f} for f in ("a/1.md", "b/2.md", "c/3.md", "d.md")]
    names = lambda r: [x["file"] for x in r["ordered"]]
    scorer = lambda q, ts: [{"a/1.md": 0.1, "c/3.md": 0.9}.get(t) for t in ts]
    assert names(search.rerank(c, "q", scorer, exclude=("b",))) == ["c/3.md", "a/1.md", "d.md", "b/2.md"]
    assert search.rerank(c, "q", None)["reranked"] == 0 and names(search.rerank(c, "q", scorer, restricted=True)) == [x["file"] for x in c]
    failed = search.rerank(c, "q", lambda *_: 1 / 0)
    assert failed["error"] and names(failed) == [x["file"] for x in c]


def test_comments(spark):
    text = comments.create('say "hi" now\nrest', 'say "hi"', "first\nline \\ two -->", "A B", "2026-01-01T00:00:00.000Z")
    (t,) = comments.threads(text)
    assert (t["status"], t["created_by"], t["anchored_text"], t["quote"]) == ("open", "A_B", 'say "hi"', "say 'hi'")
    assert t["replies"][0]["text"].startswith("first\nline \\ two")
    text = comments.set_status(comments.reply(text, t["id"], "second", "me", "2026-01-02"), t["id"], True)
    (u,) = comments.threads(text)
    assert u["status"] == "resolved" and [r["text"] for r in u["replies"]][1] == "second" and comments.set_status(text, t["id"], True) == text
    assert comments.remove(text, t["id"]) == 'say "hi" now\nrest'
    with pytest.raises(ValueError):
        comments.create("x", "y", "t", "a", "now")
    df = notes(spark, [("a/n.md", text), ("b.md", "none")])
    assert comments.extract(df, folder="a").count() == 1 and comments.extract(df, path="a/n.md", status="open").count() == 0
    assert comments.summary(df).first().files_with_comments_count == 1
    with pytest.raises(ValueError):
        comments.extract(df)
    assert comments.threads(contents(comments.rewrite(df, "a/n.md", lambda c: comments.remove(c, t["id"])))["a/n.md"]) == []


@pytest.mark.parametrize("raw", ["\\n", "\\\\n", "a\nb\r", "\\"])
def test_comment_escapes(raw):
    assert comments.unescape(comments.escape(raw)) == raw


def test_tokens(spark):
    table, key, secret = tokens.create(tokens.empty(spark), "n", "2026-01-01 00:00:00", expires_at="2026-01-05", path_allow=["a//b/"])
    assert tokens.authenticate(table, secret, "2026-01-05").first().path_allow == ["a/b"] and tokens.authenticate(table, secret, "2026-01-06").isEmpty()
    assert tokens.authenticate(table, "wrong", "2026-01-01").isEmpty() and "hash" not in tokens.public(table, "2026-01-06").columns
    assert tokens.authenticate(tokens.revoke(table, key, "2026-01-02 00:00:00"), secret, "2026-01-02").isEmpty()
    for bad in ({"expires_at": "2025-01-01"}, {"scopes": ["root"]}, {"path_deny": ["../x"]}):
        with pytest.raises(ValueError):
            tokens.create(table, "n", "2026-01-01 00:00:00", **bad)
    uses = spark.createDataFrame([(key, "2026-01-02 10:00:05", "1.1.1.1"), (key, "2026-01-02 10:00:50", "2.2.2.2")], "id string, ts string, ip string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert tokens.touch(table, uses).first().last_used_ip == "1.1.1.1"


def test_rules(spark, tmp_path):
    bad = tmp_path / "rules.json"
    bad.write_text("{broken")
    assert webhooks.load(spark, str(tmp_path / "missing.json")).isEmpty() and tokens.load(spark, str(tmp_path / "missing.json")).isEmpty()
    for url in ("http://x.example.com", "https://127.0.0.1/x"):
        with pytest.raises(ValueError):
            webhooks.create(webhooks.empty(spark), url, "2026-01-01")
    r = webhooks.create(webhooks.empty(spark), "https://x.example.com", "2026-01-01", key="k", secret="s")
    assert webhooks.public(r).first().has_secret and webhooks.update(r, "k", "2026-01-02", enabled=False).first().enabled is False
    assert webhooks.remove(r, "k").isEmpty()


def test_delivery():
    seen, waits = [], []
    answers = iter([503, 429, 200])
    assert deliver.send(lambda *a: seen.append(a) or next(answers), "u", b"x", {}, sleep=waits.append) == (200, 3, None) and waits == [1.0, 2.0]
    assert deliver.send(lambda *a: 404, "u", b"x", {}, sleep=waits.append)[:2] == (404, 1)
    assert deliver.send(lambda *a: 1 / 0, "u", b"x", {}, sleep=waits.append)[0] is None
    assert deliver.signature("k", b"m").startswith("sha256=")


def test_gate(spark):
    views = {"files": spark.createDataFrame([("A.md", '{"k":"v"}')], "path string, frontmatter string")}
    run = lambda q, **k: gate.query(spark, views, q, **k)
    assert run("select path from files where path like 'a%'").count() == 1
    assert run("SELECT 1/0 AS x FROM files").first().x is None
    assert run("SELECT path FROM files WHERE path < date('now', '+7 days') OR true").count() == 1
    for q in ("DROP TABLE files", "WITH x AS (SELECT 1) SELECT * FROM x", "SELECT 1; SELECT 2", "", "INSERT INTO files VALUES (1)"):
        with pytest.raises(gate.Refused):
            run(q)
    assert run("WITH x AS (SELECT 1 AS a) SELECT a FROM x", allow_with=True).first().a == 1
    with pytest.raises(gate.Refused):
        run("SELECT 1", restricted=True)
    note = "# Open\n```sql\n-- why\nSELECT path FROM files\n```\n## Other\n```dataview\nLIST\n```"
    assert [s["heading"] for s in gate.sections(note)] == ["Open", "Other"] and gate.run_index(spark, views, note, "open").count() == 1
    assert gate.table_text(views["files"].select("path")) == "path\n----\nA.md"


def test_payload(spark):
    ev = spark.createDataFrame([("add", "a/x.md", "{}", "body")], "event string, path string, frontmatter string, content string").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    rules = webhooks.create(webhooks.empty(spark), "https://x.example.com", "2026-01-01", key="k", folder="a", include_body=True)
    matched = webhooks.match(ev, rules)
    assert matched.first().body == "body"
    report = deliver.deliver(matched, lambda url, body, headers, timeout: 200 if json.loads(body)["body"] == "body" else 500, sleep=lambda s: None)
    assert report.first().status == 200


def test_the_gate_walks_the_plan(spark, tmp_path):
    (tmp_path / "secret.txt").write_text("hidden")
    views = {"files": spark.createDataFrame([("A.md", 1)], "path string, n int")}
    run = lambda q, **k: gate.query(spark, views, q, **k)
    bad = [
        f"SELECT * FROM text.`{tmp_path}`", f"SELECT (SELECT max(value) FROM text.`{tmp_path}`) AS v FROM files", f"SELECT * FROM files WHERE path IN (SELECT value FROM text.`{tmp_path}`)",
        "SELECT reflect('java.lang.System', 'getProperty', 'user.name')", "SELECT java_method('java.lang.System', 'exit', 1) FROM files", "SELECT path FROM files ORDER BY try_reflect('a', 'b')",
        "SELECT * FROM other", "SELECT * FROM spark_catalog.default.files", "SELECT * FROM range(10)", "SELECT * FROM files, LATERAL explode(array(input_file_name()))", "SELECT count(*) FILTER (WHERE reflect('a', 'b') = 'x') FROM files",
        "SELECT EXISTS (SELECT 1 FROM csv.`/etc/passwd`) FROM files", "SELECT path FROM IDENTIFIER('files')", "SELECT session_user()", "SELECT 1; DROP TABLE files",
    ]
    for q in bad:
        with pytest.raises(gate.Refused):
            run(q)
    with pytest.raises(gate.Refused):
        run("WITH files AS (SELECT * FROM parquet.`/x`) SELECT * FROM files", allow_with=True)
    good = {
        "SELECT path FROM files WHERE n IN (SELECT max(n) FROM files) AND EXISTS (SELECT 1 FROM files f WHERE f.n = 1)": 1, "SELECT * FROM (VALUES (1), (2)) AS t(a)": 2, "SELECT upper(path) AS p, count(*) AS c FROM files GROUP BY 1 HAVING count(*) > 0 ORDER BY 1 LIMIT 5": 1,
        "SELECT a.path, row_number() OVER (PARTITION BY a.n ORDER BY a.path) AS r FROM files a LEFT JOIN files b ON a.n = b.n UNION ALL SELECT 'x', 2": 2, "SELECT x FROM files LATERAL VIEW explode(split(path, '[.]')) t AS x": 2, "SELECT CASE WHEN n > 0 THEN trim(path) ELSE coalesce(NULL, 'b') END AS c, date('now') AS d FROM files": 1,
    }
    for q, n in good.items():
        assert run(q).count() == n
    assert run("WITH x AS (SELECT n FROM files) SELECT * FROM x JOIN files USING (n)", allow_with=True).count() == 1


def test_lines_keep_their_digits(spark):
    """A line's own number is not what is trimmed from it."""
    df = spark.createDataFrame([("a.md", "0 total 10\n1 total 21\n  2 total 32  ")], "path string, content string")
    assert search.grep(df, "TOTAL").first().matches == ["0 total 10", "1 total 21", "2 total 32"]
    assert df.select(search.snippets(F.col("content"), "total").alias("m")).first().m == ["0 total 10", "1 total 21", "2 total 32"]


def test_asymmetric_models():
    asked = []

    def embed(texts):
        asked.append(texts)
        return [[1.0]] * len(texts)

    query, passages = sections.asymmetric(embed)
    assert query("a") == [1.0] and passages(["b", "c"]) == [[1.0], [1.0]] and asked == [["query: a"], ["passage: b", "passage: c"]]
    with pytest.raises(ValueError):
        sections.asymmetric(lambda texts: [[1.0]])[1](["b", "c"])


def test_trash_names_stay_apart(spark):
    """Four deletions of one name, three of them at one time: four paths."""
    notes = spark.createDataFrame([("a.md", "0")], "path string, content string")
    for i, now in enumerate(["2026-01-01 00:00:00"] * 4):
        notes = edits.delete(notes, spark.createDataFrame([("a.md",)], "path string"), now)
        notes = notes.unionByName(spark.createDataFrame([("a.md", str(i + 1))], "path string, content string"))
    paths = [r.path for r in notes.collect()]
    assert len(set(paths)) == len(paths) == 5


def test_callers_with_the_same_prefixes_are_one_class(spark):
    from marklake.operators import access

    df = spark.createDataFrame([("a/x.md",), ("b/y.md",), ("b/c/z.md",)], "path string")
    callers = spark.range(50).selectExpr("id", "cast(null AS array<string>) AS path_allow", "IF(id % 2 = 0, array('b/./c/', 'b/c'), array('b/c')) AS path_deny").unionByName(spark.createDataFrame([(99, ["b"], None), (98, ["../x"], [])], "id long, path_allow array<string>, path_deny array<string>"))
    seen, members = access.visible_classes(df, callers)
    assert seen.count() == 4 and members.count() == 51 and members.select("class").distinct().count() == 2
    got = {(r.id, r.path) for r in access.visible(df, callers).collect()}
    assert got == {(i, p) for i in range(50) for p in ("a/x.md", "b/y.md")} | {(99, "b/y.md"), (99, "b/c/z.md")}


def test_rules_with_the_same_conditions_are_met_once(spark):
    rules = spark.range(100).selectExpr("cast(id AS string) AS id", "id <> 7 AS enabled", "'https://h.example/' AS url", "IF(id % 2 = 0, 'a', null) AS folder", "map('k', '1', 'm', '2') AS frontmatter", "IF(id % 4 < 2, null, map()) AS frontmatter_not", "cast(null AS array<string>) AS events", "'s' AS secret", "true AS include_body")
    events = spark.createDataFrame([("add", "a/n.md", '{"k":"1","m":"2"}'), ("add", "b/n.md", '{"m":"2","k":"1"}'), ("add", "a/o.md", "{}")], "event string, path string, frontmatter string").withColumn("ts", F.lit("2026-01-01").cast("timestamp"))
    met, members = webhooks.match_classes(events, rules)
    assert met.count() == 3 and members.count() == 99
    pairs = lambda df: sorted((r[0], r[1]) for r in df.collect())
    assert pairs(met.join(members, "class").select("path", "id")) == pairs(webhooks.match(events, rules).select("path", "webhook_id"))


def test_signatures_of_columns(spark):
    rows = [("k", b"x"), ("é" * 40, b"y"), ("a" * 64, b""), ("", b"z"), (None, b"q"), ("k", None)]
    df = spark.createDataFrame(rows, "k string, b binary").withColumn("s", deliver.signature_of(F.col("k"), F.col("b")))
    assert {r.s for r in df.collect()} == {deliver.signature(k, b) if k is not None and b is not None else None for k, b in rows}
    assert "transform(" not in df._jdf.queryExecution().optimizedPlan().toString()  # no expression for each byte of a key


def test_snippets_fold_a_text_once(spark):
    df = spark.createDataFrame([("  Éa\n\n x thtion \nÓRDER 1\nzz",), ("é\n \nb\nc",), ("",), (None,)], "c string")
    out = df.select(search.snippets(F.col("c"), "order THTION shipped", 2).alias("m"))
    assert [r.m for r in out.collect()] == [["x thtion", "ÓRDER 1"], ["é", "b"], [], None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("translate(") <= 1


def test_words_are_counted_where_a_document_is_read(spark, monkeypatch):
    monkeypatch.setattr(search, "WORDS_AT_ONCE", 3)
    docs = spark.createDataFrame([("a", "Réunion x", "budget validé budget x"), ("b", None, ""), ("c", "y", None), ("d", "", "z " * 9)], "id string, title string, text string").coalesce(1)
    made = search.forward(docs, ["id"], {"title": 3.0, "text": 1.0})
    got = {r.id: (r.length, {t.term: t.tf for t in r.terms}) for r in made.collect()}
    assert got == {"a": (6, {"reunion": 3.0, "x": 4.0, "budget": 2.0, "valide": 1.0}), "b": (0, {}), "c": (1, {"y": 3.0}), "d": (9, {"z": 9.0})}
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()


def test_lists_are_searched_once(spark):
    """What a search returns is made from its candidates: the texts are not counted again for each part of the answer."""
    rows = [(f"{i}#0", f"{i}.md", "T", "", f"budget {i}", None, 1, 1, [1.0, float(i)]) for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id string, file string, title string, heading string, text string, date string, start_line int, end_line int, embedding array<double>")
    out, mode, _ = search.search(spark, chunks, "budget", embed=lambda q: [0.0, 1.0])
    assert mode == "hybrid" and out.count() == 20 and out.first()["matches"][0].startswith("budget ")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<!" not in plan


def test_vectors_travel_in_tiles_and_ties_keep_their_order(spark):
    import numpy as np

    made = np.random.default_rng(5).integers(-2, 3, (300, 3)).astype(float)  # many equal and parallel ones
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(made)], "vec_id long, embedding array<float>")
    good = [i for i in range(300) if made[i].any()]
    unit = made[good] / np.linalg.norm(made[good], axis=1)[:, None]
    score = np.round(unit @ unit.T, 9)
    got = search.vector_topk_batch(df, df, 4, block=7).collect()
    want = {(good[q], good[i], r + 1) for q in range(len(good)) for r, i in enumerate(sorted(range(len(good)), key=lambda i, q=q: (-score[q, i], good[i]))[:4])}
    assert {(r.query, r.id, r.rank) for r in got} == want
    tiles = search._blocks(df, 1, "vec_id", "embedding").first()
    assert len(tiles.matrix) == len(good) * 3 * 4  # in their own type


def test_turns_are_cut_without_one_tasks_window(spark):
    from marklake.plans.more_queries import _in_turns

    df = spark.range(300).select((F.col("id") * 7 % 300).alias("seq"))
    cut = _in_turns(df, 3)
    assert [(r.turn, r.n, r.a) for r in cut.groupBy("turn").agg(F.count("*").alias("n"), F.min("seq").alias("a")).orderBy("turn").collect()] == [(0, 100, 0), (1, 100, 100), (2, 100, 200)]
    assert "Window" not in cut._jdf.queryExecution().executedPlan().toString()
    assert _in_turns(df.limit(0), 3).count() == 0


def test_comments_are_handled_a_few_at_a_time(spark):
    note = comments.create("a span b", "span", "said", "ann", "2026-01-01")
    df = spark.range(0, 600, 1, 1).select(F.when(F.col("id") % 3 > 0, F.lit(note)).alias("content"), "id")
    assert comments.AT_ONCE < 600
    got = df.select("id", comments.parse("content").alias("t")).collect()
    assert len(got) == 600 and all([x.anchored_text for x in r.t] == (["span"] if r.id % 3 else []) for r in got)
    assert df.select(comments.by_few(lambda c: c, "string")("content").alias("c")).where("c IS NULL").count() == 200


def test_rows_are_numbered_where_they_lie(spark):
    df = spark.range(0, 1000, 1, 7).withColumn("k", F.pmod(F.col("id") * 377, F.lit(1000)))
    got = listing.numbered(df.repartition(5).sortWithinPartitions("id").orderBy("k"), "r").collect()
    assert sorted((r.k, r.r) for r in got) == [(i, i + 1) for i in range(1000)] and listing.numbered(df.where("id < 0").orderBy("k"), "r").count() == 0


def test_words_are_told_from_bytes(spark):
    """Counts of given terms equal those that patterns find, for letters of any script and texts that touch in memory."""
    odd = ["order orders order", "reorder border", "", None, "Réunion_reunion ÓRDER’order", "x" * 2400, "order", "日本order 語 order—x", "éte ÉTÉ 12order", "ord", "x·order·y"]
    rows = [(i, odd[i % len(odd)], odd[(i * 7 + 3) % len(odd)]) for i in range(len(odd) * 5)]
    docs = spark.createDataFrame(rows, "id long, title string, text string").coalesce(1)
    fields, terms = {"title": 3.0, "text": 1.0}, [("order", True), ("order", False), ("ete", True), ("日本order", False), ("x", True)]
    made = search._counted(docs, fields, terms)
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, search._matched(docs, fields, terms).collect()))
    assert "regexp_count" not in made._jdf.queryExecution().optimizedPlan().toString().lower()


def test_chunks_bring_what_their_note_has(spark):
    df = spark.createDataFrame([(f"{i}.md", "T", "# A\n" + f"word {i} " * 600, f"2026-01-{i:02d}") for i in range(1, 20)] + [("e.md", "E", None, None)], "path string, title string, body string, date string")
    cut = sections.chunks(df, keep=("date",), embed=lambda texts: [[float(len(t))] for t in texts])
    got = cut.collect()
    assert len(got) > 40 and all(r.date == (None if r.file_path == "e.md" else f"2026-01-{int(r.file_path[:-3]):02d}") and r.embedding == [len(r.text)] for r in got)
    assert "Join" not in cut._jdf.queryExecution().optimizedPlan().toString()


def test_postings_are_turned_round_where_words_are_read(spark, monkeypatch):
    from marklake.operators import lexical

    monkeypatch.setattr(lexical, "IN_ROW", 3)
    docs = spark.range(0, 40, 1, 3).selectExpr("concat('n', id) AS owner", "concat('n', id, '#0') AS id", "concat('order ', id % 4, ' order ', repeat('x', CAST(id AS int)), IF(id % 9 = 0, '', ' ñandú')) AS text").unionByName(spark.createDataFrame([("e", "e#0", "")], "owner string, id string, text string"))
    words = search.forward(docs, ["owner", "id"], {"text": 1.0})
    made = lexical._packed(words)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert made.agg(F.max(F.size("docs"))).first()[0] == 3
    flat = lambda df: sorted(map(tuple, df.collect()))
    want = words.select("owner", "id", "length", F.inline("terms")).select("term", "owner", "id", "tf", "length")
    assert flat(made.select("term", F.inline("docs")).select("term", "owner", "id", "tf", "length")) == flat(want)
    assert lexical._packed(words.where("id = 'e#0'")).count() == 0


def test_equal_documents_of_an_index_score_the_same(spark, tmp_path):
    from marklake.operators.lexical import LexicalIndex

    docs = spark.range(0, 300, 1, 4).selectExpr("concat('n', id) AS owner", "concat('n', id, '#0') AS id", "'budget order orders thtion attion attions budgets border' AS text")
    index = LexicalIndex(spark, f"file://{tmp_path}/i")
    index.apply(docs.unionByName(spark.createDataFrame([("z", "z#0", "nothing here")], "owner string, id string, text string")), 0)
    got = index.bm25("thtion attion budget order", owners=docs.where("owner <> 'n7'").select("owner"))
    assert got.count() == 299 and got.select("score").distinct().count() == 1
    assert index.bm25("! ?").count() == 0
