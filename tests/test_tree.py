from marklake.sources import tree
from marklake.streaming import pipeline


def test_listing_by_tasks_over_many_files(spark, tmp_path):
    """10,000 files in 120 folders: all added, then one of each change; only changed folders are compared."""
    root, state = tmp_path / "vault", f"file://{tmp_path}/state"
    for i in range(100):
        (root / f"f{i}" / ("deep" if i % 5 == 0 else ".")).mkdir(parents=True, exist_ok=True)
        for j in range(100):
            (root / f"f{i}" / ("deep" if i % 5 == 0 and j % 2 else ".") / f"{j}.md").write_text(f"{i} {j}")
    (root / ".hidden").mkdir()
    (root / ".hidden" / "x.md").write_text("no")
    (root / "picture.png").write_text("no")
    (root / "Große.MD").write_bytes(b"\xff top")
    first = tree.poll(spark, f"file://{root}", state, 0)
    got = first.groupBy("event").count().collect()
    assert [(r.event, r["count"]) for r in got] == [("add", 10_001)]
    assert first.where("path = 'f5/deep/3.md'").first().content == "5 3" and first.where("path = 'Große.MD'").first().content == "� top"
    (root / "f1" / "7.md").write_text("changed")
    (root / "f5" / "deep" / "3.md").unlink()
    (root / "f2" / "new").mkdir()
    (root / "f2" / "new" / "n.md").write_text("n")
    want = [("add", "f2/new/n.md", "n"), ("change", "f1/7.md", "changed"), ("unlink", "f5/deep/3.md", None)]
    for _ in range(2):  # a repeated turn sees the same
        assert sorted((r.event, r.path, r.content) for r in tree.poll(spark, f"file://{root}", state, 1).collect()) == want
    assert tree.poll(spark, f"file://{root}", state, 2).isEmpty()
    old, new = (spark.read.schema(tree.LISTING).parquet(f"{state}/{t}") for t in (1, 2))
    assert tree.changes(old, new).isEmpty()


def test_listing_feeds_the_index(spark, tmp_path):
    root, state = tmp_path / "vault", f"file://{tmp_path}/state"
    (root / "a").mkdir(parents=True)
    (root / "a" / "1.md").write_text("---\ntitle: One\n---\n- [ ] do")
    store = pipeline.Store(spark, f"file://{tmp_path}/store", buckets=2)
    pipeline.batch(store, tree.poll(spark, str(root), state, 0), 0)
    assert [r.title for r in store.table("files").collect()] == ["One"]
    (root / "a" / "1.md").unlink()
    pipeline.batch(store, tree.poll(spark, str(root), state, 1), 1)
    assert store.table("files").isEmpty() and tree.poll(spark, str(tmp_path / "none"), f"{state}2", 0).isEmpty()
