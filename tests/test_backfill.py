import time


from marklake.operators.sections import Retry
from marklake.streaming import backfill


def test_backfill_waits_and_survives_a_restart(spark, tmp_path):
    """Texts that fail come back by a timer, also in a new query; a final error stops the provider until it is told to go on."""
    source, out, marks = tmp_path / "in", tmp_path / "out", tmp_path / "marks"
    for p in (source, marks):
        p.mkdir()
    calls, down, broken = str(marks / "calls"), str(marks / "down"), str(marks / "broken")

    def embed(texts):
        import os

        with open(calls, "a") as f:
            f.write("|".join(texts) + "\n")
        if os.path.exists(broken):
            raise ValueError("bad key")
        if os.path.exists(down):
            raise Retry("busy")
        return [[float(len(t))] for t in texts]

    def put(name, rows):
        spark.createDataFrame(rows, "content_hash string, text string").coalesce(1).write.mode("append").json(str(source))

    def sink(df, turn):
        df.write.mode("overwrite").parquet(f"{out}/{turn}")

    def rows():
        try:
            return {(r.content_hash, r.error): r.embedding for r in spark.read.schema(backfill.RESULT).option("recursiveFileLookup", "true").parquet(str(out)).collect()}
        except Exception:
            return {}

    def run():
        stream = spark.readStream.schema("content_hash string, text string").json(str(source))
        return backfill.start(spark, stream, sink, str(tmp_path / "check"), embed, "m", trigger={"processingTime": "300 milliseconds"}, buckets=1, first=0.2, most=1.0)

    def wait(test, q):
        end = time.time() + 90
        while time.time() < end:
            if q.exception():
                raise q.exception()
            if test():
                return True
            time.sleep(0.3)
        return False

    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    (marks / "down").touch()
    put("a", [("h1", "one"), ("h2", "three")])
    q = run()
    try:
        assert wait(lambda: (marks / "calls").exists() and len((marks / "calls").read_text().splitlines()) >= 3, q)  # it comes back by itself
        q.stop()
        assert rows() == {}
        (marks / "down").unlink()
        q = run()  # no new input: the waiting texts are in the state
        assert wait(lambda: rows() == {("h1", None): [3.0], ("h2", None): [5.0]}, q)
        (marks / "broken").touch()
        put("b", [("h3", "x")])
        assert wait(lambda: ("h3", "bad key") in rows(), q)
        (marks / "broken").unlink()
        n = len((marks / "calls").read_text().splitlines())
        put("c", [("h4", "yy")])
        time.sleep(3)
        assert len((marks / "calls").read_text().splitlines()) == n  # stopped
        put("d", [("", "")])
        assert wait(lambda: rows().get(("h3", None)) == [1.0] and rows().get(("h4", None)) == [2.0], q)
    finally:
        q.stop()
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
