import pytest
from pyspark.sql import functions as F

from marklake.functions import paths as P
from marklake.functions import text as T
from marklake.functions import yaml as Y


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} string" for n in names))
    return df.select(column.alias("x")).first()[0]


def text(spark, f, value):
    return one(spark, f(F.col("t")), t=value)


def test_front_matter_grammars(spark):
    at_end = "---\nk: v\n---"
    assert text(spark, lambda c: T.front_matter(c, "index"), at_end) == "k: v"
    assert text(spark, lambda c: T.front_matter(c, "api"), at_end) is None
    assert text(spark, lambda c: T.body(c, "api"), "---\nk: v\n---\nbody\n") == "body\n"
    assert text(spark, T.front_matter, "---\n---\n") is None
    assert text(spark, T.front_matter, "---\r\nk: v\r\n---\r\n") is None


def test_tags(spark):
    assert text(spark, T.inline_tags, "#a b#c #réunion\n#x/y_z-1 #n `#code`") == ["a", "r", "x/y_z-1", "n"]
    front = F.array(F.lit("b"), F.lit("a"))
    assert text(spark, lambda c: T.all_tags(front, c), "#a #c #c") == ["b", "a", "c"]


def test_tasks(spark):
    got = text(spark, T.task_lines, "- [ ] one 📅 2026-01-02\n  - [X] two due:: 2026-99-99\n- [ ] cr\r\n-[ ] no\n- [ ] ")
    assert [(r.pos, r.text, r.completed, r.due) for r in got] == [(0, "one 📅 2026-01-02", 0, "2026-01-02"), (1, "two due:: 2026-99-99", 1, "2026-99-99")]


def test_loose_tasks(spark):
    got = text(spark, lambda c: T.loose_tasks(c, True), "- [x]  a [due:: 1]  b [p]\n-  [ ]\ntext")
    assert [(r.line, r.completed, r.text, r.tags) for r in got] == [(1, True, "a b", ["due:: 1", "p"]), (2, False, "", [])]


def test_links(spark):
    got = text(spark, T.link_targets, "[[#heading]] [[a/b/Note|x]] ![[ c #h]] [[\n]] [[]]")
    assert [(r.raw, r.target) for r in got] == [("a/b/Note|x", "a/b/Note"), (" c #h", "c")]


@pytest.mark.parametrize(("value", "day"), [("2026-99-99x", "2026-99-99"), ("January 5, 2026", "2026-01-05"), ("2026/01/05", "2026-01-05"), ("soon", None), ("", None), (None, None)])
def test_day_of(spark, value, day):
    assert text(spark, T.day_of, value) == day


def test_real_dates(spark):
    assert [text(spark, T.is_real_date, v) for v in ("2026-02-28", "2026-02-30", "2026-2-3", None)] == [True, False, False, False]


def test_fold_and_tokens(spark):
    assert text(spark, T.tokens, "Réunions: l'été, ÇA!") == ["reunions", "l", "ete", "ca"]


@pytest.mark.parametrize(("path", "out"), [("a//b/./c/../d/", "a/b/d"), ("../../etc/passwd", None), ("a\\b", None), ("", ""), ("/x", "x"), ("a/..", "")])
def test_canonical(spark, path, out):
    assert text(spark, P.canonical, path) == out


@pytest.mark.parametrize(
    ("path", "prefix", "out"),
    [("20_Projects/Pro/MEN/note.md", "20_Projects/Pro", True), ("10_Context/Perso2/x.md", "10_Context/Perso", False), ("20_Projects/Pro/../../10_Context/Perso/x.md", "20_Projects/Pro", False), ("20_Projects/Pro/MEN/../a.md", "20_Projects/Pro", True), ("x", "", True), ("../x", "", False)],
)
def test_under(spark, path, prefix, out):
    assert one(spark, P.under(F.col("p"), F.col("q")), p=path, q=prefix) is out


def test_access(spark):
    f = lambda test, path, allow, deny: one(spark, test(F.col("p"), allow, deny), p=path)
    assert f(P.can_access_file, "a/b/n.md", ["a"], []) and not f(P.can_access_file, "a/b/n.md", ["a"], ["a/b"])
    assert not f(P.can_access_file, "a", ["a/b"], []) and f(P.can_access_path, "a", ["a/b"], [])
    assert not f(P.can_access_tree, "a", ["a/b"], []) and not f(P.can_access_tree, "a", [], ["a/b/c"])
    assert f(P.can_access_tree, "a/b", [], ["a/c"])


@pytest.mark.parametrize(
    ("glob", "path", "out"),
    [("20_Projects/*/notes", "20_Projects/alpha/notes/idea.md", True), ("20_Projects/*/notes", "20_Projects/alpha/extra/notes/idea.md", False), ("", "x.md", True), ("a/**/b", "a/xb", True), ("a?c", "abc/n.md", True), ("/a/", "a/n.md", True), ("a", "ab/n.md", False)],
)
def test_glob(spark, glob, path, out):
    assert text(spark, lambda c: F.rlike(c, F.lit(P.glob_regex(glob))), path) is out


def test_private_hosts(spark):
    private = ["127.0.0.1", "10.1.2.3", "192.168.0.1", "172.16.0.1", "172.31.9.9", "169.254.1.1", "0.0.0.0", "100.64.0.1", "::1", "fe80::1", "fd00::1", "::ffff:10.0.0.1"]
    public = ["8.8.8.8", "172.32.0.1", "1.1.1.1", "2606:4700::1111"]
    assert all(text(spark, P.is_private_host, h) for h in private) and not any(text(spark, P.is_private_host, h) for h in public)
    urls = {"https://example.com/x": True, "http://example.com": False, "https://localhost/": False, "https://10.0.0.1/": False, "nonsense": False}
    assert {u: text(spark, P.url_allowed, u) for u in urls} == urls


def test_yaml():
    assert Y.parse("created: 2026-01-02\nb: yes\nt: 1:30\nn: 3\nl: [a, 1]\nf: true") == '{"created":"2026-01-02T00:00:00.000Z","b":"yes","t":"1:30","n":3,"l":["a",1],"f":true}'
    assert Y.parse("- a") is None and Y.parse("a: [") is None
    assert Y.dump('{"a":1,"b":["x"]}') == "---\na: 1\nb:\n- x\n---\n" and Y.dump("{}") == ""


def test_fm_matches(spark):
    fm = '{"tags":["home","work"],"s":"x"}'
    f = lambda k, v: text(spark, lambda c: Y.fm_matches(c, k, F.lit(v)), fm)
    assert f("tags", "work") and not f("tags", "other") and f("s", "x") and not f("missing", "x") and f("missing", "")


def test_uri(spark):
    assert text(spark, lambda c: T.note_uri(F.lit("my vault"), c), "a b/é.md") == "note://open?vault=my%20vault&file=a%20b%2F%C3%A9"


def test_front_matter_is_found_as_the_patterns_read_it(spark):
    import re
    import time

    patterns = {"api": re.compile(r"\A---\n([\s\S]*?)\n---\n([\s\S]*)\Z"), "index": re.compile(r"\A---\n([\s\S]*?)\n---\n?([\s\S]*)\Z")}
    texts = ["---\na: 1\n---\nx", "---\na: 1\n---x\n---\ny", "---\n\n---", "---\n---\nx", "--- \na\n---\n", "---\né😀: b\n---\n\nz", "x---\na\n---\n", "", "---\n", "---\na\n--\n---"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    for mode, pattern in patterns.items():
        for r in df.select("c", T.front_matter(F.col("c"), mode).alias("y"), T.body(F.col("c"), mode).alias("b")).collect():
            m = pattern.match(r.c)
            assert (r.y, r.b) == ((m[1], m[2]) if m else (None, r.c))
    long = spark.range(3000).select(F.concat(F.lit("---\na: 1\n---\n"), F.repeat(F.lit("word "), 8000)).alias("c")).cache()
    long.count()
    began = time.time()
    assert long.agg(F.sum(F.length(T.body(F.col("c"))))).first()[0] == 3000 * 40000
    assert time.time() - began < 8  # a pattern over the whole text takes many times that


def test_simple_front_matter_skips_the_parser(monkeypatch):
    texts = ['title: Order 5\nstatus: F\npriority: "1-URGENT"\ncreated: 1996-01-02\nn: 12\n', "a: yes\nb: x/y.md\n\na: z"]
    odd = ["a: true", "a: Null", "a: b: c", "a: b #c", "a: 2026-13-02", "a: 007", "a: b\n  more", "- a", "a: 1e5", 'a: "\\n"', "null: x", ""]
    fast = [Y.parse(t) for t in texts + odd]
    assert all(Y._simple(t) for t in texts) and not any(Y._simple(t) for t in odd)
    monkeypatch.setattr(Y, "_simple", lambda t: None)
    assert fast == [Y.parse(t) for t in texts + odd]
