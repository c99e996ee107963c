import pytest

from marklake.functions import udtf
from marklake.operators.access import Denied, needed_scope, require


def test_scopes_and_targets(spark):
    who = {"scopes": ["write"], "path_allow": ["a"], "path_deny": ["a/x"]}
    assert [needed_scope(o) for o in ("search", "patch", "create_token")] == ["read", "write", "admin"]
    require(spark, who, "read", ["a/n.md", "a/b/n.md"])
    require(spark, {"scopes": ["admin"]}, "create_token")
    for operation, targets in (("read", ["a/n.md", "b.md"]), ("read", ["a/x/n.md"]), ("delete_folders", ["a"]), ("create_token", []), ("query", [])):
        with pytest.raises(Denied):
            require(spark, who, operation, targets)
    with pytest.raises(Denied):
        require(spark, {"scopes": ["read"]}, "patch", ["x.md"])


def test_table_functions(spark):
    udtf.register(spark)
    note = '[[A|b]] [[#h]]\n- [x] do due:: 2026-01-02\n<!--co:k by:me at:t status:open quote:"q"\nme (t): hi\n-->'
    df = spark.createDataFrame([(note,)], "content string")
    run = lambda f: [tuple(r) for r in spark.sql(f"SELECT x.* FROM {{df}}, LATERAL {f}(content) x", df=df).collect()]
    assert run("md_links") == [("A|b", "A")] and run("md_tasks") == [(1, "do due:: 2026-01-02", 1, "2026-01-02")]
    assert run("md_comments") == [("k", "open", "q", None, "me", "t", "hi")] and len(run("md_chunks")) == 1
