import os

import pytest

import __spark_entry__ as entry
from marklake.plans import queries as core

DATA = "/root/testdata/sf0.001"


def test_registered_names():
    q = entry.queries()
    assert set(entry.oracle_sql()) <= set(q) and set(core.queries()) <= set(q) and len(core.queries()) > 90


def plain(rows):
    fix = lambda v: None if v is None else round(float(v), 5) if isinstance(v, float) else str(v)
    return sorted(str([fix(v) for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_queries_agree_with_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    df = core.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    want = c.sql(f"SELECT {', '.join(chr(34) + x + chr(34) for x in columns)} FROM ({core.oracle_sql()[name]})").fetchall()
    got = df.select(*columns).collect()
    assert got and plain(got) == plain(want)
