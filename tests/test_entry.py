import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("set TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    got = df.select(*sorted(df.columns)).collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    r = duck.execute(sql)
    names = [c[0] for c in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    assert [names[i] for i in order] == sorted(df.columns)
    key = lambda t: tuple((x is not None, str(round(x, 6) if isinstance(x, float) else x)) for x in t)
    assert sorted(key(t) for t in got) == sorted(key([t[i] for i in order]) for t in r.fetchall())
