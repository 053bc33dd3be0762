import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def odd_tables(folder, change):
    for name in os.listdir(DATA):
        table = pq.read_table(f"{DATA}/{name}")
        pq.write_table(change(table), f"{folder}/{name}")
    return str(folder)


def nothing(table):
    return table.slice(0, 0)


def dirty(table):
    """Rows, rows of nulls, and some rows again."""
    nulls = pa.table({c: pa.nulls(4, table.schema.field(c).type) for c in table.column_names}, schema=table.schema)
    return pa.concat_tables([table.slice(0, 60), nulls, table.slice(0, 9)])


@pytest.mark.parametrize("change", [nothing, dirty])
def test_every_query_takes_odd_tables(spark, tmp_path, change):
    folder = odd_tables(tmp_path, change)
    failed = {}
    for name, query in entry.queries().items():
        try:
            query(spark, folder).collect()
        except Exception as e:
            failed[name] = f"{type(e).__name__}: {str(e)[:200]}"
    assert not failed
