"""Every registered query against its SQL on the smallest tables, where they are at hand."""

import os

import duckdb
import pytest

from scenegrain.queries import data_quality, files, pixels, records
from tools_verify import canon

DATA = "/root/testdata/sf0.001"
CASES = [(n, m) for m in (records, pixels, data_quality, files) for n in m.oracle_sql()]


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no tables here")
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


@pytest.mark.parametrize("name,module", CASES, ids=[n for n, _ in CASES])
def test_query_equals_its_sql(spark, con, name, module):
    got, want = module.queries()[name](spark, DATA).toPandas(), con.sql(module.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)
