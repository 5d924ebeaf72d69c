"""Registered corpus queries against their SQL on small tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")

from millrace.llm.queries import QUERIES, SQL  # noqa: E402


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, name):
    connection = duckdb.connect()
    for file in os.listdir(DATA):
        connection.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    wanted = connection.execute(SQL[name])
    columns = sorted(d[0] for d in wanted.description)
    order = [[d[0] for d in wanted.description].index(c) for c in columns]
    want = sorted(map(repr, [tuple(row[i] for i in order) for row in wanted.fetchall()]))
    got = QUERIES[name](spark, DATA)
    assert sorted(got.columns) == columns
    assert sorted(map(repr, [tuple(row) for row in got.select(*columns).collect()])) == want
