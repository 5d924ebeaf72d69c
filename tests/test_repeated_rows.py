"""Queries and their SQL on tables in which every row comes up many times."""

import pytest

duckdb = pytest.importorskip("duckdb")

from millrace.plans.catalog import QUERIES, SQL  # noqa: E402

COPIES = 40


@pytest.fixture(scope="module")
def orders(tmp_path_factory):
    """Forty copies of each order; dates of a customer are 20 or 100 days apart and hold one status or two."""
    folder = tmp_path_factory.mktemp("copies")
    duckdb.sql(
        f"""COPY (SELECT k * {COPIES} + i AS o_orderkey, k // 12 AS o_custkey, CASE WHEN k % 5 < 2 THEN 'F' ELSE 'O' END AS o_orderstatus,
  TIMESTAMP '1994-01-01' + to_days(((k % 12) // 2 * 20 + (k % 12) // 6 * 100)::INTEGER) AS o_orderdate
FROM range(6000) a(k), range({COPIES}) b(i)) TO '{folder}/orders.parquet'"""
    )
    return str(folder)


@pytest.mark.parametrize("name", ["segments_by_label_and_gap", "usable_segments"])
def test_segments_of_repeated_rows(spark, orders, name):
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW orders AS SELECT * FROM '{orders}/orders.parquet'")
    got = QUERIES[name](spark, orders)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(connection.execute(f"SELECT {columns} FROM ({SQL[name]})").fetchall())
    # No segment starts between copies of a row.
    assert connection.execute(f"SELECT count(*) FROM ({SQL[name]}) WHERE rows % {COPIES} <> 0").fetchall() == [(0,)]
