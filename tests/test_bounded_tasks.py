"""Relations compared in tasks of bounded size, and windows that meet their asset's bounds unsorted."""

import os

import pytest
from pyspark.sql import functions as F

from millrace.operators import features, joins
from millrace.plans import window_queries

DATA = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_known_sizes_set_the_number_of_tasks(spark, monkeypatch):
    left = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    right = left.filter("id % 100 > 0").union(left.filter("id < 3")).union(spark.createDataFrame([(5, None)], "id long, k long"))
    plain = sorted(joins.unmatched_rows(left, right).collect(), key=str)
    monkeypatch.setattr(joins, "TASK_ROWS", 150)
    dealt = joins.unmatched_rows(left, right, rows=1100)
    assert sorted(dealt.collect(), key=str) == plain and plain
    assert ", 15), REPARTITION_BY_NUM" in plan_of(dealt)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_windows_of_many_cells_are_not_sorted_for_their_bounds(spark, monkeypatch):
    few = window_queries.tail_equality(spark, DATA).collect()
    monkeypatch.setattr(features, "SORTED_CELLS", 0)
    monkeypatch.setattr(window_queries, "SORTED_CELLS", 0)
    many = window_queries.tail_equality(spark, DATA)
    assert plan_of(many).count("ShuffledHashJoin") >= 3
    assert many.collect() == few and few[0].unmatched == 0 < few[0].complete_windows
