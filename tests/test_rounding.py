"""Rounded values are computed once per row."""

from pyspark.sql import functions as F

from millrace.plans.views import rounded


def test_rounded_values_have_no_negative_zero_and_are_written_once(spark):
    df = spark.createDataFrame([(-1e-9,), (-0.0,), (1.23456789,), (-2.5,), (None,), (float("inf"),)], "x double").select(rounded("x").alias("x"))
    got = [r.x for r in df.collect()]
    assert [str(v) for v in got] == ["0.0", "0.0", "1.234568", "-2.5", "None", "inf"]
    assert df.schema["x"].dataType.simpleString() == "double"
    plan = df.select(F.col("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == 1
