"""Work by entry inside tasks against the plain rule, with arrays of several widths, nulls and ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.reconstruction import row_error, tail_score
from millrace.operators.vectors import apply_scaler


def plain_tail(errors, scale, k):
    ratios = [None if e is None else e / s for e, s in zip(errors, scale, strict=True)]
    ranked = sorted(range(len(ratios)), key=lambda i: (ratios[i] is not None, ratios[i] or 0.0, i))[-k:]
    marked = [(None if r is None else r / len(ranked)) if i in ranked else 0.0 for i, r in enumerate(ratios)]
    return None if None in marked else float(np.cumsum([0.0, *marked])[-1]), marked


def test_tails_means_and_scales(spark):
    rng = np.random.default_rng(4)
    errors = [np.round(rng.random(w), 1).tolist() for w in (9, 3, 9, 2, 9)] + [[1.0, None, 2.0, 2.0, 2.0], [None, None, 3.0], [], None]
    rows = [(i, e, None if e is None else [0.5 + (j % 2) for j in range(len(e))]) for i, e in enumerate(errors)]
    df = spark.createDataFrame(rows, "i int, errors array<double>, scale array<double>").repartition(2)
    got = {r.i: r for r in df.select("*", tail_score(F.col("errors"), F.col("scale"), 3).alias("tail"), row_error(F.col("errors")).alias("mean")).collect()}
    for i, e, s in rows:
        if e is None:
            assert got[i].tail.score is None and got[i].tail.contributions is None and got[i].mean is None
            continue
        assert (got[i].tail.score, got[i].tail.contributions) == plain_tail(e, s, 3)
        assert got[i].mean == (None if None in e or not e else np.cumsum([0.0, *e])[-1] / len(e))


def test_scaling_of_short_and_missing_vectors(spark):
    rows = [("a", 0, [1.0, 2.0]), ("a", 1, [3.0, None]), ("a", 2, [5.0]), ("a", 3, None), ("b", 4, [1.0, 1.0]), (None, 5, [1.0, 1.0])]
    scaler = spark.createDataFrame([("a", [1.0, 1.0], [2.0, 4.0])], "g string, center array<double>, spread array<double>")
    df = spark.createDataFrame(rows, "g string, i int, vector array<double>")
    got = {r.i: r.vector for r in apply_scaler(df, scaler, ["g"]).collect()}
    assert got == {0: [0.0, 0.25], 1: [1.0, None], 2: [2.0, None], 3: None}


@pytest.mark.parametrize("work", ["scaler", "tail", "mean"])
def test_no_lambda_over_every_entry(spark, work):
    """A lambda is evaluated for every entry of every window, which took most of the time of scoring."""
    df = spark.createDataFrame([("a", [1.0, 2.0], [1.0, 2.0], [1.0, 2.0])], "g string, vector array<double>, center array<double>, spread array<double>")
    made = {
        "scaler": lambda: apply_scaler(df.select("g", "vector"), df.select("g", "center", "spread"), ["g"]),
        "tail": lambda: df.select(tail_score(F.col("vector"), F.col("spread"))),
        "mean": lambda: df.select(row_error(F.col("vector"))),
    }[work]()
    assert "lambda" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
