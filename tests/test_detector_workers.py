"""Scoring a task's windows takes few Python workers, whatever the number of steps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.forest import grow_tree
from millrace.plans import detector
from millrace.plans.detector import Model, Options, calibrated, raw_scores, references_of
from millrace.session import settle

WIDTH = 6
RAW = ["errors", "autoencoder_raw", "isolation_raw"]


def model_and_vectors(spark, family):
    """A made-up model of two groups, and rows of these and of a group that it lacks."""
    rng = np.random.default_rng(5)
    groups = ["a", "b"]

    def table(label, columns, rows):
        return settle(spark.createDataFrame(rows, columns), label)

    entries = lambda: rng.uniform(0.5, 2, WIDTH).tolist()
    tables = {
        "scaler": table("scaler", "group string, center array<double>, spread array<double>", [(g, entries(), entries()) for g in groups]),
        "subspace": table(
            "subspace", "group string, rows long, mean array<double>, basis array<array<double>>",
            [(g, 9, entries(), np.linalg.qr(rng.normal(size=(WIDTH, 2)))[0].T.tolist()) for g in groups],
        ),
        "scales": table("scales", "group string, scale array<double>", [(g, entries()) for g in groups]),
    }
    grown = [(g, t, 32, *[[*map(kind, v)] for kind, v in zip((int, float, int, int, float), grow_tree(rng.normal(size=(32, WIDTH)), rng).values(), strict=True)]) for g in groups for t in range(7)]
    tables["forest"] = table("forest", "group string, tree int, sample long, feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>", grown)
    if family == "pooled":
        del tables["scales"]
    x = np.round(rng.normal(size=(400, WIDTH)), 2)
    x[3, 1], x[4, 2] = np.nan, np.inf
    rows = spark.createDataFrame([(i, "abc"[i % 3], v.tolist()) for i, v in enumerate(x)], "i int, group string, vector array<double>")
    return Model(Options(family=family), [], {}, {}, 0.9, tables), rows.repartition(3)


def same(one, other):
    return np.array_equal(np.array(one, dtype=float), np.array(other, dtype=float), equal_nan=True)


@pytest.mark.parametrize("family", ["contextual", "pooled"])
def test_one_worker_scores_as_the_steps_do(spark, monkeypatch, family):
    model, rows = model_and_vectors(spark, family)
    columns = ["i", "group", "vector", "raw_vector", *RAW]
    together = raw_scores(rows, model).select(*columns).orderBy("i").collect()
    marks = raw_scores(rows, model, RAW[1:]).select("i", *RAW[1:]).orderBy("i").collect()
    monkeypatch.setattr(detector, "sendable", lambda tables: False)
    steps = raw_scores(rows, model).select(*columns).orderBy("i").collect()
    assert len(together) == len(steps) == len(marks) == sum(i % 3 < 2 for i in range(400))
    for a, b, c in zip(together, steps, marks, strict=True):
        assert (a.i, a.group) == (b.i, b.group) and a.i == c.i
        assert same(a.vector, b.vector) and same(a.raw_vector, b.raw_vector)
        assert all(same(a[n], b[n]) for n in RAW) and all(same(a[n], c[n]) for n in RAW[1:])


@pytest.mark.parametrize("family", ["contextual", "pooled"])
def test_scores_take_two_python_workers_a_task(spark, family):
    model, rows = model_and_vectors(spark, family)
    model.tables["references"] = settle(references_of(raw_scores(rows.filter("i not in (3, 4)"), model)), "references")
    scored = calibrated(raw_scores(rows, model), model.tables["references"], model.options).select("i", "errors", "irregularity")
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("ArrowEvalPython") <= 2
    assert scored.filter(F.col("irregularity").between(0, 1)).count() >= 266 - 2
