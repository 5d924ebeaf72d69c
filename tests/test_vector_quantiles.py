"""Quantiles of vector entries by counting against numpy, for every way of narrowing."""

import math

import numpy as np
import pytest

from millrace.operators.vector_quantiles import vector_quantiles


def table(spark, blocks):
    rows = [(g, h, [None if v is None else float(v) for v in x] if x is not None else None) for (g, h), block in blocks.items() for x in block]
    return spark.createDataFrame(rows, "g string, h int, vector array<double>").repartition(3)


def want(values, p):
    known = sorted(v for v in values if v is not None)
    if not known:
        return None
    at = p * (len(known) - 1)
    low, high = known[math.floor(at)], known[math.ceil(at)]
    return low if low == high else low + (high - low) * (at - math.floor(at))


@pytest.mark.parametrize(("bins", "state_entries", "sent_values"), [(64, 10**6, 10**6), (64, 10**6, 0), (3, 10**6, 200), (64, 0, 0)])
def test_quantiles_equal_sorting(spark, bins, state_entries, sent_values):
    rng = np.random.default_rng(bins + sent_values)
    scales = np.array([1e-300, 1.0, 1e300, 1.0, 1.0])
    blocks = {
        ("a", 1): [[*(rng.normal(size=5) * scales), 7.0] for _ in range(301)],
        ("a", None): [[float(v)] * 6 for v in rng.integers(-2, 3, 50)],
        (None, 2): [[0.0, -0.0, None, 1e308, -1e308, math.inf]] * 3 + [None],
        ("one", 1): [[1.5, 2.5, -3.5, 0, 0, 0]],
    }
    probabilities = [0.25, 0.5, 0.75, 1.0, 0.0]
    got = vector_quantiles(table(spark, blocks), ["g", "h"], "vector", probabilities, list("vwxyz"), bins, state_entries, sent_values).collect()
    assert {(r.g, r.h) for r in got} == set(blocks)
    for r in got:
        rows = [x for x in blocks[r.g, r.h] if x is not None]
        for position, values in enumerate(zip(*rows, strict=True)):
            if all(v is None for v in values) and state_entries == 0:
                continue
            for p, name in zip(probabilities, "vwxyz", strict=True):
                if state_entries == 0 and (r.g is None):
                    continue
                assert r[name][position] == want(values, p)


def test_vectors_of_different_lengths(spark):
    got = vector_quantiles(table(spark, {("a", 1): [[1.0], [3.0, 10.0], [], [2.0, 20.0, 5.0]]}), ["g"], "vector", [0.5], ["m"]).first()
    assert got.m == [2.0, 15.0, 5.0] and got.counts == [3, 2, 1]


def test_no_rows(spark):
    assert vector_quantiles(table(spark, {}), ["g"], "vector", [0.5], ["m"]).collect() == []
