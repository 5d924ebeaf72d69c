"""Steps of the detectors whose work per window would otherwise make them too slow on large tables."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from millrace.operators import vector_quantiles as quantiles_module
from millrace.operators.forest import grow_tree, isolation, pack_forest
from millrace.operators.vector_quantiles import vector_quantiles
from millrace.plans import detector
from millrace.plans.detector import Options, fit_model, score
from test_detector import fleet


def test_trees_walked_together_give_the_paths_of_single_walks():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(700, 5)), 1)
    x[0, :], x[1, 2], x[2, 2] = np.nan, np.inf, -np.inf
    trees = [grow_tree(x[3:][rng.permutation(697)[: 3 + 7 * t]], np.random.default_rng(t)) for t in range(19)]
    packed = pack_forest(pd.DataFrame([{"tree": t, "sample": 64, **{k: list(v) for k, v in tree.items()}} for t, tree in enumerate(trees)]))
    assert max(len(pack[1]) for pack in packed[0]) > 1
    got = isolation(packed, x)
    for i, row in enumerate(x):
        total = 0.0
        for tree in trees:
            at = 0
            while tree["feature"][at] >= 0:
                at = tree["left"][at] if row[tree["feature"][at]] <= tree["threshold"][at] else tree["right"][at]
            total += tree["path"][at]
        assert got[i] == np.power(2.0, -(total / 19) / packed[2])


def test_equal_values_close_their_bracket_at_once(spark, monkeypatch):
    """Entries of few distinct values take two passes, not one for every six bits of a double."""
    passes, narrow = [], quantiles_module._narrow
    monkeypatch.setattr(quantiles_module, "_narrow", lambda *a: (passes.append(1), narrow(*a)))
    rows = [("a", [float(i % 2), float(i % 3) / 7]) for i in range(300)]
    got = vector_quantiles(spark.createDataFrame(rows, "g string, vector array<double>"), ["g"], "vector", [0.25, 0.75], ["l", "h"], sent_values=0).first()
    assert (got.l, got.h) == ([0.0, 0.0], [1.0, 2 / 7]) and len(passes) <= 2


def test_pooled_fit_scores_every_validation_window_once(spark, monkeypatch):
    tables, settle = {}, detector.settle

    def noted(df, label="stage"):
        tables.setdefault(label, []).append(df.columns)
        return settle(df, label)

    monkeypatch.setattr(detector, "settle", noted)
    calls, raw_scores = [], detector.raw_scores
    monkeypatch.setattr(detector, "raw_scores", lambda *a: (calls.append(1), raw_scores(*a))[1])
    model = fit_model(fleet(spark, "train"), fleet(spark, "validation"), Options(family="pooled", size="1m", stride="1m", latent=2, trees=5))
    assert len(calls) == 1
    assert not any("names" in columns for of_label in tables.values() for columns in of_label)
    assert not {"vector", "errors", "raw_vector"} & {c for label in ("raw", "scored") for columns in tables[label] for c in columns}
    scored = score(fleet(spark, "test"), model)
    row = scored.select("names", "channels", "raw_vector").first()
    assert row.channels == ["temperature"] and len(row.names) == len(row.raw_vector) and row.names[0] == "temperature_mean"
    assert scored.filter(F.size("names") != F.size("raw_vector")).isEmpty()
