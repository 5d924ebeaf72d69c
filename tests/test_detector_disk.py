"""What the two-detector jobs leave on disk: no tables of vectors or errors, nothing that no later step reads."""

import os
import time
from functools import partial

import pytest
from pyspark.sql import functions as F

from millrace import session
from millrace.plans import detector
from millrace.plans.detector import Options, fit_model, predict, score
from test_detector import fleet


def tables(spark):
    folder = os.path.join(session.shared_dir(spark).removeprefix("file://"), "millrace")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


@pytest.fixture(scope="module")
def fitted(spark):
    """A model, and what its fit left in the shared folder."""
    before = tables(spark)
    model = fit_model(fleet(spark, "train"), fleet(spark, "validation"), Options(family="pooled", size="1m", stride="1m", latent=2, trees=5))
    return model, {name.rsplit("-", 1)[0] for name in tables(spark) - before}


def test_a_fit_leaves_no_table_of_windows_behind(spark, fitted):
    model, left = fitted
    assert {"scaler", "subspace", "forest", "references", "scored"} <= left
    assert not left & {"cells", "train-windows", "validation-windows", "train-vectors", "validation-vectors", "fit-scaled", "vectors", "residuals", "sampling"}
    assert model.metrics.count() == 3 and model.tables["raw_p99"].count() == 2 and model.tables["summary"].count() == 1


def test_scoring_writes_no_vectors_and_large_curves_move_raw_scores_only(spark, fitted, monkeypatch):
    model, _ = fitted
    written = []

    def noted(settle):
        return lambda df, label="stage": (written.append((label, df.columns)), settle(df, label))[1]

    monkeypatch.setattr(detector, "settle", noted(detector.settle))
    from millrace.operators import calibration

    monkeypatch.setattr(calibration, "settle", noted(calibration.settle))

    def found(test):
        by = ["run_id", "asset_id", "window_start"]
        scored = score(test, model).select(*by, "raw_vector", "errors", "names", "autoencoder_raw", "isolation_raw", "irregularity").orderBy(*by).collect()
        records = predict(test, model).select(*by, "observations", "feature_contributions").orderBy(*by).collect()
        return scored, records

    # Copies of windows have equal scores; those that moved to a range come back to their own row.
    test = fleet(spark, "test")
    test = test.unionByName(test.withColumn("run_id", F.concat("run_id", F.lit("-copy"))))
    small = found(test)
    assert len(small[0]) > 500 and any(r.observations for r in small[1])
    monkeypatch.setattr(detector, "fit_curve", partial(calibration.fit_curve, curve_points=10, range_points=7))
    monkeypatch.setattr(detector, "calibrate", partial(calibration.calibrate, range_rows=50))
    assert found(test) == small
    assert "ranged-scores" in {label for label, _ in written}
    assert not [label for label, columns in written if {"vector", "raw_vector", "errors"} & set(columns)]
    assert all("stats" not in columns for label, columns in written if label in ("raw", "ranged-scores"))


def test_shuffles_behind_a_settled_table_go_with_its_write(spark):
    blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        kept = blocks.getAllBlocks().mkString(" ").split()
        return {name for name in kept if name.startswith("shuffle_")}

    before, setting = shuffles(), spark.conf.get(session.SHUFFLES_DROPPED, None)
    assert session.settle(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count(), "counted").count() == 100
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.2)
    # The count of the settled table may have left its own; none of the write's hundred groups are there.
    assert len(shuffles() - before) <= 2
    assert spark.conf.get(session.SHUFFLES_DROPPED, None) == setting


def test_outliving_tables_go_with_the_scope_around(spark):
    before = tables(spark)
    with session.scratch_scope(spark):
        with session.scratch_scope(spark) as inner:
            session.settle(spark.range(3), "inside")
            with session.outliving(inner):
                kept = session.settle(spark.range(5), "kept")
        assert {name.rsplit("-", 1)[0] for name in tables(spark) - before} == {"kept"} and kept.count() == 5
    assert tables(spark) == before
