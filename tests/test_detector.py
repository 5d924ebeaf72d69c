"""Scaling, detectors, calibration, explanation, the whole job, and streams."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.calibration import calibrate, fit_curve, normal_only
from millrace.operators.explain import prediction_records
from millrace.operators import forest as forest_module
from millrace.operators.forest import average_path, draw_samples, fit_forest, grow_tree, isolation_scores, sampling_plan
from millrace.operators.reconstruction import apply_tail, fit_subspace, reconstruction_errors, residual_scales
from millrace.operators.vectors import apply_scaler, center_by_regime, fit_regimes, fit_scaler, non_finite_vectors
from millrace.plans.detector import Options, evaluate_against_events, fit_model, load_model, predict, save_model, score, with_supplement
from millrace.session import scratch_path, settle
from millrace.streaming.scoring import score_stream


def vectors(spark, arrays):
    rows = [(g, i, [float(x) for x in v]) for g, block in arrays.items() for i, v in enumerate(block)]
    return spark.createDataFrame(rows, "asset_class string, i int, vector array<double>")


def test_scalers(spark):
    x = np.array([[1.0, 5], [2, 5], [9, 5], [10, 5]])
    robust = fit_scaler(vectors(spark, {"a": x})).first()
    assert robust.center == [5.5, 5.0] and robust.spread == [7.5, 1.0]
    standard = fit_scaler(vectors(spark, {"a": x}), kind="standard").first()
    assert standard.spread[0] == pytest.approx(x[:, 0].std()) and standard.spread[1] == 1.0
    scaled = apply_scaler(vectors(spark, {"a": x}), fit_scaler(vectors(spark, {"a": x})))
    assert [r.vector[1] for r in scaled.collect()] == [0.0] * 4
    with pytest.raises(ValueError):
        fit_scaler(vectors(spark, {"a": x}), kind="minmax")
    assert non_finite_vectors(vectors(spark, {"a": [[1, math.inf], [1, 2]]})).count() == 1


def test_tail_scores(spark):
    df = spark.createDataFrame([("a", 0, [4.0, 100.0, 0.0, 0.0]), ("a", 1, [0.0, 600.0, 30.0, 0.0])], "asset_class string, i int, errors array<double>")
    scale = spark.createDataFrame([("a", [1.0, 100.0, 1.0, 1.0])], "asset_class string, scale array<double>")
    got = {r.i: r.tail for r in apply_tail(df, scale, top_k=2).collect()}
    assert (got[0].score, got[0].contributions) == (2.5, [2.0, 0.5, 0.0, 0.0])
    assert got[1].score == 18.0
    ties = spark.createDataFrame([("a", 0, [1.0, 100.0, 1.0, 1.0])], "asset_class string, i int, errors array<double>")
    assert apply_tail(ties, scale, top_k=2).first().tail.contributions == [0.0, 0.0, 0.5, 0.5]
    many = spark.createDataFrame([("a", [float(i), 0.0]) for i in range(101)], "asset_class string, errors array<double>")
    assert residual_scales(many).first().scale == [95.0, 1e-8]


def test_subspace_matches_direct_decomposition(spark):
    rng = np.random.default_rng(0)
    arrays = {"a": rng.normal(size=(80, 6)) @ np.diag([9, 5, 3, 1, 1, 0.1]), "b": rng.normal(size=(50, 4))}
    df = vectors(spark, arrays).repartition(4)
    state = settle(fit_subspace(df, 3), "subspace")
    want = {}
    for g, x in arrays.items():
        c = x - x.mean(axis=0)
        v = np.linalg.svd(c)[2][:3]
        want[g] = (c - c @ v.T @ v) ** 2
    for options in ({}, {"broadcast_entries": 0, "salt_rows": 7}):
        got = reconstruction_errors(df, state, **options).collect()
        assert len(got) == 130
        for r in got:
            assert np.allclose(r.errors, want[r.asset_class][r.i], atol=1e-8)


def test_forest(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(299, 3)), [[9.0, 9.0, 9.0]]])
    df = vectors(spark, {"a": x, "b": rng.normal(size=(40, 2))})
    drawn = draw_samples(df, ["i"], trees=12, sample=64)
    sizes = {(r.asset_class, r.tree): (r.n, r.d) for r in drawn.groupBy("asset_class", "tree").agg(F.count("*").alias("n"), F.count_distinct("i").alias("d")).collect()}
    assert sizes == {**{("a", t): (64, 64) for t in range(12)}, **{("b", t): (40, 40) for t in range(12)}}
    again = draw_samples(df.repartition(7), ["i"], trees=12, sample=64)
    key = ["asset_class", "tree", "i"]
    assert drawn.select(key).exceptAll(again.select(key)).isEmpty()
    trees = settle(fit_forest(df, ["i"], trees=60, sample=64), "forest")
    broadcast = {(r.asset_class, r.i): r.isolation for r in isolation_scores(df, trees).collect()}
    cogrouped = {(r.asset_class, r.i): r.isolation for r in isolation_scores(df, trees, broadcast_entries=0, salt_rows=50).collect()}
    assert broadcast == cogrouped
    of_a = {i: s for (g, i), s in broadcast.items() if g == "a"}
    assert max(of_a, key=of_a.get) == 299 and all(0 < s < 1 for s in of_a.values())
    assert float(average_path(2)) == 1 and float(average_path(1)) == 0
    tree = grow_tree(x[:64], np.random.default_rng(0))
    assert max(tree["feature"]) <= 2 and len(tree["feature"]) == 2 * sum(f < 0 for f in tree["feature"]) - 1


@pytest.mark.parametrize("sample", [0.5, 90])
def test_forest_of_samples_beyond_one_task(spark, monkeypatch, sample):
    """Every leaf of every tree holds the sampled rows that its stored path says."""
    monkeypatch.setattr(forest_module, "RANGE_ROWS", 16)
    monkeypatch.setattr(forest_module, "HELD_ENTRIES", 20)
    rng = np.random.default_rng(5)
    same = np.tile([[1.0, 2.0, 3.0]], (60, 1))
    arrays = {"a": np.vstack([rng.normal(size=(190, 3)), same]), "b": rng.normal(size=(24, 3)), "c": same}
    df = vectors(spark, arrays)
    drawn = draw_samples(df, ["i"], trees=6, sample=sample).collect()
    forest = {(r.asset_class, r.tree): r for r in fit_forest(df, ["i"], trees=6, sample=sample, max_features=0.7, task_rows=20).collect()}
    again = {(r.asset_class, r.tree): r for r in fit_forest(df.repartition(5), ["i"], trees=6, sample=sample, max_features=0.7, task_rows=20).collect()}
    assert forest == again and set(forest) == {(g, t) for g in arrays for t in range(6)}
    for (group, number), tree in forest.items():
        members = [r for r in drawn if (r.asset_class, r.tree) == (group, number)]
        n = len(arrays[group])
        assert len({r.i for r in members}) == len(members) == tree.sample == (n // 2 if sample == 0.5 else min(n, 90))
        reached, depths = {}, {0: 0}
        for at, feature in enumerate(tree.feature):
            if feature >= 0:
                depths[tree.left[at]] = depths[tree.right[at]] = depths[at] + 1
        for r in members:
            at = 0
            while tree.feature[at] >= 0:
                at = tree.left[at] if r.vector[tree.feature[at]] <= tree.threshold[at] else tree.right[at]
            reached.setdefault(at, []).append(tuple(r.vector))
        assert set(reached) == {at for at, f in enumerate(tree.feature) if f < 0}
        assert len(tree.feature) == 2 * len(reached) - 1 and len(set(tree.feature) - {-1}) <= 2
        limit = int(np.ceil(np.log2(len(members))))
        usable = set(tree.feature) - {-1}
        for at, held in reached.items():
            assert tree.path[at] == pytest.approx(depths[at] + float(average_path(len(held))))
            assert len(held) == 1 or depths[at] == limit or all(len({h[f] for h in held}) == 1 for f in usable)


def test_samples_of_a_front_that_is_too_short(spark):
    """The whole hash order is ranked when the counted front lacks rows."""
    df = vectors(spark, {"a": np.arange(200.0).reshape(100, 2)})
    plan = sampling_plan(df, trees=3, sample=20)
    got = draw_samples(df, ["i"], trees=3, sample=20, plan=settle(plan.withColumn("_front", plan["_front"] * 0.05), "short"))
    assert sorted(r["count"] for r in got.groupBy("tree").count().collect()) == [20, 20, 20]
    whole = draw_samples(df, ["i"], trees=3, sample=20)
    assert got.exceptAll(whole).isEmpty()


def test_calibration(spark):
    ref = spark.createDataFrame([("a", float(v)) for v in (1, 2, 3)], "g string, raw double")
    values = spark.createDataFrame([("a", float(v)) for v in (0, 2, 4)], "g string, raw double")
    got = {r.raw: r.s for r in calibrate(values, ref, ["g"], "raw", "s").collect()}
    assert got == {0.0: 0.0, 2.0: pytest.approx(2 / 3), 4.0: 1.0}
    with pytest.raises(Exception, match="No calibration reference"):
        calibrate(values, ref.filter("raw > 9"), ["g"], "raw", "s").collect()
    with pytest.raises(ValueError, match="normal window"):
        normal_only(spark.createDataFrame([(True,)], "is_anomaly boolean"))


@pytest.mark.parametrize(("curve_points", "range_points", "range_rows"), [(10**6, 10**5, 10**5), (0, 7, 5), (0, 1, 1000)])
def test_calibration_by_bisection_and_by_ranges(spark, curve_points, range_points, range_rows):
    rng = np.random.default_rng(3)
    keys = [("a", 1), ("a", None), (None, 1)]
    reference = [(*keys[i % 3], float(v)) for i, v in enumerate(rng.integers(0, 40, 200))] + [("a", 1, None)]
    rows = [(*keys[i % 3], float(v), i) for i, v in enumerate(rng.integers(-5, 50, 300))] + [("a", 1, None, 300)] + [("a", 1, 7.0, i) for i in range(301, 340)]
    ref = spark.createDataFrame(reference, "g string, h int, raw double")
    values = spark.createDataFrame(rows, "g string, h int, raw double, id int")
    curve = fit_curve(ref, ["g", "h"], "raw", curve_points, range_points)
    assert (curve.points is None) == (curve_points > 0)
    got = calibrate(values, curve, ["g", "h"], "raw", "s", range_rows)
    assert got.columns == ["g", "h", "raw", "id", "s"]
    found = {r.id: r.s for r in got.collect()}
    assert len(found) == len(rows) == got.count()
    for g, h, raw, i in rows:
        known = [v for a, b, v in reference if (a, b) == (g, h) and v is not None]
        assert found[i] == (None if raw is None else pytest.approx(sum(v <= raw for v in known) / len(known)))


def test_regime_centres(spark):
    rows = [("c", "low", [2.0])] * 20 + [("c", "high", [10.0])] * 20
    fit = spark.createDataFrame(rows, "asset_class string, operating_regime string, vector array<double>")
    later = spark.createDataFrame([("c", "low", [100.0]), ("c", "high", [11.0]), ("c", "new", [9.0])], fit.schema)
    got = {r.operating_regime: (r.vector[0], r.regime_fallback) for r in center_by_regime(later, *fit_regimes(fit)).collect()}
    assert got == {"low": (98.0, False), "high": (1.0, False), "new": (3.0, True)}


def test_observations(spark):
    stats = ["mean", "coverage_ratio", "bad_ratio", "missing"]
    def record(vector, errors, irregularity, applicable, unknown=False):
        df = spark.createDataFrame(
            [("r", "a", 0, 60_000_000, "k", "ramp", unknown, ["case_temp", "vibr"], [f"{c}_{s}" for c in ("case_temp", "vibr") for s in stats], vector, [float(e) for e in errors], irregularity)],
            "run_id string, asset_id string, window_start bigint, window_end bigint, asset_class string, operating_regime string, context_regime_unknown boolean,"
            "channels array<string>, names array<string>, raw_vector array<double>, errors array<double>, irregularity double",
        ).withColumn("autoencoder", F.col("irregularity")).withColumn("isolation_forest", F.col("irregularity"))
        table = spark.createDataFrame([("k", applicable)], "asset_class string, applicable array<string>")
        return prediction_records(df, stats, 0.95, table).first()
    ok = [1.0, 1.0, 0.0, 0.0]
    both = ["case_temp", "vibr"]
    r = record(ok + ok, [3.0, 0, 0, 0, 1.0, 0, 0, 0], 0.99, both)
    assert r.observations == ["thermal_deviation", "vibration_deviation"]
    assert sum(r.feature_contributions.values()) == pytest.approx(1) and r.window_start == "1970-01-01T00:00:00+00:00"
    assert record(ok + ok, [0.0] * 8, 0.99, both).observations == ["multivariate_novelty"]
    assert record(ok + ok, [3.0] + [0.0] * 7, 0.5, both).observations == []
    lost = [0.0, 0.0, 1.0, 1.0]
    assert record(ok + lost, [0.0] * 8, 0.5, both, True).observations == ["regime_mismatch", "signal_loss", "sampling_degradation"]
    assert record(ok + lost, [0.0] * 8, 0.5, ["case_temp"]).observations == []
    assert record(ok + lost, [0, 0, 0, 0, 0, 0, 2.0, 0], 0.99, ["case_temp"]).observations == ["quality_degradation"]


def fleet(spark, part):
    rows = []
    for run in range(30):
        for cls, level in (("pump", 10.0), ("compressor", 100.0)):
            for minute in range(5):
                odd = part != "train" and run % 3 == 0 and minute == 3
                at = dt.datetime(2026, 1, 1) + dt.timedelta(hours=run, minutes=minute)
                value = level + math.sin(run + minute) + (40 if odd else 0)
                rows.append((f"{part}-{run:02d}", f"{cls}-1", cls, at, "t", "temperature", value, "good", 60000.0, "steady", odd, f"{part}-{run}-{cls}" if odd else None))
    return spark.createDataFrame(
        rows,
        "run_id string, asset_id string, asset_class string, timestamp timestamp, tag_id string, signal_class string, value double, quality string,"
        " sampling_interval_ms double, operating_regime string, is_anomaly boolean, event_id string",
    )


def test_contextual_model_from_fit_to_stream(spark, tmp_path):
    train, validation, test = (fleet(spark, p) for p in ("train", "validation", "test"))
    options = Options(size="1m", stride="1m", latent=2, trees=25, min_partition_windows=5, calibration_quantile=0.9)
    with pytest.raises(ValueError, match="Leakage"):
        fit_model(train, train, options)
    model = fit_model(train, validation, options)
    metrics = {r.detector: r for r in model.metrics.collect()}
    assert metrics["irregularity"].recall == 1 and metrics["irregularity"].event_detection_rate == 1
    save_model(model, str(tmp_path / "model"))
    loaded = load_model(spark, str(tmp_path / "model"))
    scored = settle(score(test, loaded), "scored")
    assert scored.filter("autoencoder < 0 OR autoencoder > 1 OR isolation_forest < 0 OR isolation_forest > 1").isEmpty()
    both = with_supplement(scored, scored.select("run_id", "asset_id", "window_start", "autoencoder"))
    assert both.filter("fused < irregularity OR fused < autoencoder").isEmpty() and both.count() == scored.count()
    records = predict(test, loaded).collect()
    again = {(r.run_id, r.asset_id, r.window_start): r for r in predict(test, loaded).collect()}
    assert all(again[r.run_id, r.asset_id, r.window_start] == r for r in records)
    hot = [r for r in records if r.scores.irregularity >= loaded.threshold]
    assert hot and all(set(r.observations) & {"thermal_deviation", "multivariate_novelty"} for r in hot)
    events = scored.filter("is_anomaly").select("run_id", "asset_id", "event_id", F.col("window_start").alias("start_us"), (F.col("window_end") - 1).alias("end_us"))
    by_window, by_event = evaluate_against_events(scored.drop("event_id", "event_start_us"), events, loaded)
    assert {r.event_count for r in by_event.collect()} == {20} and by_window.count() == 3
    with pytest.raises(ValueError, match="Untrained asset classes"):
        score(test.withColumn("asset_class", F.lit("turbine")), loaded)
    # The same windows as a stream.
    from millrace.plans.detector import build_windows
    windows = build_windows(test, loaded.options, loaded.channels, loaded.intervals, loaded.vocabulary)
    source = scratch_path(spark, "windows")
    windows.write.parquet(source)
    out = scratch_path(spark, "scored-stream")
    score_stream(spark.readStream.schema(windows.schema).parquet(source), loaded, out, scratch_path(spark, "state"))
    streamed = spark.read.parquet(out)
    keys = ["run_id", "asset_id", "window_start", "irregularity"]
    assert streamed.select(*keys).exceptAll(scored.select(*keys)).isEmpty() and streamed.count() == scored.count()


def test_splits_must_be_large_enough(spark):
    options = Options(size="1m", stride="1m", latent=2, trees=5, min_partition_windows=500)
    with pytest.raises(ValueError, match="Insufficient windows"):
        fit_model(fleet(spark, "train"), fleet(spark, "validation"), options)
