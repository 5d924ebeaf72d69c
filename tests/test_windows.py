"""Window features against hand-worked expectations and a direct loop."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators.context import encode_contexts, vocabulary_lists, context_vocabulary
from millrace.operators.features import long, wide, window_features
from millrace.operators.windows import WindowPlan

T0 = dt.datetime(2026, 1, 1)
US0 = 1767225600000000


def frame(spark, rows, extra=""):
    base = "run_id string, asset_id string, timestamp timestamp, tag_id string, signal_class string, value double"
    return spark.createDataFrame(rows, base + (", " + extra if extra else ""))


def row(second, value, signal="temp", *extra, run="r", asset="a", tag=None):
    return (run, asset, T0 + dt.timedelta(seconds=second), tag or signal, signal, float(value), *extra)


def by_start(features, channels):
    return {(r["window_start"] - US0) // 1_000_000: r for r in wide(features, channels).collect()}


def test_sixty_seconds_at_one_hertz(spark):
    df = frame(spark, [row(s, s, "temp", 1000.0) for s in range(60)], "sampling_interval_ms double")
    halves = by_start(window_features(df, WindowPlan.of("30s", "30s")), ["temp"])
    assert set(halves) == {0, 30}
    for r in halves.values():
        assert r["temp_sample_count"] == 30 and r["temp_expected_sample_count"] == 30
        assert r["temp_slope"] == pytest.approx(1.0)
        assert r["temp_coverage_ratio"] == 1.0
    assert set(by_start(window_features(df, WindowPlan.of("60s", "60s")), ["temp"])) == {0}
    assert window_features(df, WindowPlan.of("60s", "60s", "complete")).count() == 0
    closed = df.unionByName(frame(spark, [row(60, 1, "temp", 1000.0)], "sampling_interval_ms double"))
    assert set(by_start(window_features(closed, WindowPlan.of("60s", "60s", "complete")), ["temp"])) == {0}


def test_uncertain_values_are_kept_and_counted(spark):
    df = frame(spark, [row(0, 10, "temp", "good"), row(30, 30, "temp", None)], "quality string")
    r = by_start(window_features(df, WindowPlan.of("1m", "1m")), ["temp"])[0]
    assert (r["temp_mean"], r["temp_last"], r["temp_slope"]) == (20, 30, pytest.approx(2 / 3))
    assert (r["temp_good_ratio"], r["temp_uncertain_ratio"]) == (0.5, 0.5)


def test_bad_values_count_but_do_not_enter_statistics(spark):
    df = frame(spark, [row(0, 10, "temp", "bad"), row(30, 30, "temp", "bad")], "quality string")
    r = by_start(window_features(df, WindowPlan.of("1m", "1m")), ["temp"])[0]
    assert r["temp_mean"] == r["temp_slope"] == r["temp_mad"] == 0
    assert (r["temp_sample_count"], r["temp_bad_ratio"], r["temp_missing"]) == (2, 1, 0)


def test_roles_separate_points_of_one_class(spark):
    rows = []
    for s, (a, b) in enumerate([(10, 40), (11, 41), (12, 42)]):
        rows += [row(s, a, "temp", "inlet", "continuous", tag="i"), row(s, b, "temp", "outlet", None, tag="o"), row(s, 1, "temp", "state", "categorical", tag="s")]
    df = frame(spark, rows, "measurement_role string, value_kind string")
    features = window_features(df, WindowPlan.of("1m", "1m"))
    r = by_start(features, ["inlet", "outlet"])[0]
    assert (r["inlet_mean"], r["outlet_mean"]) == (11, 41)
    assert set(features.first()["stats"]) == {"inlet", "outlet"}


def test_silent_channel(spark):
    rows = [row(s * 60, 1, "temp") for s in range(4)] + [row(0, 5, "vib")]
    r = by_start(window_features(frame(spark, rows), WindowPlan.of("1m", "1m"), ["temp", "vib"], {"vib": 1000.0}), ["temp", "vib"])[120]
    assert (r["vib_missing"], r["vib_bad_ratio"], r["vib_coverage_ratio"], r["vib_expected_sample_count"]) == (1, 1, 0, 60)


def test_untrained_channel_is_refused(spark):
    with pytest.raises(ValueError, match="Untrained"):
        window_features(frame(spark, [row(0, 1, "temp"), row(1, 1, "new")]), WindowPlan.of("1m", "1m"), ["temp"])
    only_states = frame(spark, [row(0, 1, "temp", "categorical")], "value_kind string")
    with pytest.raises(ValueError, match="No continuous"):
        window_features(only_states, WindowPlan.of("1m", "1m"))


def test_labels_and_onset(spark):
    rows = [row(m * 60, v, "temp", m >= 2, "e1" if m >= 2 else None, US0 if m >= 2 else None) for m, v in enumerate([1, 2, 9, 10])]
    df = frame(spark, rows, "is_anomaly boolean, event_id string, event_start_us bigint")
    got = by_start(window_features(df, WindowPlan.of("2m", "1m")), ["temp"])
    assert [got[s]["is_anomaly"] for s in (0, 60, 120)] == [False, True, True]
    assert [got[s]["event_id"] for s in (0, 60, 120)] == [None, "e1", "e1"]
    assert got[60]["event_start_us"] == US0


def test_late_event_windows(spark):
    rows = [row(m * 60, m, "temp", "event-1" if m >= 100 else None) for m in range(106)]
    got = window_features(frame(spark, rows, "event_id string"), WindowPlan.of("1m", "1m"))
    assert got.filter("event_id = 'event-1'").count() == 6


def test_contexts(spark):
    rows = [row(0, 1, "t", "steady"), row(30, 1, "t", None), row(60, 1, "t", "ramp"), row(70, 1, "t", "steady"), row(120, 1, "t", None), row(180, 1, "t", "ramp")]
    features = window_features(frame(spark, rows, "operating_regime string"), WindowPlan.of("1m", "1m"))
    got = {(r.window_start - US0) // 1_000_000: r.operating_regime for r in features.collect()}
    assert got == {0: "steady", 60: "mixed", 120: "unknown", 180: "ramp"}
    lists = vocabulary_lists(context_vocabulary(features))
    assert lists["operating_regime"] == ["mixed", "ramp", "steady", "unknown"]
    encoded = encode_contexts(features, {"operating_regime": ["steady"]})
    assert encoded.filter("context_regime_unknown").count() == 3


def loop_features(samples, size, stride, tail, channels):
    """Direct evaluation, one window at a time."""
    times = [t for t, *_ in samples]
    low, high = min(times), max(times)
    out = {}
    for start in range(low // stride * stride, high - size + (stride if tail == "legacy" else 0) + 1, stride):
        inside = [s for s in samples if start <= s[0] < start + size]
        if not inside:
            continue
        for c in channels:
            values = sorted((t, v) for t, ch, v in inside if ch == c)
            v = np.array([x for _, x in values]) if values else np.array([0.0])
            t = np.array([x for x, _ in values], dtype=float) / 1e6
            slope = np.polyfit(t - t[0], v, 1)[0] if len(values) > 1 and np.ptp(t) > 0 else 0.0
            out[start, c] = (v.mean(), np.median(v), v.min(), v.max(), v.std(), np.median(abs(v - np.median(v))), v[-1], v[-1] - v[0], slope, float(len(values)))
    return out


@pytest.mark.parametrize("size, stride", [(100, 100), (300, 100), (100, 250), (70, 30)])
@pytest.mark.parametrize("tail", ["legacy", "complete"])
def test_against_direct_loop(spark, size, stride, tail):
    rng = np.random.default_rng(size + stride)
    second = 1_000_000
    seconds = np.sort(rng.choice(3000, 160, replace=False))
    seconds = seconds[(seconds < 1200) | (seconds > 1700)] - 800
    samples = [(int(s) * second, rng.choice(["x", "y"], p=[0.8, 0.2]), float(np.round(rng.normal(100, 20), 2))) for s in seconds]
    rows = [("r", "a", t, "k" + c, c, v) for t, c, v in samples]
    df = spark.createDataFrame(rows, "run_id string, asset_id string, us bigint, tag_id string, signal_class string, value double")
    df = df.withColumn("timestamp", F.timestamp_micros("us")).drop("us")
    plan = WindowPlan(size * second, stride * second, tail)
    names = ["mean", "median", "min", "max", "std", "mad", "last", "delta", "slope", "sample_count"]
    # A low block limit sends dense blocks through the range-split way.
    got = {(r.window_start, r.channel): tuple(r[n] for n in names) for r in long(window_features(df, plan, ["x", "y"], block_values=15)).collect()}
    expected = loop_features(samples, plan.size_us, plan.stride_us, tail, ["x", "y"])
    assert set(got) == set(expected)
    for key, want in expected.items():
        assert all(math.isclose(g, w, rel_tol=1e-7, abs_tol=1e-7) for g, w in zip(got[key], want)), (key, got[key], want)


def test_equal_times_follow_the_tag(spark):
    rows = [row(0, 1, "t", tag="a"), row(10, 7, "t", tag="b"), row(10, 5, "t", tag="a")]
    r = by_start(window_features(frame(spark, rows), WindowPlan.of("1m", "1m")), ["t"])[0]
    assert (r["t_last"], r["t_delta"]) == (7, 6)


def test_rows_without_a_role_share_a_channel(spark):
    rows = [row(0, 1, "temp", "inlet"), row(1, 2, "temp", None), row(2, 4, "temp", None)]
    features = window_features(frame(spark, rows, "measurement_role string"), WindowPlan.of("1m", "1m"))
    r = by_start(features, ["inlet", "None"])[0]
    assert (r["inlet_mean"], r["None_mean"], r["None_sample_count"]) == (1.0, 3.0, 2)


@pytest.mark.parametrize("bins", [2, 5, 512])
@pytest.mark.parametrize(("size", "stride"), [("60s", "10s"), ("30s", "30s"), ("20s", "50s")])
def test_selection_in_large_blocks_equals_sorting(spark, bins, size, stride):
    from millrace.operators.features import readings, selected_order_statistics
    from millrace.operators.windows import blocks_to_windows, panes_to_blocks, with_pane

    rng = np.random.default_rng(bins)
    plan = WindowPlan.of(size, stride)
    # Normal values, many equal ones, a far one, and two clusters with nothing between.
    shapes = {"n": lambda: rng.normal(), "e": lambda: float(rng.integers(0, 2)), "f": lambda: 1e12 if rng.random() < 0.01 else rng.random(), "c": lambda: float(rng.choice([-1e6, 1e6])) + rng.random()}
    rows = [row(s, draw(), name) for name, draw in shapes.items() for s in rng.integers(0, 200, 400).tolist()]
    values = readings(frame(spark, rows)).select("run_id", "asset_id", "us", "channel", "u")
    blocked = panes_to_blocks(with_pane(values, plan), plan)
    got = {(r.window_start, r.channel): (r.median, r.mad) for r in selected_order_statistics(blocked, plan, bins).collect()}
    want = {}
    for r in blocks_to_windows(blocked, plan).collect():
        want.setdefault((r.window_start, r.channel), []).append(r.u)
    assert got.keys() == want.keys()
    for key, held in want.items():
        median = np.median(held)
        assert got[key] == (median, np.median(np.abs(np.array(held) - median)))
