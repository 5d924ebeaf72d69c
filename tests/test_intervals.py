"""Ordered totals, interval joins and evaluation against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import intervals as I
from millrace.operators.bootstrap import draw_runs, event_rate_interval, interval, resampled_precision, window_metric_intervals
from millrace.operators.intervals import annotate, event_details, event_summary, family_summary, label_windows, owned_intervals, refuse_bad_intervals
from millrace.operators.joins import complete_lookup, same_rows
from millrace.operators.metrics import evaluate_windows
from millrace.operators.ranks import exact_quantiles, running_totals
from millrace.operators.selection import evenly_spread
from millrace.operators.study import candidate_means, eligible_candidates, mean_ranks, paired_differences, paired_values
from millrace.operators.tiling import complete_tiles, tile_scores

MINUTE = 60_000_000


@pytest.mark.parametrize("range_rows", [7, 10**6])
def test_quantiles_and_totals_split_or_whole(spark, range_rows):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "b", "c"], 1500, p=[0.9, 0.07, 0.03]), "v": np.round(rng.normal(size=1500), 2)})
    df = spark.createDataFrame(pdf)
    for method in ("linear", "higher"):
        got = exact_quantiles(df, ["k"], "v", [0.0, 0.3, 0.99], ["a", "b", "c"], method=method, range_rows=range_rows).toPandas().set_index("k")
        for k, g in pdf.groupby("k"):
            assert np.allclose(np.quantile(g.v, [0.0, 0.3, 0.99], method=method), got.loc[k, ["a", "b", "c"]].astype(float))
    totals = running_totals(df, [], "v", {"n": F.lit(1)}, range_rows, max_cuts=64).toPandas()
    counts = pdf.v.value_counts().sort_index().cumsum()
    assert dict(zip(totals.v, totals.n_upto)) == counts.to_dict()
    assert set(totals.n_total) == {len(pdf)}


def brute_annotation(rows, events):
    out = {(a, t): (False, None, None) for _, a, t in rows}
    for _, asset, name, start, end in sorted(events, key=lambda e: (e[3], e[2])):
        times = sorted(t for _, a, t in rows if a == asset)
        inside = [t for t in times if start <= t <= end]
        if times and not inside:
            inside = [min(times, key=lambda t: abs(t - (start + end) // 2))]
        for t in inside:
            if out[asset, t][1] is None:
                out[asset, t] = (True, name, start)
    return out


@pytest.mark.parametrize("seed, bucket", [(1, 17), (2, 5), (3, 1000)])
def test_annotation_against_loop(spark, seed, bucket, monkeypatch):
    rng = np.random.default_rng(seed)
    rows = sorted({("r", a, int(t)) for a in "xy" for t in rng.integers(0, 400, 40)})
    events = []
    for i in range(30):
        start = int(rng.integers(-60, 460))
        events.append(("r", str(rng.choice(["x", "y", "z"])), f"e{i:02d}", start, start + int(rng.choice([0, 3, 40]))))
    original = owned_intervals
    monkeypatch.setattr(I, "owned_intervals", lambda e: original(e, 30))
    df = spark.createDataFrame(rows, "run_id string, asset_id string, us bigint")
    ev = spark.createDataFrame(events, "run_id string, asset_id string, event_id string, start_us bigint, end_us bigint")
    got = {(r.asset_id, r.us): (r.is_anomaly, r.event_id, r.event_start_us) for r in annotate(df, ev, bucket).collect()}
    assert got == brute_annotation(rows, events)


def windows_of(spark, rows):
    return spark.createDataFrame(rows, "run_id string, asset_id string, window_start bigint, window_end bigint, score double")


def test_every_event_counts(spark):
    w = windows_of(spark, [("r1", "a", 0, MINUTE, 0.99), ("r1", "a", MINUTE, 2 * MINUTE, 0.1)])
    schema = "run_id string, asset_id string, event_id string, family string, start_us bigint, end_us bigint"
    events = spark.createDataFrame(
        [("r1", "a", "e1", "cavitation", 10, 20), ("r1", "a", "e2", "cavitation", 15, MINUTE), ("r2", "a", "e1", "drift", 0, 5)], schema
    )
    details = event_details(events, w, "score", 0.95, bucket_us=7_000_000)
    total = event_summary(details).first()
    assert (total.event_count, total.detected_events, total.events_without_windows) == (3, 2, 1)
    assert total.event_detection_rate == pytest.approx(2 / 3)
    families = {(r.scope, r.family): (r.events, r.detected) for r in family_summary(details).collect()}
    assert families == {("family", "cavitation"): (2, 2), ("family", "drift"): (1, 0), ("subtotal", "physical"): (2, 2)}
    assert {(r.window_start, r.overlaps_event) for r in label_windows(w, events).collect()} == {(0, True), (MINUTE, True)}
    refuse_bad_intervals(events)
    for bad in [("r1", "a", "e1", "x", 1, 2), ("r9", "a", "e", "x", 5, 4)]:
        with pytest.raises(ValueError):
            refuse_bad_intervals(events.unionByName(spark.createDataFrame([bad], schema)))


def scored(spark, rows):
    schema = "run_id string, is_anomaly boolean, score double, event_id string, event_start_us bigint, window_end bigint"
    return spark.createDataFrame(rows, schema)


def test_window_metrics(spark):
    rows = [("r", False, 0.1, None, None, MINUTE), ("r", True, 0.99, "e", 118_000_000, 2 * MINUTE), ("r", True, 0.98, "e", 118_000_000, 3 * MINUTE)]
    m = evaluate_windows(scored(spark, rows), [], "score", 0.95).first()
    assert (m.precision, m.recall, m.pr_auc, m.roc_auc, m.event_detection_rate) == (1, 1, 1, 1, 1)
    assert m.mean_detection_latency_seconds == 2
    none = evaluate_windows(scored(spark, [("r", False, 0.99, "", None, MINUTE), ("r", False, 0.2, None, None, MINUTE)]), [], "score", 0.95).first()
    assert (none.event_count, none.event_detection_rate, none.pr_auc, none.roc_auc) == (0, None, None, None)
    assert none.false_positives_per_asset_day == pytest.approx(1 / (2 / 1440))


def brute_ap(y, s):
    order = sorted(set(s), reverse=True)
    ap = last = 0.0
    for t in order:
        hit = [yy for yy, ss in zip(y, s) if ss >= t]
        recall = sum(hit) / sum(y)
        ap += (recall - last) * sum(hit) / len(hit)
        last = recall
    return ap


def test_ranking_with_ties(spark):
    rng = np.random.default_rng(2)
    y, s = rng.random(200) < 0.3, np.round(rng.random(200), 1)
    m = evaluate_windows(scored(spark, [("r", bool(a), float(b), None, None, 1) for a, b in zip(y, s)]), [], "score", 0.5).first()
    assert m.pr_auc == pytest.approx(brute_ap(y.tolist(), s.tolist()))
    pairs = [(p > n) + 0.5 * (p == n) for p in s[y] for n in s[~y]]
    assert m.roc_auc == pytest.approx(np.mean(pairs))


def test_bootstrap_is_paired_and_counts_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(f"r{i % 6}", bool(i % 4 == 0), float(rng.random()), f"e{i % 6}" if i % 4 == 0 else None, 0, MINUTE) for i in range(120)]
    w = scored(spark, rows).withColumn("other", F.least(F.col("score") + 0.2, F.lit(1.0)))
    draws = draw_runs(w, 40)
    sizes = {r.replicate: r.n for r in draws.groupBy("replicate").agg(F.sum("times").alias("n")).collect()}
    assert set(sizes.values()) == {6} and len(sizes) == 40
    same = {r.metric: r for r in window_metric_intervals(w, draws, {"score": 0.5, "other": 0.7}).collect()}
    assert all(abs(r.lower) <= r.replicates and r.replicates == 40 for r in same.values())
    equal = {r.metric: (r.lower, r.upper) for r in window_metric_intervals(w.withColumn("other", F.col("score")), draws, {"score": 0.5, "other": 0.5}).collect()}
    assert set(equal.values()) == {(0.0, 0.0)}
    details = spark.createDataFrame([("r0", "baseline", True), ("r0", "candidate", True), ("r1", "baseline", False), ("r1", "candidate", True)], "run_id string, arm string, detected boolean")
    ci = event_rate_interval(details, draws, w).first()
    assert 0 <= ci.lower <= ci.upper <= 1 and ci.replicates <= 40
    assert interval(spark.createDataFrame([(float(i),) for i in range(101)], "x double"), "x").first().upper == pytest.approx(97.5)


@pytest.mark.parametrize("range_cells", [9, 10**6])
def test_precision_of_replicates_over_ranges(spark, range_cells):
    rng = np.random.default_rng(8)
    n = 300
    pdf = pd.DataFrame({"run_id": rng.choice([f"r{i}" for i in range(7)], n, p=[0.4] + [0.1] * 6), "is_anomaly": (rng.random(n) < 0.2).astype(object), "x": np.round(rng.random(n), 1), "y": rng.random(n)})
    pdf.loc[pdf.run_id == "r1", "is_anomaly"] = None
    pdf.loc[::17, "y"] = None
    w = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "run_id string, is_anomaly boolean, x double, y double")
    draws = draw_runs(w, 30)
    times = {(r.replicate, r.run_id): r.times for r in draws.collect()}
    got = {(r.replicate, r.arm): r.pr_auc for r in resampled_precision(w, draws, ["x", "y"], range_cells=range_cells).collect()}
    assert len(got) == 60
    for (replicate, arm), value in got.items():
        known = pdf[pdf[arm].notna()]
        weight = np.array([times.get((replicate, r), 0) for r in known.run_id])
        positive = np.array([v is True or v == True for v in known.is_anomaly]) * weight  # noqa: E712
        want = 0.0
        for score in sorted(set(known[arm]), reverse=True):
            level, upto = (known[arm] == score).to_numpy(), (known[arm] >= score).to_numpy()
            if weight[upto].sum():
                want += positive[level].sum() / positive.sum() * positive[upto].sum() / weight[upto].sum()
        assert value == pytest.approx(want)
    none = resampled_precision(w.withColumn("is_anomaly", F.lit(False)), draws, ["x"]).collect()
    assert len(none) == 30 and {r.pr_auc for r in none} == {None}
    assert resampled_precision(w.where("false"), draws, ["x"]).collect() == []


def test_minutes_must_be_tiled_exactly(spark):
    half = 30_000_000
    starts = [0, half, MINUTE, 2 * MINUTE, 2 * MINUTE + half, 2 * MINUTE + half]
    w = windows_of(spark, [("r", "a", s, s + half, 0.8 if s == half else 0.2) for s in starts])
    assert [r.window_start for r in complete_tiles(w, 30).collect()] == [0]
    assert {r.window_start: r.score for r in tile_scores(w).collect()}[0] == 0.8


def test_complete_lookup_refuses_gaps(spark):
    left = spark.createDataFrame([(1,), (2,)], "k int")
    right = spark.createDataFrame([(1, 5.0)], "k int, v double")
    with pytest.raises(Exception, match="required key"):
        complete_lookup(left, right, ["k"], "v").collect()
    assert same_rows(left, left) and not same_rows(left, left.union(left))


def test_even_spread(spark):
    for n in (1, 2, 5, 13, 40):
        names = [f"p{i:03d}" for i in range(n)]
        df = spark.createDataFrame([("w", x) for x in names], "w string, p string")
        for k in (1, 3, 12):
            want = names if n <= k else ([names[n // 2]] if k == 1 else [names[round(i * (n - 1) / (k - 1))] for i in range(k)])
            assert sorted(r.p for r in evenly_spread(df, ["w"], "p", k).collect()) == sorted(set(want))


def test_experiment_tables(spark):
    rows = [(c, d, v, "completed") for c, vs in {"baseline": (0.1, 0.2, 0.3), "b": (0.2, 0.3, 0.5)}.items() for d, v in zip("xyz", vs)]
    df = spark.createDataFrame(rows, "candidate_id string, dataset_id string, pr_auc double, status string")
    d = paired_differences(paired_values(df, "pr_auc")).first()
    assert d.n == 3 and d.mean_difference == pytest.approx(4 / 30) and d.ci95_low < d.mean_difference < d.ci95_high
    with pytest.raises(ValueError, match="differ"):
        paired_values(df.filter("NOT (candidate_id = 'b' AND dataset_id = 'x')"), "pr_auc")
    means = candidate_means(df).withColumn("event_detection_rate", F.lit(None).cast("double")).withColumn("false_positives_per_asset_day", F.lit(1.0))
    ranks = {r.candidate_id: r.mean_rank for r in mean_ranks(means).collect()}
    assert ranks == {"b": 1.0, "baseline": 2.0}
    gate = spark.createDataFrame([("baseline", 3, 5, 0.6, 4), ("ok", 4, 5, 0.5, 4), ("noisy", 9, 9, 0.9, 5)], "candidate_id string, physical_detected int, detected_events int, precision double, false_positive_windows int")
    assert [r.candidate_id for r in eligible_candidates(gate).collect()] == ["ok"]


OPEN_END = 253_402_300_799_000_000


def test_an_open_ended_event_costs_no_more_than_the_data(spark):
    schema = "run_id string, asset_id string, event_id string, start_us bigint, end_us bigint"
    events = spark.createDataFrame([("r1", "a", "open", 2 * MINUTE, OPEN_END), ("r1", "a", "past", -OPEN_END, -1)], schema)
    w = windows_of(spark, [("r1", "a", k * MINUTE, (k + 1) * MINUTE, 0.1) for k in range(5)])
    assert {r.window_start // MINUTE for r in label_windows(w, events).filter("overlaps_event").collect()} == {2, 3, 4}
    rows = spark.createDataFrame([("r1", "a", k * MINUTE) for k in range(5)], "run_id string, asset_id string, us bigint")
    got = {r.us // MINUTE: r.event_id for r in annotate(rows, events).collect()}
    # The past event met no observation, so it marks the nearest.
    assert got == {0: "past", 1: None, 2: "open", 3: "open", 4: "open"}
