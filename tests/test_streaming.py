"""Streams of observations to windows to scores, against the batch jobs."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark import SparkContext
from pyspark.sql import functions as F

from millrace.operators.features import long, window_features
from millrace.operators.windows import WindowPlan
from millrace.plans.detector import Options, fit_model, score
from millrace.session import scratch_path, settle, shared_dir
from millrace.streaming.scoring import score_stream
from millrace.streaming.windows import closed_windows, fresh_observations, run_available
from test_detector import fleet

T0 = dt.datetime(2026, 3, 1)
SCHEMA = (
    "run_id string, asset_id string, asset_class string, operating_regime string, timestamp timestamp, tag_id string, signal_class string,"
    " measurement_role string, value_kind string, value double, quality string, sampling_interval_ms double, is_anomaly boolean"
)


def observations(seed, seconds=600, assets=3):
    rng = random.Random(seed)
    rows = []
    for a in range(assets):
        for tag, kind in (("t1", "temp"), ("t2", "temp"), ("v1", "vib"), ("s1", "state")):
            moments = sorted(rng.sample(range(seconds * 10), 90))
            for m in moments:
                if kind == "vib" and 2000 < m < 4500:
                    continue
                value = rng.choice([rng.uniform(-5, 5), rng.uniform(90, 110), None, float("nan")] if rng.random() < 0.2 else [rng.uniform(0, 1)])
                rows.append((
                    "run", f"asset-{a}", f"class-{a % 2}", "steady" if a == 0 else rng.choice(["low", "high"]) if rng.random() < 0.05 else None,
                    T0 + dt.timedelta(milliseconds=100 * m), tag, kind, f"{kind}-{'in' if tag in ('t1', 'v1', 's1') else 'out'}",
                    "categorical" if kind == "state" else None, value, rng.choice(["good", "good", "bad", "uncertain", None, "odd"]),
                    rng.choice([1000.0, 500.0, None]), rng.random() < 0.03,
                ))
    return rows


def as_stream(spark, rows, files, jitter=0):
    """Rows in files by time, each a micro-batch, some rows out of order."""
    path = scratch_path(spark, "observations")
    rng = random.Random(0)
    ordered = sorted(rows, key=lambda r: (r[4] + dt.timedelta(seconds=rng.uniform(0, jitter))))
    for i, part in enumerate(np.array_split(np.arange(len(ordered)), files)):
        spark.createDataFrame([ordered[k] for k in part], SCHEMA).coalesce(1).write.parquet(f"{path}/part={i:03d}")
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def plain(rows):
    return {
        (r.run_id, r.asset_id, r.window_start, r.channel): tuple(round(v, 8) if isinstance(v, float) else v for v in r)
        for r in rows
    }


CHANNELS = ["temp-in", "temp-out", "vib-in", "unheard"]
DEFAULTS = {"unheard": 2000.0, "vib-in": 100.0}


@pytest.mark.parametrize(("size", "stride", "files"), [("1m", "1m", 6), ("90s", "30s", 5), ("20s", "50s", 4)])
def test_closed_windows_equal_the_complete_policy(spark, size, stride, files):
    plan = WindowPlan.of(size, stride, "complete")
    rows = observations(files)
    stream = fresh_observations(as_stream(spark, rows, files, jitter=8), "10 seconds")
    path = scratch_path(spark, "closed")
    run_available(closed_windows(stream, plan, CHANNELS, DEFAULTS), f"{path}/out", f"{path}/state")
    table = spark.createDataFrame(rows, SCHEMA)
    batch = window_features(table, plan, CHANNELS, DEFAULTS)
    bound = table.agg(F.max(F.unix_micros("timestamp"))).first()[0] - 10_000_000
    want = batch.filter(F.col("window_end") <= bound - bound % 1000)
    got = spark.read.parquet(f"{path}/out")
    assert got.columns == want.columns
    # A batch knows contexts that are constant over the whole asset beforehand; here that is the class alone.
    names = [c for c in long(want).columns if c != "operating_regime"]
    found, expected = plain(long(got).select(names).collect()), plain(long(want).select(names).collect())
    assert len(expected) > 40 and found.keys() == expected.keys()
    for key in expected:
        assert all(
            a == b or (isinstance(a, float) and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7)) for a, b in zip(found[key], expected[key], strict=True)
        ), (found[key], expected[key])
    regimes = {r.operating_regime for r in got.filter("asset_id = 'asset-0'").collect()}
    assert regimes == {"steady"}
    assert {r.operating_regime for r in got.filter("asset_id <> 'asset-0'").collect()} <= {"low", "high", "mixed", "unknown"}


def test_an_untrained_channel_stops_the_stream(spark):
    stream = fresh_observations(as_stream(spark, observations(1, 60, 1), 1), "10 seconds")
    path = scratch_path(spark, "refused")
    with pytest.raises(Exception, match="Untrained"):
        run_available(closed_windows(stream, WindowPlan.of("10s", "10s"), ["temp-in"]), f"{path}/out", f"{path}/state")


def stream_of_fleet(spark, files):
    rows = fleet(spark, "test")
    path = scratch_path(spark, "fleet")
    low, high = rows.agg(F.min("timestamp"), F.max("timestamp")).first()
    share = (F.unix_micros("timestamp") - F.unix_micros(F.lit(low))) / F.lit((high - low).total_seconds() * 1e6 + 1)
    rows.withColumn("part", F.floor(share * files)).repartition(1).write.partitionBy("part").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/*")


def test_stream_to_windows_to_scores_equals_batch(spark, monkeypatch):
    options = Options(size="1m", stride="1m", latent=2, trees=10, min_partition_windows=5, calibration_quantile=0.9)
    model = fit_model(fleet(spark, "train"), fleet(spark, "validation"), options)
    sent = []
    plain_broadcast = SparkContext.broadcast
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: sent.append(1) or plain_broadcast(self, value))
    counts = {}
    for files in (1, 3):
        plan = WindowPlan.of("1m", "1m", "complete")
        closed = closed_windows(fresh_observations(stream_of_fleet(spark, files), "1 second"), plan, model.channels, model.intervals)
        path = scratch_path(spark, f"chain-{files}")
        run_available(closed, f"{path}/windows", f"{path}/windows-state")
        windows = spark.readStream.schema(closed.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/windows")
        before = len(sent)
        score_stream(windows, model, f"{path}/scores", f"{path}/scores-state")
        counts[files] = len(sent) - before
        scored = settle(score(fleet(spark, "test"), model, "complete"), "batch-scores")
        keys = ["run_id", "asset_id", "window_start", F.round("irregularity", 9).alias("irregularity")]
        got, want = ({tuple(r) for r in t.select(*keys).collect()} for t in (spark.read.parquet(f"{path}/scores"), scored))
        # The watermark stands still at the end of the stream, so windows up to the last second are open.
        assert got <= want and len(got) >= 0.9 * len(want)
        batches = {r.batch for r in spark.read.parquet(f"{path}/scores").select("batch").distinct().collect()}
        assert len(batches) >= (3 if files == 3 else 1)
    assert counts[1] == counts[3] == 4


def test_scoring_leaves_no_intermediate_tables(spark):
    import os

    options = Options(size="1m", stride="1m", latent=2, trees=5, min_partition_windows=5, calibration_quantile=0.9)
    model = fit_model(fleet(spark, "train"), fleet(spark, "validation"), options)
    from millrace.plans.detector import build_windows

    windows = build_windows(fleet(spark, "test"), model.options, model.channels, model.intervals, model.vocabulary)
    path = scratch_path(spark, "no-files")
    windows.repartition(3).write.parquet(f"{path}/windows")
    stream = spark.readStream.schema(windows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/windows")
    root = os.path.join(shared_dir(spark), "millrace")
    before = set(os.listdir(root))
    score_stream(stream, model, f"{path}/scores", f"{path}/state")
    made = {n for n in set(os.listdir(root)) - before if not n.startswith(("no-files", "reference-curve", "points"))}
    assert made == set()
