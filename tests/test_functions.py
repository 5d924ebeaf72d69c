"""Durations, units, hashing, ISO text and Student-t quantiles."""

import hashlib

import pytest
from pyspark.sql import functions as F

from millrace.functions.arrays import largest_items, median_and_deviation
from millrace.functions.hashing import run_bucket
from millrace.functions.timeline import MINUTE_US, duration_us, floor_div, iso_utc
from millrace.functions.units import fold_text
from millrace.operators.calibration import calibrated_threshold, ensemble_weights
from millrace.operators.channels import channel_of, check_feature_schema, chosen_statistics, feature_names
from millrace.operators.convert import convert_units, unit_problems
from millrace.operators.study import t_quantile


@pytest.mark.parametrize("text, minutes", [("30s", 0.5), ("15s", 0.25), ("1m", 1), ("1.5min", 1.5), ("1h", 60)])
def test_durations(text, minutes):
    assert duration_us(text) == minutes * MINUTE_US


@pytest.mark.parametrize("text", ["0s", "-1m", "nans", "infs", "0.0000001s", "garbage", "5", "m"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        duration_us(text)


def test_older_durations_drop_fractions():
    assert duration_us("30s", marker=1) == MINUTE_US
    assert duration_us("2.9m", marker=1) == 2 * MINUTE_US


def test_units_are_converted(spark):
    rows = [("p", 1.0, "bar"), ("q", 100.0, " kPa "), ("t", 32.0, "°F"), ("f", 60.0, "L/min"), ("r", 50.0, "%"), ("x", 7.0, "anything")]
    df = spark.createDataFrame(rows, "signal_class string, value double, unit string")
    targets = {"p": "Pa", "q": "Pa", "t": "degC", "f": "m³/s", "r": "fraction"}
    got = {r.signal_class: (r.value, r.unit) for r in convert_units(df, targets).collect()}
    assert got["p"] == (pytest.approx(1e5), "Pa")
    assert got["q"][0] == pytest.approx(1e5)
    assert got["t"][0] == pytest.approx(0.0, abs=1e-9)
    assert got["f"][0] == pytest.approx(0.001)
    assert got["r"][0] == pytest.approx(0.5)
    assert got["x"] == (7.0, "anything")
    assert fold_text(" m³ / h ") == "m3/h"


def test_bad_units_are_named_and_refused(spark):
    df = spark.createDataFrame([("p", 1.0, "furlong"), ("p", 1.0, None), ("p", 1.0, "degC")], "signal_class string, value double, unit string")
    found = {r.problem for r in unit_problems(df, {"p": "Pa"}).collect()}
    assert found == {"unsupported source unit", "missing unit", "incompatible unit"}
    with pytest.raises(Exception, match="for signal p"):
        convert_units(df, {"p": "Pa"}).collect()
    with pytest.raises(Exception, match="unsupported target unit"):
        convert_units(df.limit(1), {"p": "furlong"}).collect()
    with pytest.raises(ValueError):
        convert_units(df.drop("unit"), {"p": "Pa"})


def test_feature_names():
    assert channel_of("flow_expected_sample_count") == "flow"
    assert channel_of("in_out_last_mean") == "in_out_last"
    assert channel_of("context_regime_unknown") is None
    assert feature_names(["run_id", "a_mean", "window_end", "event_id"]) == ["a_mean"]
    check_feature_schema(["run_id", "a_mean"], ["a_mean"])
    for columns in (["run_id"], ["a_mean", "b_mean"]):
        with pytest.raises(ValueError, match="mismatch"):
            check_feature_schema(columns, ["a_mean"])
    assert "slope" not in chosen_statistics({"slopes": False})
    assert chosen_statistics({"statistical": False, "slopes": False, "quality": False, "sampling": False}) == ()


def test_run_bucket_is_the_digest_prefix(spark):
    names = ["run-1", "run-2", "x"]
    got = spark.createDataFrame([(n,) for n in names], "r string").select("r", run_bucket("r", 5).alias("b")).collect()
    assert {r.r: r.b for r in got} == {n: int(hashlib.sha256(n.encode()).hexdigest()[:8], 16) % 5 for n in names}
    with pytest.raises(ValueError):
        run_bucket("r", 1)


def test_iso_and_floor(spark):
    df = spark.createDataFrame([(1767225600000000,), (1767225600123456,), (-1,)], "us bigint")
    got = [tuple(r) for r in df.select(iso_utc("us"), floor_div("us", 10)).collect()]
    assert got[0][0] == "2026-01-01T00:00:00+00:00"
    assert got[1][0] == "2026-01-01T00:00:00.123456+00:00"
    assert got[2][1] == -1


def test_array_helpers(spark):
    df = spark.createDataFrame([([3.0, 1.0, 10.0, 2.0],), ([5.0],), ([],)], "v array<double>")
    got = [r[0] for r in df.select(median_and_deviation(F.col("v"))).collect()]
    assert tuple(got[0]) == (2.5, 1.0)
    assert tuple(got[1]) == (5.0, 0.0)
    assert tuple(got[2]) == (None, None)
    ties = spark.createDataFrame([([1.0, 2.0, 2.0, 2.0],)], "v array<double>")
    assert [i.position for i in ties.select(largest_items(F.col("v"), 2)).first()[0]] == [2, 3]


def test_t_quantiles():
    # Published table values.
    for df, q in [(1, 12.7062), (2, 4.3027), (4, 2.7764), (9, 2.2622), (14, 2.1448), (30, 2.0423)]:
        assert t_quantile(df) == pytest.approx(q, abs=1e-4)


def test_weights_and_threshold(spark):
    assert ensemble_weights(3, 1) == (0.75, 0.25)
    for bad in [(-1, 2), (0, 0), (float("nan"), 1)]:
        with pytest.raises(ValueError):
            ensemble_weights(*bad)
    scores = spark.createDataFrame([(i / 100,) for i in range(1, 100)], "s double")
    cut = calibrated_threshold(scores, "s", 0.9)
    assert scores.filter(F.col("s") >= cut).count() == 9
    full = spark.createDataFrame([(1.0,)] * 5, "s double")
    with pytest.raises(ValueError, match="could ever alert"):
        calibrated_threshold(full, "s", 0.9)
