"""Empirical calibration, ensembles and thresholds."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import key_places
from millrace.operators.ranks import exact_quantiles, running_totals
from millrace.session import settle

DEFAULT_THRESHOLD = 0.95
AUTOENCODER_WEIGHT = 0.5
ISOLATION_WEIGHT = 0.5


# Points of a reference curve that every executor may hold (16 bytes each).
CURVE_POINTS = 2_000_000
# Beyond that, reference values of a range that meets its scored rows in one task, and rows of a range in a task.
RANGE_POINTS = 200_000
RANGE_ROWS = 500_000


@dataclass(frozen=True)
class Curve:
    """Sorted distinct reference values per key with the share of values not above each.

    ``shared`` maps a key to both as arrays. Beyond the size limit it maps a key
    to the least value of each of its ranges instead, and ``points`` has the
    values with their range.
    """

    keys: list[str]
    shared: Broadcast
    points: DataFrame | None = None


def fit_curve(reference: DataFrame, keys: Sequence[str], raw: str, curve_points: int = CURVE_POINTS, range_points: int = RANGE_POINTS) -> Curve:
    """The empirical distribution of the reference per key; null values are left out, a null key is a key."""
    keys = list(keys)
    known = reference.where(F.col(raw).isNotNull()).select(F.struct(*keys).alias("key"), F.col(raw).cast("double").alias("value"))
    totals = settle(running_totals(known, ["key"], "value", {"r": F.lit(1)}).select("key", "value", "r_upto", "r_total"), "reference-curve")
    context = reference.sparkSession.sparkContext
    if totals.count() <= curve_points:
        return Curve(keys, context.broadcast(_by_key(totals.select("key.*", "value", (F.col("r_upto") / F.col("r_total")).alias("share")), keys)))
    # Values up to the same multiple of the range size are a range; ranges follow each other in order.
    ranged = totals.select("key", "value", (F.col("r_upto") / F.col("r_total")).alias("share"), F.call_function("div", F.col("r_upto") - 1, F.lit(range_points).cast("long")).alias("range"))
    lows = ranged.groupBy("key", "range").agg(F.min("value").alias("value"))
    return Curve(keys, context.broadcast(_by_key(lows.select("key.*", "value", F.col("range").cast("double").alias("share")), keys)), ranged)


def _by_key(rows: DataFrame, keys: list[str]) -> dict[tuple, tuple[np.ndarray, np.ndarray]]:
    """Rows (keys, value, share) as sorted arrays per key."""
    table = rows.toArrow()
    value, share = (table.column(c).to_numpy() for c in ("value", "share"))
    out = {}
    for key, places in key_places([table.column(k).combine_chunks() for k in keys], table.num_rows):
        order = places[np.argsort(value[places])]
        out[key] = value[order], share[order]
    return out


def _looked_up(shared: Broadcast, below: float):
    """A function of keys and raw scores: what the last curve value not above each raw score has."""

    @F.arrow_udf("double")
    def share(raw: pa.Array, *keys: pa.Array) -> pa.Array:
        value = raw.to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.full(len(value), np.nan)
        for key, places in key_places(list(keys), len(value)):
            if key not in shared.value:
                raise ValueError(f"No calibration reference for {key}")
            values, shares = shared.value[key]
            at = np.searchsorted(values, value[places], side="right")
            out[places] = np.where(at > 0, shares[np.maximum(at, 1) - 1], below)
        return pa.array(out, mask=raw.is_null().to_numpy(zero_copy_only=False))

    return share


def calibrate(values: DataFrame, reference: DataFrame | Curve, keys: Sequence[str], raw: str, output: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """Add the share of the key's reference values that are not above the row's raw score.

    The reference is sorted once; scored rows stay where they are and look their
    place up by bisection. Only a curve beyond ``CURVE_POINTS`` makes them meet
    its ranges, in tasks of some ``range_rows``. A row of a key without reference
    fails the job; a null score stays null.
    """
    curve = reference if isinstance(reference, Curve) else fit_curve(reference, keys, raw)
    score = F.col(raw).cast("double")
    if curve.points is None:
        return values.withColumn(output, _looked_up(curve.shared, 0.0)(score, *[F.col(k) for k in keys]))
    names = values.columns
    placed = settle(values.withColumn("_range", _looked_up(curve.shared, -1.0)(score, *[F.col(k) for k in keys]).cast("long")).withColumn("_key", F.struct(*keys)), "ranged-scores")
    salts = settle(placed.groupBy("_key", "_range").agg(F.ceil(F.count("*") / F.lit(range_rows)).cast("int").alias("_salts")), "range-salts")
    salted = placed.join(F.broadcast(salts), placed["_key"].eqNullSafe(salts["_key"]) & placed["_range"].eqNullSafe(salts["_range"]), "left").select(
        *names, placed["_key"], placed["_range"], F.pmod(F.xxhash64(*names), F.col("_salts")).cast("int").alias("_salt")
    )
    copies = curve.points.join(salts, (F.col("key") == F.col("_key")) & (F.col("range") == F.col("_range"))).select(
        "_key", "_range", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)).alias("_salt"), "value", "share"
    )
    schema = T.StructType([*values.schema.fields, T.StructField(output, T.DoubleType())])

    def meet(rows: pa.Table, points: pa.Table) -> pa.Table:
        known = rows.column(raw).cast(pa.float64()).to_numpy()
        order = np.argsort(points.column("value").to_numpy())
        at = np.searchsorted(points.column("value").to_numpy()[order], known, side="right")
        shares = points.column("share").to_numpy()[order]
        # Below the first range there is nothing to meet, and a null score has no range.
        found = np.where(at > 0, shares[np.maximum(at, 1) - 1], 0.0) if len(shares) else np.zeros(len(known))
        return rows.select(names).append_column(output, pa.array(found, mask=rows.column(raw).is_null().to_numpy()))

    by = ["_key", "_range", "_salt"]
    return salted.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(meet, schema)


def ensemble_weights(autoencoder: float = AUTOENCODER_WEIGHT, isolation: float = ISOLATION_WEIGHT) -> tuple[float, float]:
    """Weights that sum to one."""
    a, b = float(autoencoder), float(isolation)
    if not (math.isfinite(a) and math.isfinite(b)) or min(a, b) < 0 or a + b <= 0:
        raise ValueError("Ensemble weights must be finite, nonnegative and not both zero")
    return a / (a + b), b / (a + b)


def ensemble(autoencoder: Column, isolation: Column, weights: tuple[float, float]) -> Column:
    return F.lit(weights[0]) * autoencoder + F.lit(weights[1]) * isolation


def fused(*scores: Column) -> Column:
    """The most alarmed of several detectors."""
    return F.greatest(*scores)


def normal_quantile(scores: DataFrame, score: str, quantile: float, keys: Sequence[str] = ()) -> DataFrame:
    """Upper order-statistic quantile of normal scores; alerts are strictly above it."""
    return exact_quantiles(scores, keys, score, [quantile], ["cut"], method="higher")


def calibrated_threshold(scores: DataFrame, score: str, quantile: float = 0.99) -> float:
    """Smallest threshold that none of the scores at the quantile reaches."""
    if not 0 < quantile < 1:
        raise ValueError("The calibration quantile must lie inside (0, 1)")
    row = normal_quantile(scores, score, quantile).first()
    if row is None:
        raise ValueError("No calibration scores")
    threshold = math.nextafter(row["cut"], math.inf)
    if threshold > 1:
        raise ValueError("At this quantile no score could ever alert; use a lower one")
    return threshold


def normal_only(windows: DataFrame) -> DataFrame:
    """Normal windows for calibration; unlabelled tables are taken as normal. At least one is required."""
    out = windows.filter(~F.col("is_anomaly")) if "is_anomaly" in windows.columns else windows
    if out.limit(1).isEmpty():
        raise ValueError("Calibration needs at least one normal window")
    return out


def score_summary(scored: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Windows, normal windows and median of each score."""
    labelled = "is_anomaly" in scored.columns
    counts = scored.agg(
        F.count("*").alias("validation_windows"),
        (F.count_if(~F.col("is_anomaly")) if labelled else F.count("*")).alias("calibration_normal_windows"),
        (~F.bool_or("is_anomaly") if labelled else F.lit(None).cast("boolean")).alias("validation_normal_only"),
        F.lit(not labelled).alias("validation_normal_assumed"),
    )
    long = scored.select(F.explode(F.array(*[F.struct(F.lit(s).alias("name"), F.col(s).cast("double").alias("x")) for s in scores])).alias("_s")).select("_s.*")
    medians = exact_quantiles(long, ["name"], "x", [0.5], ["median"]).groupBy().agg(
        *[F.max(F.when(F.col("name") == s, F.col("median"))).alias(f"{s}_median") for s in scores]
    )
    return counts.withColumn("_row", F.lit(0)).join(medians.withColumn("_row", F.lit(0)), "_row").drop("_row")
