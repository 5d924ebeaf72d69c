"""Fixed-order feature vectors, per-class scaling and regime centring."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import entrywise, finite, let
from millrace.operators.channels import applicable_features
from millrace.operators.vector_quantiles import vector_quantiles

CLASS = "asset_class"


def class_vectors(features: DataFrame, channels: DataFrame, statistics: Sequence[str]) -> DataFrame:
    """Window rows with ``vector``: the statistics of the channels that apply to the window's class.

    ``channels`` holds ``asset_class, channels``. Windows of a class it lacks are dropped;
    check with ``unknown_classes`` first.
    """
    by_channel = F.transform(
        F.col("channels"),
        lambda c: let(F.element_at(F.col("stats"), c), lambda found: F.array(*[found[s] for s in statistics])),
    )
    keep = [c for c in features.columns if c != "stats"]
    return features.join(channels.select(CLASS, "channels"), CLASS).select(
        *keep,
        "channels",
        F.flatten(by_channel).alias("vector"),
        applicable_features(F.col("channels"), statistics).alias("names"),
    )


def pooled_vectors(features: DataFrame, channels: Sequence[str], statistics: Sequence[str], extra: Sequence[str] = ()) -> DataFrame:
    """Window rows with one vector layout for all classes, plus extra columns such as encoded contexts."""
    parts = [F.element_at(F.col("stats"), F.lit(c))[s] for c in channels for s in statistics]
    parts += [F.col(c).cast("double") for c in extra]
    names = [f"{c}_{s}" for c in channels for s in statistics] + list(extra)
    keep = [c for c in features.columns if c != "stats"]
    return features.select(*keep, F.array(*parts).alias("vector"), F.array(*[F.lit(n) for n in names]).alias("names"))


def unknown_classes(windows: DataFrame, trained: DataFrame) -> DataFrame:
    """Classes (null included) of windows without a trained model."""
    return windows.select(CLASS).distinct().join(trained.select(CLASS), CLASS, "left_anti")


def refuse_unknown_classes(windows: DataFrame, trained: DataFrame) -> None:
    found = [r[0] for r in unknown_classes(windows, trained).limit(5).collect()]
    if found:
        raise ValueError(f"Untrained asset classes: {sorted(map(str, found))}")


def non_finite_vectors(rows: DataFrame, vector: str = "vector") -> DataFrame:
    """Rows whose vector has a null, NaN or infinite entry."""
    return rows.filter(F.exists(vector, lambda v: ~finite(v)))


def exploded(rows: DataFrame, keys: Sequence[str], vector: str = "vector") -> DataFrame:
    """One row per vector entry: keys, ``position``, ``x``."""
    return rows.select(*keys, F.posexplode(vector).alias("position", "x"))


def _packed(long: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rebuild arrays in position order; a group has as many rows as a vector has entries."""
    item = F.struct("position", *columns)
    packed = long.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("_items"))
    return packed.select(*keys, *[F.col(f"_items.{c}").alias(c) for c in columns])


def fit_scaler(rows: DataFrame, keys: Sequence[str] = (CLASS,), kind: str = "robust", vector: str = "vector") -> DataFrame:
    """Centre and spread per key and entry: median and interquartile range, or mean and population deviation.

    A zero spread becomes 1, so constant entries scale to zero.
    """
    if kind not in ("robust", "standard"):
        raise ValueError("Scaler must be robust or standard")
    keys = list(keys)
    if kind == "robust":
        found = vector_quantiles(rows, keys, vector, [0.25, 0.5, 0.75], ["low", "center", "high"])
        spread = F.zip_with("high", "low", lambda h, l: F.when(h == l, 1.0).otherwise(h - l))
        return found.select(*keys, "center", spread.alias("spread"))
    fitted = exploded(rows, keys, vector).groupBy(*keys, "position").agg(F.avg("x").alias("center"), F.stddev_pop("x").alias("spread"))
    safe = fitted.withColumn("spread", F.when(F.col("spread") == 0, 1.0).otherwise(F.col("spread")))
    return _packed(safe, keys, ["center", "spread"])


def apply_scaler(rows: DataFrame, scaler: DataFrame, keys: Sequence[str] = (CLASS,), vector: str = "vector") -> DataFrame:
    @F.arrow_udf("array<double>")
    def scaled(vector: pa.Array, center: pa.Array, spread: pa.Array) -> pa.Array:
        return entrywise(lambda x, c, s: pc.divide(pc.subtract(x, c), s), vector, center, spread)

    doubles = [F.col(c).cast("array<double>") for c in (vector, "center", "spread")]
    return (
        rows.join(scaler.select(*keys, "center", "spread"), list(keys))
        .withColumn(vector, scaled(*doubles))
        .drop("center", "spread")
    )


REGIME = "operating_regime"
MIN_REGIME_WINDOWS = 20


def fit_regimes(fit: DataFrame, keys: Sequence[str] = (CLASS,), vector: str = "vector", least: int = MIN_REGIME_WINDOWS) -> tuple[DataFrame, DataFrame]:
    """Median vector per (key, regime) seen often enough, and per key as the fallback."""
    keys = list(keys)
    per_regime = vector_quantiles(fit.filter(F.col(REGIME).isNotNull()), [*keys, REGIME], vector, [0.5], ["regime_center"])
    fallback = vector_quantiles(fit, keys, vector, [0.5], ["fallback_center"])
    return per_regime.filter(F.array_max("counts") >= least).drop("counts"), fallback.drop("counts")


def center_by_regime(rows: DataFrame, regimes: DataFrame, fallback: DataFrame, keys: Sequence[str] = (CLASS,), vector: str = "vector") -> DataFrame:
    """Subtract the regime's centre, or the fallback where the regime has none (``regime_fallback``)."""
    keys = list(keys)
    joined = rows.join(regimes, [*keys, REGIME], "left").join(fallback, keys)
    center = F.coalesce("regime_center", "fallback_center")
    return (
        joined.withColumn(vector, F.zip_with(F.col(vector), center, lambda x, c: x - c))
        .withColumn("regime_fallback", F.col("regime_center").isNull())
        .drop("regime_center", "fallback_center")
    )
