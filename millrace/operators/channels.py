"""Channel identity, exclusions and per-class applicability."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranks import exact_quantiles

# The statistics of a channel in a window, in output order.
STATISTICS = (
    "mean", "median", "min", "max", "range", "std", "mad", "last", "delta", "slope",
    "sample_count", "expected_sample_count", "coverage_ratio",
    "good_ratio", "uncertain_ratio", "bad_ratio", "missing",
)
# Which statistics belong to which switchable family.
FAMILIES = {
    "statistical": ("mean", "median", "min", "max", "range", "std", "mad", "last", "delta"),
    "slopes": ("slope",),
    "quality": ("good_ratio", "uncertain_ratio", "bad_ratio"),
    "sampling": ("sample_count", "expected_sample_count", "coverage_ratio", "missing"),
}
# Statistics that describe a value (not its sampling or quality).
VALUE_STATISTICS = ("mean", "median", "min", "max", "range", "std", "mad", "last", "delta", "slope")
# The compact subset used by compact class models.
COMPACT_STATISTICS = (
    "mean", "std", "range", "delta", "slope", "coverage_ratio", "uncertain_ratio", "bad_ratio", "missing",
)


def chosen_statistics(families: dict[str, bool] | None = None, compact: bool = False) -> tuple[str, ...]:
    """Statistics left when some families are switched off."""
    off = {name for family, on in (families or {}).items() if not on for name in FAMILIES.get(family, ())}
    return tuple(s for s in STATISTICS if s not in off and (not compact or s in COMPACT_STATISTICS))


def channel_of(feature: str) -> str | None:
    """Channel part of a feature name; the longest matching statistic wins, so that
    ``flow_sample_count`` belongs to ``flow`` and not to ``flow_sample``."""
    matches = [s for s in STATISTICS if feature.endswith("_" + s)]
    return feature[: -len(max(matches, key=len)) - 1] if matches else None


# Columns of a window table that identify or label it and are never features.
NOT_FEATURES = frozenset({
    "run_id", "asset_id", "asset_class", "operating_regime", "window_start", "window_end",
    "is_anomaly", "event_id", "event_start_us",
})


def feature_names(columns: Iterable[str]) -> list[str]:
    """Columns of a wide window table that are features."""
    return [c for c in columns if c not in NOT_FEATURES]


def check_feature_schema(columns: Iterable[str], trained: Sequence[str]) -> None:
    """Refuse a wide window table that lacks trained features or brings others."""
    produced = set(feature_names(columns))
    missing, extra = sorted(set(trained) - produced), sorted(produced - set(trained))
    if missing or extra:
        raise ValueError(f"Feature mismatch: missing={missing}, extra={extra}")


def exclude_inputs(
    df: DataFrame, signal_classes: Sequence[str] = (), measurement_roles: Sequence[str] = ()
) -> DataFrame:
    """Drop configured classes and roles. With an active list, rows without a class or role go too."""
    out = df
    for column, banned in (("signal_class", signal_classes), ("measurement_role", measurement_roles)):
        if banned and column in df.columns:
            out = out.filter(~F.col(column).isin(list(banned)))
    return out


def continuous_only(df: DataFrame) -> DataFrame:
    """Keep continuous values; a missing kind counts as continuous."""
    if "value_kind" not in df.columns:
        return df
    return df.filter(F.col("value_kind").isNull() | (F.col("value_kind") == "continuous"))


def channel_source(df: DataFrame) -> str:
    """The column that names channels: the role when that column exists, else the signal class."""
    return "measurement_role" if "measurement_role" in df.columns else "signal_class"


def with_channel(df: DataFrame) -> DataFrame:
    """Name the channel of every row; rows without a name share the channel "None"."""
    return df.withColumn("channel", F.coalesce(F.col(channel_source(df)).cast("string"), F.lit("None")))


def unknown_channels(df: DataFrame, trained: Sequence[str]) -> DataFrame:
    """Channels that occur but were not trained, with row counts."""
    return df.filter(~F.col("channel").isin(list(trained))).groupBy("channel").agg(F.count("*").alias("rows"))


def class_channels(df: DataFrame) -> DataFrame:
    """Channels seen per asset class, sorted. The list per class is as short as the class's channel set."""
    pairs = df.filter(F.col("channel").isNotNull()).select("asset_class", "channel").distinct()
    return pairs.groupBy("asset_class").agg(F.sort_array(F.collect_list("channel")).alias("channels"))


def channel_intervals(df: DataFrame) -> DataFrame:
    """Median sampling interval per channel."""
    known = df.filter(F.col("sampling_interval_ms").isNotNull()).select(
        "channel", F.col("sampling_interval_ms").cast("double").alias("sampling_interval_ms")
    )
    return exact_quantiles(known, ["channel"], "sampling_interval_ms", [0.5], ["median_interval_ms"])


def applicable_features(channels: Column, statistics: Sequence[str]) -> Column:
    """Names ``{channel}_{statistic}`` for an array of channels."""
    stats = F.array(*[F.lit(s) for s in statistics])
    return F.flatten(F.transform(channels, lambda c: F.transform(stats, lambda s: F.concat(c, F.lit("_"), s))))
