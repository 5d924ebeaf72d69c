"""Explained predictions: contribution shares and ordered observations per window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import array_total, let
from millrace.functions.timeline import iso_utc
from millrace.operators.channels import VALUE_STATISTICS

SHARE_FLOOR = 1e-12
MIN_COVERAGE = 0.8
# Words in a channel name that name the kind of deviation, checked in this order.
DEVIATIONS = (
    (("vibr",), "vibration_deviation"),
    (("temp", "therm"), "thermal_deviation"),
    (("press",), "pressure_deviation"),
)
TOP_CHANNELS = 3


def shares(errors: Column) -> Column:
    """Errors as shares of their sum."""
    return let(
        errors,
        lambda e: let(F.greatest(array_total(e), F.lit(SHARE_FLOOR)), lambda total: F.transform(e, lambda x: x / total)),
    )


def channel_shares(share: Column, channels: Column, statistics: list[str]) -> Column:
    """Summed positive share of value statistics per channel, largest first, earlier channels first on ties.

    Places in the vector follow from the channel's, so no entry is looked at twice.
    """
    places = [i for i, s in enumerate(statistics) if s in VALUE_STATISTICS]

    def total(start: Column) -> Column:
        out = F.lit(0.0)
        for place in places:
            x = F.get(share, start + F.lit(place))
            out = out + F.when(x > 0, x).otherwise(F.lit(0.0))
        return out

    counted = F.transform(
        channels,
        lambda c, i: F.struct((-total(i * F.lit(len(statistics)))).alias("negative"), i.alias("place"), c.alias("channel")),
    )
    return F.transform(
        F.array_sort(F.filter(counted, lambda t: t["negative"] < 0)),
        lambda t: F.struct(t["channel"].alias("channel"), (-t["negative"]).alias("share")),
    )


def _deviation(channel: Column) -> Column:
    name = F.lower(channel)
    tag = F.lit(None).cast("string")
    for words, label in reversed(DEVIATIONS):
        hit = F.lit(False)
        for word in words:
            hit = hit | name.contains(word)
        tag = F.when(hit, F.lit(label)).otherwise(tag)
    return tag


def _any_channel(channels: Column, statistics: list[str], statistic: str, test: Callable[[Column, Column], Column]) -> Column:
    """Whether ``test`` holds for a channel and the place of its statistic in the vector; places are few, entries are many."""
    if statistic not in statistics:
        return F.lit(False)
    at = F.lit(statistics.index(statistic))
    return F.exists(F.transform(channels, lambda c, i: test(c, i * F.lit(len(statistics)) + at)), lambda found: found)


def observations(
    alert: Column, channels: Column, statistics: list[str], share: Column, vector: Column, applicable: Column, regime_unknown: Column, regime: Column
) -> Column:
    """Ordered, distinct observation tags of a window. Shares are ranked for alerts only."""
    loss = _any_channel(channels, statistics, "missing", lambda c, at: F.array_contains(applicable, c) & (F.get(vector, at) > 0))
    sparse = _any_channel(channels, statistics, "coverage_ratio", lambda c, at: F.array_contains(applicable, c) & (F.get(vector, at) < MIN_COVERAGE))
    always = F.array(
        F.when(regime_unknown & regime.isNotNull(), F.lit("regime_mismatch")),
        F.when(loss, F.lit("signal_loss")),
        F.when(sparse, F.lit("sampling_degradation")),
    )

    def of_alert(bound: Column) -> Column:
        poor = [
            _any_channel(channels, statistics, s, lambda c, at: (F.get(bound, at) > 0) & (F.get(vector, at) > 0))
            for s in ("bad_ratio", "uncertain_ratio")
        ]
        ranked = channel_shares(bound, channels, statistics)
        top = F.transform(F.slice(ranked, 1, TOP_CHANNELS), lambda r: _deviation(r["channel"]))
        return F.concat(F.array(F.when(poor[0] | poor[1], F.lit("quality_degradation"))), top)

    on_alert = F.when(alert, let(share, of_alert)).otherwise(F.array().cast("array<string>"))
    return let(
        F.array_distinct(F.array_compact(F.concat(always, on_alert))),
        lambda found: F.when(alert & (F.size(found) == 0), F.array(F.lit("multivariate_novelty"))).otherwise(found),
    )


def prediction_records(
    scored: DataFrame,
    statistics: list[str],
    threshold: float,
    applicability: DataFrame | None = None,
    model_version: str = "0.1.0",
    raw_vector: str = "raw_vector",
    extra: dict[str, Column] | None = None,
) -> DataFrame:
    """Prediction rows from scored windows.

    ``scored`` has window identity, ``channels``, ``names``, the unscaled vector,
    ``errors`` and the three scores. ``applicability`` (``asset_class, applicable``)
    says which channels a class must have; without it no loss is reported.
    """
    rows = scored
    if applicability is not None:
        rows = rows.join(applicability.select("asset_class", "applicable"), "asset_class", "left")
    else:
        rows = rows.withColumn("applicable", F.array().cast("array<string>"))
    rows = rows.withColumn("applicable", F.coalesce("applicable", F.array().cast("array<string>")))
    rows = rows.withColumn("_share", shares(F.col("errors")))
    regime = F.col("operating_regime") if "operating_regime" in scored.columns else F.lit(None).cast("string")
    unknown = F.col("context_regime_unknown") if "context_regime_unknown" in scored.columns else F.lit(False)
    alert = F.col("irregularity") >= F.lit(float(threshold))
    found = observations(alert, F.col("channels"), list(statistics), F.col("_share"), F.col(raw_vector), F.col("applicable"), unknown, regime)
    return rows.select(
        "run_id",
        "asset_id",
        iso_utc("window_start").alias("window_start"),
        iso_utc("window_end").alias("window_end"),
        F.struct("autoencoder", "isolation_forest", "irregularity").alias("scores"),
        found.alias("observations"),
        F.map_from_arrays("names", "_share").alias("feature_contributions"),
        F.lit(model_version).alias("model_version"),
        *[column.alias(name) for name, column in (extra or {}).items()],
    )
