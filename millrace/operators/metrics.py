"""Window-level and event-level evaluation, for any number of groups at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ranks import running_totals


def _one(keys: Sequence[str], df: DataFrame) -> tuple[list[str], DataFrame]:
    return (list(keys), df) if keys else (["_all"], df.withColumn("_all", F.lit(0)))


def confusion(df: DataFrame, keys: Sequence[str], label: str, alert: Column, window_seconds: float = 60.0) -> DataFrame:
    """Precision, recall, F1 (0 where undefined) and false-positive rates over observed time."""
    zero = F.lit(0.0)
    counted = df.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.count_if(label).alias("positive_samples"),
        F.count_if(F.col(label) & alert).alias("_hits"),
        F.count_if(alert).alias("alerts"),
        F.count_if(alert & ~F.col(label)).alias("false_positive_windows"),
    )
    hours = F.col("samples") * F.lit(float(window_seconds)) / F.lit(3600.0)
    return counted.select(
        *keys,
        "samples",
        "positive_samples",
        "alerts",
        F.coalesce(F.try_divide("_hits", "alerts"), zero).alias("precision"),
        F.coalesce(F.try_divide("_hits", "positive_samples"), zero).alias("recall"),
        F.coalesce(
            F.try_divide(F.lit(2.0) * F.col("_hits"), F.col("alerts") + F.col("positive_samples")), zero
        ).alias("f1"),
        "false_positive_windows",
        (F.col("false_positive_windows") / F.greatest(hours, F.lit(1e-12))).alias("false_positives_per_asset_hour"),
        (F.col("false_positive_windows") / F.greatest(hours / F.lit(24.0), F.lit(1e-12))).alias("false_positives_per_asset_day"),
    )


def ranking_quality(df: DataFrame, keys: Sequence[str], label: str, score: str, weight: Column | None = None) -> DataFrame:
    """Average precision and ROC area over distinct scores, ties together.

    ``pr_auc`` is null without positives, ``roc_auc`` also without negatives.
    ``weight`` counts a row several times.
    """
    by, source = _one(keys, df)
    w = weight if weight is not None else F.lit(1)
    w = w.cast("bigint")
    y = F.col(label).cast("boolean")
    # Descending order is ascending order of the negated score.
    curve = running_totals(
        source.withColumn("_down", -F.col(score).cast("double")),
        by,
        "_down",
        {"p": F.when(y, w).otherwise(0), "a": w},
    )
    p, p_upto, p_total = F.col("p"), F.col("p_upto"), F.col("p_total")
    negatives = F.col("a") - p
    step = F.try_divide(p, p_total) * F.try_divide(p_upto, F.col("a_upto"))
    # Positives ranked above each negative, half of those level with it.
    above = negatives * (p_upto - p / F.lit(2.0))
    found = curve.groupBy(*by).agg(
        F.sum(step).alias("_ap"),
        F.sum(above).alias("_above"),
        F.max("p_total").alias("_p"),
        F.max("a_total").alias("_a"),
    )
    n = F.col("_a") - F.col("_p")
    return found.select(
        *keys,
        F.when(F.col("_p") > 0, F.col("_ap")).alias("pr_auc"),
        F.when((F.col("_p") > 0) & (n > 0), F.try_divide("_above", F.col("_p") * n)).alias("roc_auc"),
    )


def named_event(column: str = "event_id") -> Column:
    """True for a usable event id: not null, not empty, not the text of a missing number."""
    return F.col(column).isNotNull() & ~F.col(column).isin("", "NaN")


def event_hits(df: DataFrame, keys: Sequence[str], alert: Column) -> DataFrame:
    """Per event id: whether any of its windows alerts, and the delay of the first alert, never negative."""
    per_event = df.filter(named_event()).groupBy(*keys, "event_id").agg(
        F.bool_or(alert).alias("detected"),
        F.min("event_start_us").alias("_onset"),
        F.min(F.when(alert, F.col("window_end"))).alias("_end"),
    )
    delay = F.greatest(F.lit(0.0), (F.col("_end") - F.col("_onset")) / F.lit(1e6))
    return per_event.select(
        *keys, "event_id", "detected",
        F.when(F.col("_end").isNotNull() & F.col("_onset").isNotNull(), delay).alias("latency_seconds"),
    )


def event_rates(df: DataFrame, keys: Sequence[str], alert: Column) -> DataFrame:
    return event_hits(df, keys, alert).groupBy(*keys).agg(
        F.count("*").alias("event_count"),
        F.try_divide(F.count_if("detected"), F.count("*")).alias("event_detection_rate"),
        F.avg("latency_seconds").alias("mean_detection_latency_seconds"),
    )


def evaluate_windows(
    df: DataFrame,
    keys: Sequence[str],
    score: str,
    threshold: float | str,
    label: str = "is_anomaly",
    window_seconds: float = 60.0,
    with_events: bool = True,
    strict: bool = False,
) -> DataFrame:
    """All window metrics per group. ``threshold`` is a number or a column constant within the group."""
    by, source = _one(keys, df)
    level = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    alert = (F.col(score) > level) if strict else (F.col(score) >= level)
    out = confusion(source, by, label, alert, window_seconds).join(ranking_quality(source, by, label, score), by)
    if with_events:
        out = out.join(event_rates(source, by, alert), by, "left").withColumn(
            "event_count", F.coalesce("event_count", F.lit(0).cast("bigint"))
        )
    return out if keys else out.drop("_all")


def threshold_sweep(df: DataFrame, score: str, thresholds: Sequence[float], label: str = "is_anomaly") -> DataFrame:
    """Alerts, false alerts, recall and detected events per threshold.

    Each window is reduced to the number of thresholds it reaches before the
    thresholds are laid out, so rows are not multiplied by them.
    """
    levels = sorted(thresholds)
    reach = F.size(F.filter(F.array(*[F.lit(float(t)) for t in levels]), lambda t: F.col(score) >= t))
    rows = df.withColumn("_reach", reach)
    windows = rows.groupBy("_reach").agg(
        F.count("*").alias("_n"), F.count_if(label).alias("_p")
    )
    events = (
        rows.filter(named_event()).groupBy("event_id").agg(F.max("_reach").alias("_reach"))
        .groupBy("_reach").agg(F.count("*").alias("_events"))
    )
    both = windows.join(events, "_reach", "full").na.fill(0)
    table = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(float(t)).alias("threshold")) for i, t in enumerate(levels)])
    laid = both.withColumn("_t", F.explode(table))
    hit = F.col("_reach") >= F.col("_t.rank")
    zero = F.lit(0).cast("bigint")
    return laid.groupBy(F.col("_t.threshold").alias("threshold")).agg(
        F.sum(F.when(hit, F.col("_n")).otherwise(zero)).alias("alerts"),
        F.sum(F.when(hit, F.col("_n") - F.col("_p")).otherwise(zero)).alias("false_alerts"),
        F.coalesce(F.try_divide(F.sum(F.when(hit, F.col("_p")).otherwise(zero)), F.sum("_p")), F.lit(0.0)).alias("recall"),
        F.sum(F.when(hit, F.col("_events")).otherwise(zero)).alias("detected_events"),
        F.sum("_events").alias("event_count"),
    )


def by_detector(df: DataFrame, scores: Sequence[str]) -> DataFrame:
    """Long form of several score columns: ``detector``, ``score``."""
    return df.unpivot(
        [c for c in df.columns if c not in scores], list(scores), "detector", "score"
    )
