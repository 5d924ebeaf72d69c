"""Experiment tables: candidates, ranking, dispersion, paired differences, operating points and gates."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.channels import FAMILIES, continuous_only
from millrace.operators.metrics import evaluate_windows
from millrace.operators.ranks import exact_quantiles, running_totals

BASELINE = "baseline"
# Ranked metrics and whether larger is better.
RANKED = {"pr_auc": True, "event_detection_rate": True, "false_positives_per_asset_day": False}
AVERAGED = ("pr_auc", "precision", "recall", "event_detection_rate", "false_positives_per_asset_day", "latency_seconds")


def ablation_candidates(rows: DataFrame) -> DataFrame:
    """Baseline, one candidate without each signal class, one without each feature family."""
    classes = continuous_only(rows).filter(F.col("signal_class").isNotNull()).select("signal_class").distinct()
    fixed = [(BASELINE, None, None)] + [(f"without-{f}", None, f) for f in FAMILIES]
    spark = rows.sparkSession
    static = spark.createDataFrame(fixed, "candidate_id string, excluded_class string, disabled_family string")
    return static.unionByName(
        classes.select(
            F.concat(F.lit("without-class-"), F.col("signal_class")).alias("candidate_id"),
            F.col("signal_class").alias("excluded_class"),
            F.lit(None).cast("string").alias("disabled_family"),
        )
    )


def candidate_means(results: DataFrame, metrics: Sequence[str] = AVERAGED) -> DataFrame:
    """Completed repeats and null-skipping means per candidate."""
    done = results.filter(F.col("status") == "completed") if "status" in results.columns else results
    return done.groupBy("candidate_id").agg(
        F.count("*").alias("repeats_completed"), *[F.avg(m).alias(m) for m in metrics if m in results.columns]
    )


def mean_ranks(means: DataFrame, ranked: Mapping[str, bool] = RANKED) -> DataFrame:
    """Mean of metric ranks; a null metric does not count. Level values are ranked by candidate id."""
    entries = F.explode(
        F.array(
            *[
                F.struct(F.lit(m).alias("metric"), (-F.col(m) if larger else F.col(m)).cast("double").alias("cost"))
                for m, larger in ranked.items()
            ]
        )
    )
    costs = means.select("candidate_id", entries.alias("_e")).select("candidate_id", "_e.*").filter(F.col("cost").isNotNull())
    order = running_totals(costs.withColumn("_at", F.struct("cost", "candidate_id")), ["metric"], "_at", {"n": F.lit(1)})
    ranks = order.groupBy(F.col("_at.candidate_id").alias("candidate_id")).agg(F.avg("n_upto").alias("mean_rank"))
    return means.join(ranks, "candidate_id", "left")


def ranking_order() -> list[Column]:
    """Best mean rank first, unranked last, then precision-recall area, then id."""
    return [F.col("mean_rank").asc_nulls_last(), F.coalesce("pr_auc", F.lit(0.0)).desc(), F.col("candidate_id").asc()]


def finalists(ranked: DataFrame, count: int) -> DataFrame:
    return ranked.orderBy(*ranking_order()).limit(count)


def dispersion(values: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Count, mean, sample deviation (0 for one value), minimum and maximum of non-null values."""
    return values.filter(F.col(column).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(column).alias("mean"),
        F.coalesce(F.stddev_samp(column), F.lit(0.0)).alias("sample_sd"),
        F.min(column).alias("min"),
        F.max(column).alias("max"),
    )


def _t_cdf(t: float, df: int) -> float:
    """Student-t distribution function for t >= 0 by the closed recurrences for integer degrees of freedom."""
    angle = math.atan2(t, math.sqrt(df))
    c, s = math.cos(angle), math.sin(angle)
    if df == 1:
        return 0.5 + angle / math.pi
    term, total = (c, c) if df % 2 else (1.0, 1.0)
    for k in range(3 if df % 2 else 2, df - 1, 2):
        term *= c * c * (k - 1) / k
        total += term
    central = (angle + s * total) * 2 / math.pi if df % 2 else s * total
    return 0.5 + central / 2


def t_quantile(df: int, p: float = 0.975) -> float:
    """Student-t quantile for p > 0.5, by bisection."""
    low, high = 0.0, 1.0
    while _t_cdf(high, df) < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _t_cdf(mid, df) < p else (low, mid)
    return (low + high) / 2


def paired_values(values: DataFrame, metric: str, candidate: str = "candidate_id", dataset: str = "dataset_id", baseline: str = BASELINE) -> DataFrame:
    """Candidate and baseline value per data set. Unequal coverage is refused."""
    base = values.filter(F.col(candidate) == baseline).select(dataset, F.col(metric).alias("base"))
    others = values.filter(F.col(candidate) != baseline).select(candidate, dataset, F.col(metric).alias("value"))
    expected = base.count()
    joined = others.join(base, dataset, "left")
    uneven = joined.groupBy(candidate).agg(
        F.count("*").alias("rows"), F.count_if(F.col("base").isNull()).alias("unmatched"), F.count_distinct(dataset).alias("sets")
    ).filter((F.col("rows") != expected) | (F.col("unmatched") > 0) | (F.col("sets") != expected))
    if not uneven.limit(1).isEmpty():
        raise ValueError("Data sets differ between baseline and candidate")
    return joined


def paired_differences(pairs: DataFrame, keys: Sequence[str] = ("candidate_id",)) -> DataFrame:
    """Mean difference to the baseline with a two-sided 95 % Student-t interval; null bounds for one pair."""
    found = pairs.withColumn("_d", F.col("value") - F.col("base")).groupBy(*keys).agg(
        F.count("_d").alias("n"), F.avg("_d").alias("mean_difference"), F.coalesce(F.stddev_samp("_d"), F.lit(0.0)).alias("sample_sd")
    )
    sizes = sorted(r[0] for r in found.select("n").distinct().collect())
    quantile = F.lit(None).cast("double")
    for n in sizes:
        if n > 1:
            quantile = F.when(F.col("n") == n, F.lit(t_quantile(n - 1))).otherwise(quantile)
    half = quantile * F.col("sample_sd") / F.sqrt("n")
    return found.select(
        *keys, "n", "mean_difference", "sample_sd",
        (F.col("mean_difference") - half).alias("ci95_low"), (F.col("mean_difference") + half).alias("ci95_high"),
    )


WEIGHT_GRID = (1.0, 0.9, 0.75, 0.5)
QUANTILE_GRID = (0.98, 0.99, 0.995)


def operating_points(
    windows: DataFrame,
    calibration: DataFrame,
    variants: Sequence[str] = (),
    weights: Sequence[float] = WEIGHT_GRID,
    quantiles: Sequence[float] = QUANTILE_GRID,
    window_seconds: float = 60.0,
    with_events: bool = False,
) -> DataFrame:
    """Metrics for every variant, autoencoder weight and calibration quantile.

    Both tables have ``autoencoder`` and ``isolation``; calibration holds normal
    windows only and fixes each threshold. ``variants`` are grouping columns.
    """
    grid = F.explode(F.array(*[F.lit(float(w)) for w in weights]))

    def mixed(df: DataFrame) -> DataFrame:
        out = df.withColumn("ae_weight", grid)
        weight = F.col("ae_weight")
        return out.withColumn("score", weight * F.col("autoencoder") + (F.lit(1.0) - weight) * F.col("isolation"))

    by = [*variants, "ae_weight"]
    names = [f"q{i}" for i in range(len(quantiles))]
    cuts = exact_quantiles(mixed(calibration), by, "score", quantiles, names, method="higher")
    table = cuts.select(
        *by,
        F.explode(
            F.array(*[F.struct(F.lit(float(q)).alias("quantile"), F.col(n).alias("cut")) for q, n in zip(quantiles, names)])
        ).alias("_q"),
    ).select(*by, "_q.*")
    laid = mixed(windows).join(table, by)
    return evaluate_windows(laid, [*by, "quantile"], "score", "cut", window_seconds=window_seconds, with_events=with_events, strict=True)


# Metrics that decide whether a candidate may replace the baseline, as (metric, rule).
GATES = (
    ("physical_detected", "more"),
    ("detected_events", "not_less"),
    ("precision", "at_least_half"),
    ("false_positive_windows", "not_more"),
)


def eligible_candidates(rows: DataFrame, baseline: str = BASELINE, gates=GATES) -> DataFrame:
    """Candidates passing all gates, best first."""
    base = rows.filter(F.col("candidate_id") == baseline).first()
    if base is None:
        raise ValueError("The experiment has no baseline row")
    keep = F.col("candidate_id") != baseline
    for metric, rule in gates:
        mine, theirs = F.col(metric), F.lit(base[metric])
        keep = keep & {
            "more": mine > theirs, "not_less": mine >= theirs, "not_more": mine <= theirs, "at_least_half": mine >= 0.5,
        }[rule]
    order = [F.col("physical_detected").desc(), F.col("detected_events").desc(), F.col("false_positive_windows").asc(), F.col("candidate_id")]
    return rows.filter(keep).orderBy(*order)
