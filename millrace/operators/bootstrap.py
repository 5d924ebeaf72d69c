"""Paired cluster bootstrap over whole runs.

Draws come from digests of (seed, replicate, slot), so they do not depend on
partitioning. Data is reduced per run before replicates are laid out.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.hashing import digest_prefix
from millrace.functions.keys import key_places
from millrace.operators.metrics import named_event
from millrace.operators.ranks import exact_quantiles, running_totals
from millrace.session import settle

SEED = 20261005
# Cells that one task orders at once; each brings a weight per replicate.
RANGE_CELLS = 4_000
_CHUNK = 1_000


def draw_runs(runs: DataFrame, repeats: int, seed: int = SEED) -> DataFrame:
    """``replicate, run_id, times``: each replicate draws as many runs as there are, with replacement."""
    numbered = running_totals(runs.select("run_id").distinct(), [], "run_id", {"n": F.lit(1)})
    slots = numbered.select((F.col("n_upto") - 1).alias("slot"), F.col("n_total").alias("runs"))
    draws = slots.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("replicate"), F.col("slot"))
    picked = draws.select("replicate", F.pmod(digest_prefix(text), F.col("runs")).alias("slot"))
    times = picked.groupBy("replicate", "slot").agg(F.count("*").alias("times"))
    names = numbered.select((F.col("n_upto") - 1).alias("slot"), "run_id")
    return times.join(names, "slot").select("replicate", "run_id", "times")


def interval(values: DataFrame, column: str, keys: Sequence[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Percentile interval of replicate values; null values are left out and reduce the count."""
    return exact_quantiles(values, keys, column, [low, high], ["lower", "upper"]).withColumnRenamed("n", "replicates")


def resampled_sums(per_run: DataFrame, draws: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per replicate: sums of per-run columns, each run counted as often as it was drawn."""
    return draws.join(per_run, "run_id").groupBy("replicate").agg(
        *[F.sum(F.col(c) * F.col("times")).alias(c) for c in columns]
    )


def event_rate_interval(details: DataFrame, draws: DataFrame, runs: DataFrame, arms: Sequence[str] = ("baseline", "candidate"), subset: Column | None = None) -> DataFrame:
    """Interval of the change in detection rate between two arms of event details.

    Replicates in which an arm has no events are skipped.
    """
    chosen = details.filter(subset) if subset is not None else details
    counts = []
    for arm in arms:
        here = F.col("arm") == arm
        counts += [F.count_if(here).alias(f"{arm}_n"), F.count_if(here & F.col("detected")).alias(f"{arm}_d")]
    names = [f"{arm}_{x}" for arm in arms for x in ("n", "d")]
    per_run = runs.select("run_id").distinct().join(chosen.groupBy("run_id").agg(*counts), "run_id", "left").na.fill(0, names)
    sums = resampled_sums(per_run, draws, names)
    a, b = arms
    delta = F.try_divide(F.col(f"{b}_d"), F.col(f"{b}_n")) - F.try_divide(F.col(f"{a}_d"), F.col(f"{a}_n"))
    return interval(sums.withColumn("delta", delta), "delta")


def count_change_interval(windows: DataFrame, draws: DataFrame, before: Column, after: Column) -> DataFrame:
    """Interval of the change in a count of windows between two rules."""
    per_run = windows.groupBy("run_id").agg((F.count_if(after) - F.count_if(before)).alias("delta"))
    return interval(resampled_sums(per_run, draws, ["delta"]), "delta")


def _times(table: pa.Table) -> np.ndarray:
    """Draws of each row's run, one column per replicate."""
    column = table.column("times").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _arms(table: pa.Table):
    """Per arm: scores downwards, where each distinct score is, and its positives and windows per replicate."""
    down, times = table.column("down").to_numpy(), _times(table)
    counts = [table.column(name).to_numpy() for name in ("p", "a")]
    for (arm,), places in key_places([table.column("arm").combine_chunks()], table.num_rows):
        places = places[np.argsort(down[places], kind="stable")]
        ordered = down[places]
        new = np.ones(len(places), dtype=bool)
        new[1:] = (ordered[1:] != ordered[:-1]) & ~(np.isnan(ordered[1:]) & np.isnan(ordered[:-1]))
        level = np.cumsum(new) - 1
        sums = [np.zeros((level[-1] + 1, times.shape[1]), dtype=np.int64) for _ in counts]
        for low in range(0, len(places), _CHUNK):
            here, levels = places[low : low + _CHUNK], level[low : low + _CHUNK]
            starts = np.flatnonzero(np.diff(levels, prepend=levels[0] - 1))
            for total, count in zip(sums, counts):
                total[levels[0] : levels[-1] + 1] += np.add.reduceat(count[here, None] * times[here], starts, axis=0)
        yield arm, *sums


def _range_totals(key: tuple, table: pa.Table) -> pa.Table:
    rows = [(arm, p.sum(axis=0).tolist(), a.sum(axis=0).tolist()) for arm, p, a in _arms(table)]
    arm, p, a = zip(*rows)
    return pa.table({"range": pa.array([key[0].as_py()] * len(rows), pa.int32()), "arm": pa.array(arm, pa.string()), "p": pa.array(p, pa.list_(pa.int64())), "a": pa.array(a, pa.list_(pa.int64()))})


def _range_precision(key: tuple, cells: pa.Table, below: pa.Table) -> pa.Table:
    before = {row["arm"]: np.array([[e["p_below"], e["a_below"], e["p_total"]] for e in row["below"]], dtype=np.int64).T for row in below.to_pylist()}
    out = []
    for arm, p, a in _arms(cells):
        p_below, a_below, p_total = before[arm]
        p_upto, a_upto = np.cumsum(p, axis=0) + p_below, np.cumsum(a, axis=0) + a_below
        # A replicate without the windows so far, or without positives, adds nothing.
        step = p / np.maximum(p_total, 1) * (p_upto / np.maximum(a_upto, 1))
        out.append(pa.table({"arm": pa.array([arm] * len(p_total), pa.string()), "replicate": pa.array(np.arange(len(p_total)), pa.int32()), "part": step.sum(axis=0), "p_total": p_total}))
    return pa.concat_tables(out)


def resampled_precision(windows: DataFrame, draws: DataFrame, scores: Sequence[str], label: str = "is_anomaly", range_cells: int = RANGE_CELLS) -> DataFrame:
    """``replicate, arm, pr_auc``: average precision of each score column in every replicate.

    Windows are counted per (arm, score, run) and these cells sorted into ranges
    of scores once, for all replicates: a cell carries the draws of its run as
    one vector, and running sums are vectors too. A first pass adds up each range,
    the sums of the ranges above are laid below them, and a second pass finishes
    each range by itself. Rows are never multiplied by replicates.

    Null scores are left out; undefined ones rank last. ``pr_auc`` is null in
    replicates without positives, and equal scores count together.
    """
    arms = F.array(*[F.struct(F.lit(c).alias("arm"), F.col(c).cast("double").alias("score")) for c in scores])
    cells = settle(
        windows.select("run_id", F.col(label).cast("boolean").alias("label"), F.explode(arms).alias("_s"))
        .filter(F.col("_s.score").isNotNull())
        .groupBy("_s.arm", "_s.score", "run_id")
        .agg(F.count_if("label").alias("p"), F.count("*").alias("a"))
        .withColumn("down", -F.col("score")),
        "cells",
    )
    ranges = max(1, math.ceil(cells.count() / range_cells))
    # Equal scores of an arm fall into one range; written, because ranges are told by a sample.
    ranged = settle(cells.repartitionByRange(ranges, "arm", "down").withColumn("range", F.spark_partition_id()), "ranged")
    repeats = (draws.agg(F.max("replicate")).first()[0] or 0) + 1
    drawn = draws.groupBy("run_id").agg(F.map_from_entries(F.collect_list(F.struct("replicate", "times"))).alias("drawn"))
    times = F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda i: F.coalesce(F.try_element_at("drawn", i), F.lit(0)).cast("short"))
    weighted = ranged.select("range", "arm", "down", "run_id", "p", "a").join(settle(drawn.select("run_id", times.alias("times")), "times"), "run_id").drop("run_id")
    by_range = weighted.groupBy("range")
    totals = settle(by_range.applyInArrow(_range_totals, "range int, arm string, p array<long>, a array<long>"), "totals")
    laid = totals.select("range", "arm", F.posexplode(F.arrays_zip("p", "a")).alias("replicate", "_t")).select("range", "arm", "replicate", "_t.p", "_t.a")
    whole = Window.partitionBy("arm", "replicate")
    above = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = laid.select(
        "range", "arm", "replicate",
        *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_below") for c in ("p", "a")],
        F.sum("p").over(whole).alias("p_total"),
    )
    below = offsets.groupBy("range", "arm").agg(F.sort_array(F.collect_list(F.struct("replicate", "p_below", "a_below", "p_total"))).alias("below"))
    parts = by_range.cogroup(below.groupBy("range")).applyInArrow(_range_precision, "arm string, replicate int, part double, p_total long")
    return parts.groupBy("arm", "replicate").agg(F.when(F.max("p_total") > 0, F.sum("part")).alias("pr_auc"))


def window_metric_intervals(
    windows: DataFrame,
    draws: DataFrame,
    scores: Mapping[str, float],
    label: str = "is_anomaly",
    window_seconds: float = 60.0,
    range_cells: int = RANGE_CELLS,
) -> DataFrame:
    """Intervals of the change in window metrics between two scored arms.

    ``scores`` maps the two score columns to their thresholds. Copies of a run
    count as different runs, so their events are different events too.
    """
    (first, t_first), (second, t_second) = scores.items()
    draws = settle(draws, "draws")
    counts, names = [F.count("*").alias("n"), F.count_if(label).alias("p")], ["n", "p"]
    for tag, column, threshold in (("a", first, t_first), ("b", second, t_second)):
        alert = F.col(column) >= F.lit(float(threshold))
        counts += [
            F.count_if(alert).alias(f"alerts_{tag}"),
            F.count_if(alert & F.col(label)).alias(f"hits_{tag}"),
        ]
        names += [f"alerts_{tag}", f"hits_{tag}"]
    per_run = windows.groupBy("run_id").agg(*counts)
    per_event = windows.filter(named_event()).groupBy("run_id", "event_id").agg(
        F.bool_or(F.col(first) >= F.lit(float(t_first))).alias("a"),
        F.bool_or(F.col(second) >= F.lit(float(t_second))).alias("b"),
    )
    events = per_event.groupBy("run_id").agg(
        F.count("*").alias("events"), F.count_if("a").alias("found_a"), F.count_if("b").alias("found_b")
    )
    names += ["events", "found_a", "found_b"]
    sums = resampled_sums(per_run.join(events, "run_id", "left").na.fill(0, ["events", "found_a", "found_b"]), draws, names)
    zero = F.lit(0.0)

    def precision(tag: str) -> Column:
        return F.coalesce(F.try_divide(f"hits_{tag}", f"alerts_{tag}"), zero)

    days = F.col("n") * F.lit(float(window_seconds) / 86400.0)
    false_a, false_b = (F.col(f"alerts_{t}") - F.col(f"hits_{t}") for t in ("a", "b"))
    deltas = sums.select(
        "replicate",
        (precision("b") - precision("a")).alias("precision"),
        (F.try_divide("found_b", "events") - F.try_divide("found_a", "events")).alias("event_detection_rate"),
        ((false_b - false_a) / days).alias("false_positives_per_asset_day"),
    ).unpivot(["replicate"], ["precision", "event_detection_rate", "false_positives_per_asset_day"], "metric", "delta")
    quality = resampled_precision(windows.withColumns({"a": F.col(first), "b": F.col(second)}), draws, ["a", "b"], label, range_cells)
    by_arm = quality.groupBy("replicate").agg(
        F.max(F.when(F.col("arm") == "a", F.col("pr_auc"))).alias("_a"),
        F.max(F.when(F.col("arm") == "b", F.col("pr_auc"))).alias("_b"),
    )
    results = deltas.unionByName(
        by_arm.select("replicate", F.lit("pr_auc").alias("metric"), (F.col("_b") - F.col("_a")).alias("delta"))
    )
    return interval(results, "delta", ["metric"])
