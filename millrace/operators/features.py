"""Window features per channel.

Raw observations are reduced once, to *cells*: one row per asset, pane, tag and
context. Everything that can be merged (counts, sums, extremes, first and last,
regression moments, labels, contexts) is merged from cells to windows, so a
sliding window with fifteen-fold overlap copies cells, not observations. Median
and MAD need the values themselves and read them a second time, by blocks of
neighbouring windows: each value is shuffled at most twice whatever the overlap,
and of large blocks only the values near a window's middle are copied.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.arrays import finite, median_and_deviation
from millrace.functions.timeline import SECOND_US, epoch_us
from millrace.operators.channels import STATISTICS, chosen_statistics, continuous_only, with_channel
from millrace.operators.ranks import cut_position, running_totals
from millrace.operators.windows import (
    WindowPlan,
    blocks_to_windows,
    panes_to_blocks,
    panes_to_windows,
    with_pane,
)
from millrace.session import settle

WINDOW_KEYS = ["run_id", "asset_id", "window_start"]
CONTEXTS = ("asset_class", "operating_regime")
# Values of one block and channel up to which they are sorted inside one task.
BLOCK_VALUES = 200_000
# Cells above which windows meet the bounds of their asset by hash; sorting whole windows takes far more memory than the bounds.
SORTED_CELLS = 2_000_000


def usable_value(df: DataFrame) -> Column:
    """The value where it may enter statistics: finite and not of bad quality, else null."""
    value = F.col("value").cast("double")
    ok = finite(value)
    if "quality" in df.columns:
        ok = ok & (F.col("quality").isNull() | (F.col("quality") != "bad"))
    return F.when(ok, value)


def readings(df: DataFrame) -> DataFrame:
    """Continuous observations with ``channel``, ``us`` and the usable value ``u``."""
    out = with_channel(continuous_only(df))
    return out.withColumn("us", epoch_us("timestamp")).withColumn("u", usable_value(out))


def pane_cells(rows: DataFrame, plan: WindowPlan) -> DataFrame:
    """Reduce readings to mergeable moments; all buffers are fixed-width, so Spark hashes without sorting."""
    present = set(rows.columns)
    contexts = [c for c in CONTEXTS if c in present]
    labels = ["event_id"] if "event_id" in present else []
    keys = ["run_id", "asset_id", "pane", "channel", "signal_class", "tag_id", *contexts, *labels]
    paned = with_pane(rows, plan)
    u = F.col("u")
    # Seconds since the start of the pane, only where the value is usable.
    t = F.when(u.isNotNull(), (F.col("us") - F.col("pane") * plan.pane_us) / F.lit(float(SECOND_US)))
    usable_us = F.when(u.isNotNull(), F.col("us"))
    quality = F.col("quality") if "quality" in present else F.lit("good")
    one = F.lit(1.0)
    aggregates = [
        F.count("*").alias("n"),
        F.count(F.when(quality == "good", 1)).alias("n_good"),
        F.count(F.when(quality.isNull() | (quality == "uncertain"), 1)).alias("n_uncertain"),
        F.count(F.when(quality == "bad", 1)).alias("n_bad"),
        F.min("us").alias("low_us"),
        F.max("us").alias("high_us"),
        F.count(u).alias("nu"),
        F.sum(u).alias("su"),
        F.min(u).alias("min_u"),
        F.max(u).alias("max_u"),
        F.avg(t).alias("t_mean"),
        F.regr_syy(u, t).alias("m_uu"),
        F.regr_sxx(u, t).alias("m_tt"),
        F.regr_sxy(u, t).alias("m_tu"),
        F.min(usable_us).alias("first_us"),
        F.max(usable_us).alias("last_us"),
        F.min_by(u, usable_us).alias("first_u"),
        F.max_by(u, usable_us).alias("last_u"),
    ]
    if "sampling_interval_ms" in present:
        aggregates.append(F.min_by(F.col("sampling_interval_ms").cast("double"), F.col("us")).alias("interval_ms"))
    if "is_anomaly" in present:
        aggregates.append(F.max(F.when(F.col("is_anomaly"), one).otherwise(0.0)).alias("anomaly"))
    if "event_id" in present:
        start = F.col("event_start_us").cast("bigint") if "event_start_us" in present else F.lit(None).cast("bigint")
        aggregates.append(F.min(start).alias("event_start_us"))
    return paned.groupBy(*keys).agg(*aggregates)


def _merge_channels(cells: DataFrame, plan: WindowPlan) -> DataFrame:
    """Cells copied to windows, merged per (window, channel)."""
    present = set(cells.columns)
    shift = (F.col("pane") * plan.pane_us - F.col("window_start")) / F.lit(float(SECOND_US))
    keys = [*WINDOW_KEYS, "channel"]
    group = Window.partitionBy(*keys)
    copied = panes_to_windows(cells, plan).withColumn("t_at", F.col("t_mean") + shift)
    total = F.sum("nu").over(group)
    centred = copied.withColumn("_u", F.try_divide(F.sum("su").over(group), total)).withColumn(
        "_t", F.try_divide(F.sum(F.col("nu") * F.col("t_at")).over(group), total)
    )
    dt = F.col("t_at") - F.col("_t")
    du = F.try_divide(F.col("su"), F.col("nu")) - F.col("_u")
    tie = (F.col("signal_class"), F.col("tag_id"))
    first = F.struct(F.col("first_us"), *tie, F.col("first_u").alias("u"))
    last = F.struct(F.col("last_us"), *tie, F.col("last_u").alias("u"))
    used = F.col("nu") > 0
    aggregates = [
        *[F.sum(c).alias(c) for c in ("n", "n_good", "n_uncertain", "n_bad", "nu")],
        F.first("_u").alias("mean"),
        F.min("min_u").alias("min"),
        F.max("max_u").alias("max"),
        F.sum(F.when(used, F.col("m_uu") + F.col("nu") * du * du)).alias("m_uu"),
        F.sum(F.when(used, F.col("m_tt") + F.col("nu") * dt * dt)).alias("m_tt"),
        F.sum(F.when(used, F.col("m_tu") + F.col("nu") * dt * du)).alias("m_tu"),
        F.min(F.when(used, F.col("first_us"))).alias("first_us"),
        F.max(F.when(used, F.col("last_us"))).alias("last_us"),
        F.min(F.when(used, first)).alias("first"),
        F.max(F.when(used, last)).alias("last"),
    ]
    if "interval_ms" in present:
        opening = F.struct(F.col("low_us"), *tie, F.col("interval_ms"))
        aggregates.append(F.min(opening).alias("opening"))
    for context in CONTEXTS:
        if context in present:
            aggregates += [F.min(context).alias(f"{context}_a"), F.max(context).alias(f"{context}_z")]
    if "anomaly" in present:
        aggregates.append(F.max("anomaly").alias("anomaly"))
    return centred.groupBy(*keys).agg(*aggregates)


def _statistic_columns(
    plan: WindowPlan, has_interval_column: bool, default_interval: Column, with_order_statistics: bool
) -> dict[str, Column]:
    """The seventeen statistics of a channel that has at least one row in the window."""
    n = F.col("n").cast("double")
    zero = F.lit(0.0)
    interval = F.col("opening.interval_ms") if has_interval_column else default_interval
    expected = F.when(interval > 0, F.lit(float(plan.size_us)) / (interval * F.lit(1000.0))).otherwise(n)
    sloped = (F.col("nu") > 1) & (F.col("last_us") > F.col("first_us"))
    median = F.coalesce(F.col("median"), zero) if with_order_statistics else zero
    mad = F.coalesce(F.col("mad"), zero) if with_order_statistics else zero
    return {
        "mean": F.coalesce(F.col("mean"), zero),
        "median": median,
        "min": F.coalesce(F.col("min"), zero),
        "max": F.coalesce(F.col("max"), zero),
        "range": F.coalesce(F.col("max") - F.col("min"), zero),
        "std": F.coalesce(F.sqrt(F.greatest(F.try_divide(F.col("m_uu"), F.col("nu")), zero)), zero),
        "mad": mad,
        "last": F.coalesce(F.col("last.u"), zero),
        "delta": F.coalesce(F.col("last.u") - F.col("first.u"), zero),
        "slope": F.when(sloped, F.coalesce(F.try_divide(F.col("m_tu"), F.col("m_tt")), zero)).otherwise(zero),
        "sample_count": n,
        "expected_sample_count": expected,
        "coverage_ratio": F.least(n / expected, F.lit(1.0)),
        "good_ratio": F.col("n_good") / n,
        "uncertain_ratio": F.col("n_uncertain") / n,
        "bad_ratio": F.col("n_bad") / n,
        "missing": zero,
    }


def _silent_columns(plan: WindowPlan, default_interval: Column) -> dict[str, Column]:
    """The seventeen statistics of a channel without rows in the window."""
    expected = F.when(
        default_interval > 0, F.lit(float(plan.size_us)) / (default_interval * F.lit(1000.0))
    ).otherwise(F.lit(0.0))
    known = {"bad_ratio": F.lit(1.0), "missing": F.lit(1.0), "expected_sample_count": expected}
    return {name: known.get(name, F.lit(0.0)) for name in STATISTICS}


def hot_blocks(cells: DataFrame, plan: WindowPlan, limit: int) -> DataFrame:
    """Blocks with more usable values of one channel than a task should sort in memory."""
    return (
        panes_to_blocks(cells.select("run_id", "asset_id", "pane", "channel", "nu"), plan)
        .groupBy("run_id", "asset_id", "block", "channel")
        .agg(F.sum("nu").alias("_values"))
        .filter(F.col("_values") > limit)
        .drop("_values")
    )


def order_statistics(rows: DataFrame, cells: DataFrame, plan: WindowPlan, limit: int = BLOCK_VALUES) -> DataFrame:
    """Exact median and MAD per (window, channel).

    Blocks within ``limit`` are sorted as arrays inside tasks. Larger ones, found
    from the cell counts, are selected from by value bins instead.
    """
    keys = [*WINDOW_KEYS, "channel"]
    values = with_pane(rows.filter(F.col("u").isNotNull()), plan).select("run_id", "asset_id", "pane", "channel", "u")
    blocked = panes_to_blocks(values, plan)
    hot = settle(hot_blocks(cells, plan, limit), "hot-blocks")
    hot_exists = not hot.isEmpty()
    cool = blocked.join(hot, BLOCK_KEYS, "left_anti") if hot_exists else blocked
    # Hashing by block keeps all copies of a window in one partition; the expansion follows the shuffle.
    placed = blocks_to_windows(cool.repartition(*BLOCK_KEYS), plan)
    gathered = placed.groupBy(*BLOCK_KEYS, "window_start").agg(F.collect_list("u").alias("_values"))
    small = gathered.select(*keys, median_and_deviation(F.col("_values")).alias("_m")).select(*keys, "_m.*")
    if not hot_exists:
        return small
    return small.unionByName(selected_order_statistics(blocked.join(hot, BLOCK_KEYS, "left_semi"), plan))


BLOCK_KEYS = ["run_id", "asset_id", "block", "channel"]
# Value bins of a large block.
BLOCK_BINS = 512


def selected_order_statistics(values: DataFrame, plan: WindowPlan, bins: int = BLOCK_BINS) -> DataFrame:
    """Exact median and MAD per (window, channel) from rows (block keys, pane, ``u``), by selection.

    Values are cut into bins of about equal weight per block, and only counts by
    pane and bin are copied to windows. They tell which bins hold a window's
    middle; the values of those bins alone are copied, after equal ones of a
    pane became one row. Deviations from the median take the same way: a bin's
    least and largest value bound its deviations.
    """
    keys = [*WINDOW_KEYS, "channel"]
    hot = settle(values.select(*BLOCK_KEYS, "pane", "u"), "hot-values")
    edges = hot.groupBy(*BLOCK_KEYS).agg(F.array_distinct(F.percentile_approx("u", [k / bins for k in range(1, bins)], 100 * bins)).alias("_edges"))
    binned = settle(hot.join(edges, BLOCK_KEYS).withColumn("bin", cut_position(F.col("_edges"), F.col("u"))).drop("_edges"), "hot-bins")
    cells = binned.groupBy(*BLOCK_KEYS, "pane", "bin").agg(F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high"))
    of_windows = blocks_to_windows(cells, plan).groupBy(*keys, "block", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    total = F.sum("n").over(Window.partitionBy(*keys))
    bin_counts = settle(
        of_windows.withColumn("_total", total).withColumn("_first", F.floor((F.col("_total") - 1) / 2)).withColumn("_second", F.floor(F.col("_total") / 2)),
        "window-bins",
    )
    first, second = F.col("_first"), F.col("_second")

    def picked(needed: DataFrame, value: Column, name: str) -> DataFrame:
        """The mean of the two middle values, from rows (keys, block, bin, _below, ...) of the bins that hold them."""
        inside = binned.join(needed.select(*BLOCK_KEYS, "bin").distinct(), [*BLOCK_KEYS, "bin"], "left_semi")
        merged = inside.groupBy(*BLOCK_KEYS, "pane", "bin", "u").agg(F.count("*").alias("n"))
        copied = blocks_to_windows(merged, plan).join(needed.drop("n"), [*keys, "block", "bin"]).withColumn("_value", value)
        order = running_totals(copied, keys, "_value", {"n": F.col("n")}).select(*keys, "_value", "n_upto")
        ranks = needed.select(*keys, "_below", "_first", "_second").distinct()
        reached = F.col("n_upto") + F.col("_below")
        low, high = (F.min(F.when(reached > at, F.col("_value"))) for at in (first, second))
        return order.join(ranks, keys).groupBy(*keys).agg(((low + high) / F.lit(2.0)).alias(name))

    upto = F.sum("n").over(Window.partitionBy(*keys).orderBy("bin"))
    middle = bin_counts.withColumn("_upto", upto).where((F.col("_upto") > first) & (F.col("_upto") - F.col("n") <= second))
    least = F.min(F.col("_upto") - F.col("n")).over(Window.partitionBy(*keys))
    medians = settle(picked(settle(middle.withColumn("_below", least).drop("_upto", "low", "high"), "middle-bins"), F.col("u"), "median"), "hot-medians")

    m = F.col("median")
    one, other = F.abs(F.col("low") - m), F.abs(F.col("high") - m)
    nearest = F.when((F.col("low") <= m) & (F.col("high") >= m), F.lit(0.0)).otherwise(F.least(one, other))
    apart = bin_counts.join(medians, keys).withColumn("_near", nearest).withColumn("_far", F.greatest(one, other))
    by_far, by_near = (F.sum("n").over(Window.partitionBy(*keys).orderBy(c)) for c in ("_far", "_near"))
    ordered = apart.withColumn("_by_far", by_far).withColumn("_by_near", by_near)
    whole = Window.partitionBy(*keys)
    # No deviation before the first middle one is in a bin that starts above ``_least``, none up to the second beyond ``_most``.
    bounded = ordered.withColumn("_least", F.min(F.when(F.col("_by_near") > first, F.col("_near"))).over(whole)).withColumn(
        "_most", F.min(F.when(F.col("_by_far") > second, F.col("_far"))).over(whole)
    )
    below = F.coalesce(F.sum(F.when(F.col("_far") < F.col("_least"), F.col("n"))).over(whole), F.lit(0))
    held = bounded.withColumn("_below", below).where((F.col("_far") >= F.col("_least")) & (F.col("_near") <= F.col("_most")))
    deviating = settle(held.select(*keys, "block", "bin", "_below", "_first", "_second", "median"), "deviation-bins")
    mads = picked(deviating, F.abs(F.col("u") - m), "mad")
    return medians.join(mads, keys)


def asset_bounds(cells: DataFrame) -> DataFrame:
    """First and last observation per asset, with what is constant over the whole asset.

    One distinct non-null value means that minimum and maximum agree, so no value
    set is collected.
    """
    present = set(cells.columns)
    aggregates = [F.min("low_us").alias("low_us"), F.max("high_us").alias("high_us")]
    for context in CONTEXTS:
        if context in present:
            aggregates.append(
                F.when(F.min(context) == F.max(context), F.min(context)).alias(f"{context}_constant")
            )
    if "event_id" in present:
        named = F.when(F.col("event_id") != "", F.col("event_id"))
        only = (F.min(named) == F.max(named)) & (F.count(F.when(F.col("event_id").isNull(), 1)) == 0)
        in_event = named.isNotNull()
        aggregates += [
            F.when(only, F.min(named)).alias("event_constant"),
            F.coalesce(
                F.min(F.when(in_event, F.col("event_start_us"))), F.min(F.when(in_event, F.col("low_us")))
            ).alias("event_constant_us"),
        ]
    return cells.groupBy("run_id", "asset_id").agg(*aggregates)


def window_events(cells: DataFrame, plan: WindowPlan) -> DataFrame:
    """Event and onset per window. Of several events, the one that starts first wins, then the smaller id."""
    marked = cells.filter(F.col("event_id") != "")
    per_event = (
        panes_to_windows(marked, plan)
        .groupBy(*WINDOW_KEYS, "event_id")
        .agg(F.coalesce(F.min("event_start_us"), F.min("low_us")).alias("event_start_us"))
    )
    first = F.min(F.struct("event_start_us", "event_id")).alias("_event")
    return per_event.groupBy(*WINDOW_KEYS).agg(first)


def window_features(
    df: DataFrame,
    plan: WindowPlan,
    channels: Sequence[str] | None = None,
    default_intervals: Mapping[str, float] | None = None,
    families: Mapping[str, bool] | None = None,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """One row per emitted window with ``stats``: channel -> struct of statistics.

    ``channels`` are the trained channels: others are refused, and silent ones get
    their no-data statistics. Without it the channels of the data are used.
    """
    wanted = chosen_statistics(dict(families or {}))
    rows = readings(df)
    cells = settle(pane_cells(rows, plan), "cells")
    seen = sorted(r[0] for r in cells.select("channel").distinct().collect())
    if not seen:
        raise ValueError("No continuous measurement channels to build windows from")
    if channels is not None:
        foreign = sorted(set(seen) - set(channels))
        if foreign:
            raise ValueError(f"Untrained measurement channels: {foreign}")
    names = list(channels) if channels is not None else seen
    present = set(cells.columns)
    intervals = {c: float(v) for c, v in (default_intervals or {}).items() if v is not None}
    interval_of = (
        F.create_map(*[F.lit(x) for pair in intervals.items() for x in pair])
        if intervals
        else F.lit(None).cast("map<string,double>")
    )

    def default_interval(channel: Column) -> Column:
        return F.try_element_at(interval_of, channel)

    per_channel = _merge_channels(cells, plan)
    needs_order = "median" in wanted or "mad" in wanted
    if needs_order:
        per_channel = per_channel.join(order_statistics(rows, cells, plan, block_values), [*WINDOW_KEYS, "channel"], "left")
    built = _statistic_columns(plan, "interval_ms" in present, default_interval(F.col("channel")), needs_order)
    struct = F.struct(*[built[s].alias(s) for s in wanted])
    carried = [c for c in per_channel.columns if c[-2:] in ("_a", "_z") or c == "anomaly"]
    folded = [
        F.map_from_entries(F.collect_list(F.struct(F.col("channel"), F.col("_stats")))).alias("_seen"),
        *[(F.min if c.endswith("_a") else F.max)(c).alias(c) for c in carried],
    ]
    windows = per_channel.select(*WINDOW_KEYS, "channel", struct.alias("_stats"), *carried).groupBy(*WINDOW_KEYS).agg(*folded)
    bounds = asset_bounds(cells)
    if cells.count() > SORTED_CELLS:
        bounds = bounds.hint("shuffle_hash")
    windows = windows.join(bounds, ["run_id", "asset_id"]).filter(
        plan.allowed_start(F.col("window_start"), F.col("low_us"), F.col("high_us"))
    )
    if "event_id" in present:
        windows = windows.join(window_events(cells, plan), WINDOW_KEYS, "left")

    out = [F.col("run_id"), F.col("asset_id"), F.col("window_start"), (F.col("window_start") + plan.size_us).alias("window_end")]
    for context in CONTEXTS:
        if context in present:
            a, z = F.col(f"{context}_a"), F.col(f"{context}_z")
            local = F.when(a.isNull(), F.lit("unknown")).when(a == z, a).otherwise(F.lit("mixed"))
            out.append(F.coalesce(F.col(f"{context}_constant"), local).alias(context))
    if "is_anomaly" in df.columns:
        out.append((F.col("anomaly") > 0).alias("is_anomaly"))
    if "event_id" in present:
        out += [
            F.coalesce("event_constant", "_event.event_id").alias("event_id"),
            F.when(F.col("event_constant").isNotNull(), F.col("event_constant_us"))
            .otherwise(F.col("_event.event_start_us"))
            .alias("event_start_us"),
        ]
    listed = F.array(*[F.lit(c) for c in names])
    kind = f"struct<{','.join(f'`{s}`:double' for s in wanted)}>"

    def filled(channel: Column) -> Column:
        silent = _silent_columns(plan, default_interval(channel))
        empty = F.struct(*[silent[s].alias(s) for s in wanted]).cast(kind)
        return F.coalesce(F.try_element_at(F.col("_seen"), channel).cast(kind), empty)

    out.append(F.map_from_arrays(listed, F.transform(listed, filled)).alias("stats"))
    return windows.select(*out)


def stats_fields(features: DataFrame) -> list[str]:
    return [f.name for f in features.schema["stats"].dataType.valueType.fields]


def identity_columns(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c != "stats"]


def wide(features: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One column ``{channel}_{statistic}`` per feature."""
    fields = stats_fields(features)
    columns = [
        F.element_at("stats", F.lit(c))[s].alias(f"{c}_{s}") for c in channels for s in fields
    ]
    return features.select(*identity_columns(features), *columns)


def long(features: DataFrame) -> DataFrame:
    """One row per (window, channel), statistics as columns."""
    keep = identity_columns(features)
    return features.select(*keep, F.explode("stats").alias("channel", "_s")).select(*keep, "channel", "_s.*")


def contains_anomaly(features: DataFrame) -> bool:
    """Whether any window is labelled anomalous; training partitions must have none."""
    return not features.filter(F.col("is_anomaly")).limit(1).isEmpty()
