"""Exact ordered totals and quantiles that never put a whole group into one task.

A plain ``sum().over(partitionBy(key).orderBy(value))`` sorts each key in one
task, and an exact ``percentile`` holds each key's values in memory. Both break
when one key has a third of all rows. Here large keys are cut into value ranges
first; each range is ordered on its own and then shifted by the total of the
ranges below it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.session import settle

RANGE_ROWS = 200_000
MAX_CUTS = 1024
_STRIDE = 32


def cut_position(cuts: Column, value: Column) -> Column:
    """Number of cuts below the value: a coarse pass over every 32nd cut, then a fine one."""
    coarse = F.size(F.filter(F.filter(cuts, lambda c, i: i % _STRIDE == 0), lambda c: c < value))
    start = F.greatest((coarse - 1) * _STRIDE, F.lit(0))
    fine = F.size(F.filter(F.slice(cuts, start + 1, F.lit(_STRIDE)), lambda c: c < value))
    return F.when(coarse == 0, F.lit(0)).otherwise(start + fine)


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    weights: Mapping[str, Column],
    range_rows: int = RANGE_ROWS,
    max_cuts: int = MAX_CUTS,
) -> DataFrame:
    """Ascending inclusive running sums per key, one row per distinct ``order`` value.

    For every weight ``w`` the result has ``w`` (its sum at that value), ``w_upto``
    (sum up to and including it) and ``w_total`` (sum over the key). Keys and
    order values must not be null. The cuts are a function of the values alone,
    so a recomputed task sees the same ranges.
    """
    names = list(weights)
    by = list(keys) or ["_all"]
    source = df if keys else df.withColumn("_all", F.lit(0))
    # Written once: the steps below read it several times, and its largest key decides between them.
    points = settle(
        source.groupBy(*by, order).agg(*[F.sum(expr).alias(name) for name, expr in weights.items()]).dropna(subset=names),
        "points",
    )
    sizes = points.groupBy(*by).agg(F.count("*").alias("_points"))
    largest = sizes.agg(F.max("_points")).first()[0]
    if largest is None or largest <= range_rows:
        whole = Window.partitionBy(*by)
        upto = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return points.select(
            *keys,
            order,
            *names,
            *[F.sum(n).over(upto).alias(f"{n}_upto") for n in names],
            *[F.sum(n).over(whole).alias(f"{n}_total") for n in names],
        )
    large = sizes.filter(F.col("_points") > range_rows).withColumn(
        "_every", F.ceil(F.col("_points") / F.least(F.lit(max_cuts), F.ceil(F.col("_points") / F.lit(range_rows))))
    )
    cuts = (
        points.select(*by, order)
        .join(large, by)
        .filter(F.pmod(F.xxhash64(order), F.col("_every")) == 0)
        .groupBy(*by)
        .agg(F.sort_array(F.collect_list(order)).alias("_cuts"))
    )
    placed = (
        points.join(cuts, by, "left")
        .withColumn("_range", F.coalesce(cut_position(F.col("_cuts"), F.col(order)), F.lit(0)))
        .drop("_cuts")
    )
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    ordered = placed.select("*", *[F.sum(n).over(inside).alias(f"_{n}_in") for n in names])
    over_ranges = Window.partitionBy(*by)
    below = over_ranges.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        placed.groupBy(*by, "_range")
        .agg(*[F.sum(n).alias(n) for n in names])
        .select(
            *by,
            "_range",
            *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"_{n}_below") for n in names],
            *[F.sum(n).over(over_ranges).alias(f"{n}_total") for n in names],
        )
    )
    joined = ordered.join(ranges, [*by, "_range"])
    return joined.select(
        *keys,
        order,
        *names,
        *[(F.col(f"_{n}_in") + F.col(f"_{n}_below")).alias(f"{n}_upto") for n in names],
        *[F.col(f"{n}_total") for n in names],
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    names: Sequence[str],
    method: str = "linear",
    weight: Column | None = None,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """Exact quantiles per key, as one column per probability, plus ``n``.

    ``linear`` interpolates between order statistics; ``higher`` takes the order
    statistic at the rounded-up position.
    """
    if method not in ("linear", "higher"):
        raise ValueError("method must be linear or higher")
    source = df.filter(F.col(value).isNotNull())
    positions = running_totals(
        source, keys, value, {"n": (weight if weight is not None else F.lit(1)).cast("bigint")}, range_rows
    )
    aggregates = [F.max("n_total").alias("n")]
    for p, name in zip(probabilities, names):
        at = F.lit(float(p)) * (F.col("n_total") - 1)
        aggregates.append(F.min(F.when(F.col("n_upto") > F.ceil(at), F.col(value))).alias(f"_{name}_hi"))
        if method == "linear":
            aggregates.append(F.min(F.when(F.col("n_upto") > F.floor(at), F.col(value))).alias(f"_{name}_lo"))
    reached = positions.groupBy(*keys).agg(*aggregates)
    columns = []
    for p, name in zip(probabilities, names):
        high = F.col(f"_{name}_hi")
        if method == "linear":
            at = F.lit(float(p)) * (F.col("n") - 1)
            low = F.col(f"_{name}_lo")
            high = low + (high - low) * (at - F.floor(at))
        columns.append(high.alias(name))
    return reached.select(*keys, "n", *columns)


def earlier_blocks(
    df: DataFrame, keys: Sequence[str], block: str, totals: Mapping[str, Column], combine=F.sum
) -> DataFrame:
    """Per (key, block): each total combined over all earlier blocks of the key (null for the first).

    The window runs over one row per block, not over the rows themselves.
    """
    per_block = df.groupBy(*keys, block).agg(*[expr.alias(name) for name, expr in totals.items()])
    before = Window.partitionBy(*keys).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(*keys, block, *[combine(name).over(before).alias(name) for name in totals])
