"""Deterministic selections of runs and source instances."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranks import running_totals


def evenly_spread(df: DataFrame, keys: Sequence[str], order: str, limit: int) -> DataFrame:
    """At most ``limit`` names per key, spread evenly over their sorted order.

    Position i of k maps to ``round(i * (n - 1) / (k - 1))``, halves to even; a
    single pick is the middle one.
    """
    ranked = running_totals(df.select(*keys, order).distinct(), keys, order, {"n": F.lit(1)})
    position, total = F.col("n_upto") - 1, F.col("n_total")
    if limit == 1:
        keep = position == F.floor(total / F.lit(2))
    else:
        gaps = F.lit(float(limit - 1))
        # Only the pick just below and the one just above a position can round to it.
        i = position * gaps / F.nullif(total - 1, F.lit(0))
        hits = [F.bround(near * (total - 1) / gaps) == position for near in (F.floor(i), F.ceil(i))]
        keep = hits[0] | hits[1]
    return ranked.filter(F.when(total <= limit, F.lit(True)).otherwise(keep)).select(*keys, order)


def smallest_per_group(df: DataFrame, keys: Sequence[str], size: str, name: str) -> DataFrame:
    """The smallest item of each group, ties by name."""
    best = F.min(F.struct(F.col(size), F.col(name))).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, F.col(f"_best.{name}").alias(name), F.col(f"_best.{size}").alias(size))


# Wells and label codes of the unseen-well split.
TRAIN_WELLS = (1, 2, 4, 5)
VALIDATION_WELLS = (6, 7, 8)
TEST_NORMAL_WELL = 19
TEST_WELLS = (19, *range(21, 33))
CHALLENGE_WELLS = (14, 16, 20, 37, 40, 41, 42)
EVENT_CODES = tuple(range(1, 9))
CHALLENGE_CODE = 9
CHALLENGE_LABELS = (9, 109)
NORMAL_FILES_PER_WELL = 12


def unseen_well_instances(first: DataFrame, second: DataFrame, second_labels: DataFrame) -> DataFrame:
    """Instances per partition, from two releases of a well archive.

    ``first`` and ``second`` hold ``path, code, well`` (``second`` also ``size``);
    ``second_labels`` holds ``path, label`` as found inside the files.
    """

    def pick(rows: DataFrame, partition: str) -> DataFrame:
        return rows.select(F.lit(partition).alias("partition"), "path")

    normal = first.filter(F.col("code") == 0)
    train = evenly_spread(normal.filter(F.col("well").isin(*TRAIN_WELLS)), ["well"], "path", NORMAL_FILES_PER_WELL)
    calm = evenly_spread(normal.filter(F.col("well").isin(*VALIDATION_WELLS)), ["well"], "path", NORMAL_FILES_PER_WELL)
    events = first.filter(F.col("well").isin(*VALIDATION_WELLS) & F.col("code").isin(*EVENT_CODES))
    quiet = evenly_spread(second.filter((F.col("code") == 0) & (F.col("well") == TEST_NORMAL_WELL)), ["well"], "path", 1)
    eventful = evenly_spread(
        second.filter(F.col("code").isin(*EVENT_CODES) & F.col("well").isin(*TEST_WELLS)), ["well"], "path", 1
    )
    confirmed = second.filter((F.col("code") == CHALLENGE_CODE) & F.col("well").isin(*CHALLENGE_WELLS)).join(
        second_labels.filter(F.col("label").isin(*CHALLENGE_LABELS)), "path", "left_semi"
    )
    challenge = smallest_per_group(confirmed, ["well"], "size", "path")
    parts = [
        pick(train, "train"), pick(calm, "validation"), pick(events, "validation"),
        pick(quiet, "test"), pick(eventful, "test"), pick(challenge, "challenge"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


# Folds of the published fold file per partition.
FOLD_PARTITIONS = {"train": (0, 1), "validation": (2,), "test": (4,)}


def split_by_folds(folds: DataFrame, inventory: DataFrame, partitions: Mapping[str, Sequence[int]] = FOLD_PARTITIONS) -> DataFrame:
    """Assign fold entries to partitions and say what became of each.

    ``folds`` holds ``entry, path, fold`` (``entry`` is the line number),
    ``inventory`` holds ``path``. Training keeps normal instances only. The
    ``state`` is selected, duplicate, or missing.
    """
    partition: Column = F.lit(None).cast("string")
    for name, members in partitions.items():
        partition = F.when(F.col("fold").isin(*members), F.lit(name)).otherwise(partition)
    placed = folds.withColumn("partition", partition).filter(F.col("partition").isNotNull())
    placed = placed.filter((F.col("partition") != "train") | F.col("path").startswith("0/"))
    first = placed.groupBy("partition", "path").agg(F.min("entry").alias("_first"))
    known = inventory.select("path").distinct().withColumn("_known", F.lit(True))
    joined = placed.join(first, ["partition", "path"]).join(known, "path", "left")
    state = (
        F.when(F.col("entry") > F.col("_first"), F.lit("duplicate"))
        .when(F.col("_known").isNull(), F.lit("missing"))
        .otherwise(F.lit("selected"))
    )
    return joined.select("partition", "path", "fold", "entry", state.alias("state"))


def bounded_runs(runs: DataFrame, limits: Mapping[str, int | None]) -> DataFrame:
    """Choose runs per partition from ``partition, run_id, has_events``.

    Train takes event-free runs only. A limited validation keeps at least one run
    with and one without events when there are both and the limit allows two.
    """
    rank = running_totals(
        runs.filter((F.col("partition") != "train") | ~F.col("has_events")).withColumn("_key", F.struct("run_id", "has_events")),
        ["partition"],
        "_key",
        {"n": F.lit(1), "calm": F.when(F.col("has_events"), 0).otherwise(1)},
    ).select(
        "partition",
        F.col("_key.run_id").alias("run_id"),
        F.col("_key.has_events").alias("has_events"),
        F.col("n_upto").alias("place"),
        F.when(F.col("_key.has_events"), F.col("n_upto") - F.col("calm_upto")).otherwise(F.col("calm_upto")).alias("place_in_kind"),
        F.col("n_total").alias("total"),
        F.col("calm_total").alias("calm_total"),
    )
    limit: Column = F.lit(None).cast("bigint")
    for name, count in limits.items():
        if count is not None:
            limit = F.when(F.col("partition") == name, F.lit(int(count))).otherwise(limit)
    limited = rank.withColumn("_limit", limit)
    kinds = limited.filter(F.col("place") <= F.col("_limit")).groupBy("partition").agg(
        F.count_if(~F.col("has_events")).alias("_calm"), F.count_if("has_events").alias("_eventful")
    )
    both = (F.col("calm_total") > 0) & (F.col("calm_total") < F.col("total"))
    swaps = (F.col("partition") == "validation") & (F.col("_limit") >= 2) & both
    lacks_calm = swaps & (F.col("_calm") == 0)
    lacks_events = swaps & (F.col("_eventful") == 0)
    within = F.col("place") <= F.col("_limit")
    displaced = (lacks_calm | lacks_events) & (F.col("place") == F.col("_limit"))
    admitted = (F.col("place_in_kind") == 1) & ((lacks_calm & ~F.col("has_events")) | (lacks_events & F.col("has_events")))
    joined = limited.join(kinds, "partition", "left")
    keep = F.when(F.col("_limit").isNull(), F.lit(True)).otherwise((within & ~F.coalesce(displaced, F.lit(False))) | F.coalesce(admitted, F.lit(False)))
    return joined.filter(keep).select("partition", "run_id", "has_events")


def overlapping_keys(left: DataFrame, right: DataFrame, column: str) -> DataFrame:
    """Values of a key present on both sides: leakage when the sides are partitions."""
    return left.select(column).filter(F.col(column).isNotNull()).intersect(right.select(column))


def leakage(df: DataFrame, column: str, partition: str = "partition") -> DataFrame:
    """Keys that occur in more than one partition, with the partitions."""
    pairs = df.filter(F.col(column).isNotNull()).select(column, partition).distinct()
    return (
        pairs.groupBy(column)
        .agg(F.count("*").alias("partitions"), F.min(partition).alias("first"), F.max(partition).alias("last"))
        .filter(F.col("partitions") > 1)
    )


def refuse_leakage(left: DataFrame, right: DataFrame, column: str) -> None:
    shared = [r[0] for r in overlapping_keys(left, right, column).limit(5).collect()]
    if shared:
        raise ValueError(f"Leakage: {column} shared between partitions: {sorted(map(str, shared))}")
