"""Joins with completeness guarantees."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Whole rows of two relations that a task compares.
TASK_ROWS = 200_000


def restrict(df: DataFrame, grid: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is on the grid."""
    return df.join(grid.select(*keys), list(keys), "left_semi")


def complete_lookup(df: DataFrame, other: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Left join that fails the query where the looked-up column is absent."""
    joined = df.join(other.select(*keys, column), list(keys), "left")
    kind = other.schema[column].dataType
    refused = F.raise_error(F.lit(f"No {column} for a required key")).cast(kind)
    return joined.withColumn(column, F.when(F.col(column).isNull(), refused).otherwise(F.col(column)))


def observed_bounds(rows: DataFrame) -> DataFrame:
    """First and last observation time per asset."""
    return rows.groupBy("run_id", "asset_id").agg(
        F.min("us").alias("first_observation"), F.max("us").alias("watermark")
    )


def with_bounds(windows: DataFrame, rows: DataFrame) -> DataFrame:
    """Attach observation bounds and whether the window closed before the last observation."""
    return windows.join(observed_bounds(rows), ["run_id", "asset_id"]).withColumn(
        "retained", F.col("window_end") <= F.col("watermark")
    )


def truth_for_runs(truths: DataFrame, runs: DataFrame) -> DataFrame:
    """Ground truth of the evaluated runs; a run without truth, or with two, is refused."""
    wanted = runs.select("run_id").distinct()
    chosen = truths.join(wanted, "run_id", "left_semi")
    if not wanted.join(truths.select("run_id"), "run_id", "left_anti").limit(1).isEmpty():
        raise ValueError("Evaluated runs lack ground truth")
    if not chosen.groupBy("run_id").count().filter("count > 1").limit(1).isEmpty():
        raise ValueError("Duplicate ground truth for a run")
    return chosen


def same_rows(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None) -> bool:
    """Whether two relations hold the same rows, copies included."""
    return unmatched_rows(left, right, columns).limit(1).isEmpty()


def unmatched_rows(left: DataFrame, right: DataFrame, columns: Sequence[str] | None = None, rows: int | None = None) -> DataFrame:
    """Rows of one side without a partner on the other. One grouping serves both directions.

    ``rows`` bounds the rows of a side where that is known. They are then dealt
    out ``TASK_ROWS`` to a task; else a task groups what its partition holds.
    """
    names = list(columns or left.columns)
    tagged = left.select(*names, F.lit(1).alias("_side")).unionByName(right.select(*names, F.lit(-1).alias("_side")))
    if rows is not None:
        tagged = tagged.repartition(max(1, math.ceil(2 * rows / TASK_ROWS)), *names)
    return tagged.groupBy(*names).agg(F.sum("_side").alias("surplus")).filter(F.col("surplus") != 0)
