"""Continuity segments: a run breaks where the label changes or time jumps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.timeline import HOUR_US, floor_div
from millrace.operators.ranks import earlier_blocks

GAP_MS = 2_500


def number_segments(
    df: DataFrame, source: Sequence[str], us: str, label: str, gap_ms: int = GAP_MS, block_us: int = HOUR_US
) -> DataFrame:
    """Add ``segment`` (from 0) per source, and ``segment_rows``.

    A source is cut into time blocks. Breaks are found and counted inside each
    block; the last row and the number of breaks of earlier blocks come from a
    table with one row per block. No task holds more than a block of a source.
    """
    ms = floor_div(us, 1000)
    blocked = df.withColumn("_block", floor_div(us, block_us)).withColumn("_ms", ms)
    order = [us, label]
    inside = Window.partitionBy(*source, "_block").orderBy(*order)
    tail = F.max(F.struct(F.col(us).alias("us"), F.col(label).alias("label"), F.col("_ms").alias("ms")))
    earlier = earlier_blocks(blocked, source, "_block", {"_tail": tail}, F.last)
    joined = blocked.join(earlier, [*source, "_block"])
    prior_ms = F.coalesce(F.lag("_ms").over(inside), F.col("_tail.ms"))
    prior_label = F.coalesce(F.lag(label).over(inside), F.col("_tail.label"))
    breaks = prior_ms.isNotNull() & ((prior_label != F.col(label)) | (F.col("_ms") - prior_ms > gap_ms))
    flagged = joined.withColumn("_break", F.when(breaks, 1).otherwise(0)).drop("_tail")
    # Rows of equal time and label take one number, whichever of them comes first and holds the break.
    running = F.sum("_break").over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    local = flagged.withColumn("_in", running)
    offsets = earlier_blocks(flagged, source, "_block", {"_before": F.sum("_break")})
    numbered = local.join(offsets, [*source, "_block"]).withColumn(
        "segment", (F.col("_in") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint")
    )
    sizes = numbered.groupBy(*source, "segment").agg(F.count("*").alias("segment_rows"))
    return numbered.drop("_block", "_ms", "_break", "_in", "_before").join(sizes, [*source, "segment"])


def usable_segments(segmented: DataFrame, prefix, least_rows: int = 2) -> DataFrame:
    """Drop short segments after numbering and name each remaining one as its own run."""
    name = F.concat(prefix, F.lit("__segment-"), F.format_string("%03d", F.col("segment")))
    return segmented.filter(F.col("segment_rows") >= least_rows).withColumn("run_id", name)
