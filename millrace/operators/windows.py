"""Epoch-aligned windows, the panes they are made of, and blocks of neighbouring windows."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.timeline import duration_us, floor_div, floor_to

TAILS = ("legacy", "complete")


@dataclass(frozen=True)
class WindowPlan:
    """Half-open windows ``[k * stride, k * stride + size)`` in epoch microseconds."""

    size_us: int
    stride_us: int
    tail: str = "legacy"

    def __post_init__(self) -> None:
        if self.size_us < 1 or self.stride_us < 1:
            raise ValueError("A window of less than a microsecond, in size or stride, is none")
        if self.tail not in TAILS:
            raise ValueError(f"tail must be one of {TAILS}")

    @classmethod
    def of(cls, size: str = "15m", stride: str = "1m", tail: str = "legacy", marker: int = 2) -> WindowPlan:
        return cls(duration_us(size, marker), duration_us(stride, marker), tail)

    @property
    def pane_us(self) -> int:
        """Width of the widest segments that no window boundary crosses."""
        return math.gcd(self.size_us, self.stride_us)

    @property
    def block_windows(self) -> int:
        """Windows per block: an observation then belongs to at most two blocks."""
        return max(1, -(-self.size_us // self.stride_us))

    @property
    def overlapping(self) -> bool:
        return self.size_us > self.stride_us

    def first_window(self, pane: Column) -> Column:
        """Index of the first window holding a pane."""
        return floor_div((pane + 1) * self.pane_us - self.size_us + self.stride_us - 1, self.stride_us)

    def last_window(self, pane: Column) -> Column:
        """Index of the last window holding a pane."""
        return floor_div(pane * self.pane_us, self.stride_us)

    def allowed_start(self, start: Column, low_us: Column, high_us: Column) -> Column:
        """Whether a window may be emitted, given the first and last observation of its asset."""
        slack = self.stride_us if self.tail == "legacy" else 0
        return (start >= floor_to(low_us, self.stride_us)) & (start <= high_us - self.size_us + slack)


def with_pane(df: DataFrame, plan: WindowPlan, us: str = "us") -> DataFrame:
    return df.withColumn("pane", floor_div(us, plan.pane_us))


def span(low: Column, high: Column) -> Column:
    """Integers low..high, or an empty array; a bare ``sequence`` would count downwards."""
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def panes_to_windows(df: DataFrame, plan: WindowPlan) -> DataFrame:
    """Copy rows carrying ``pane`` to every window holding that pane, as ``window_start``."""
    pane = F.col("pane")
    if plan.size_us == plan.stride_us:
        return df.withColumn("window_start", pane * plan.pane_us)
    indexes = span(plan.first_window(pane), plan.last_window(pane))
    return df.withColumn("_k", F.explode(indexes)).withColumn("window_start", F.col("_k") * plan.stride_us).drop("_k")


def panes_to_blocks(df: DataFrame, plan: WindowPlan) -> DataFrame:
    """Copy rows carrying ``pane`` to the one or two blocks whose windows hold it."""
    pane = F.col("pane")
    first, last = plan.first_window(pane), plan.last_window(pane)
    if not plan.overlapping:
        return df.filter(first <= last).withColumn("block", last)
    k = plan.block_windows
    return df.withColumn("block", F.explode(span(floor_div(first, k), floor_div(last, k))))


def blocks_to_windows(df: DataFrame, plan: WindowPlan) -> DataFrame:
    """Copy rows carrying ``pane`` and ``block`` to their windows inside that block."""
    if not plan.overlapping:
        return df.withColumn("window_start", F.col("block") * plan.stride_us)
    k = plan.block_windows
    pane, block = F.col("pane"), F.col("block")
    low = F.greatest(plan.first_window(pane), block * k)
    high = F.least(plan.last_window(pane), block * k + (k - 1))
    return (
        df.withColumn("_k", F.explode(span(low, high)))
        .withColumn("window_start", F.col("_k") * plan.stride_us)
        .drop("_k")
    )


def window_membership(df: DataFrame, plan: WindowPlan, us: str = "us") -> DataFrame:
    """Every observation once per window holding it, before the emission bounds are applied."""
    expanded = panes_to_windows(with_pane(df, plan, us), plan).drop("pane")
    return expanded.withColumn("window_end", F.col("window_start") + plan.size_us)
