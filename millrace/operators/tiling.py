"""Comparing window lengths and tail policies on common ground."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.timeline import MINUTE_US, SECOND_US, floor_to

GRID = ["run_id", "asset_id", "window_start"]


def complete_tiles(windows: DataFrame, seconds: int, tile_us: int = MINUTE_US) -> DataFrame:
    """Tiles (minutes by default) covered exactly once by windows of a given length; any repeat disqualifies."""
    part = seconds * SECOND_US
    start = F.col("window_start")
    tile = floor_to("window_start", tile_us)
    fits = (
        (F.col("window_end") <= tile + tile_us)
        & (F.col("window_end") - start == part)
        & (F.pmod(start - tile, F.lit(part)) == 0)
    )
    pieces = windows.filter(fits).groupBy("run_id", "asset_id", tile.alias("tile"), "window_start").agg(F.count("*").alias("copies"))
    return (
        pieces.groupBy("run_id", "asset_id", "tile")
        .agg(F.count("*").alias("n"), F.sum("copies").alias("rows"))
        .filter((F.col("n") == tile_us // part) & (F.col("rows") == F.col("n")))
        .select("run_id", "asset_id", F.col("tile").alias("window_start"))
    )


def tile_scores(windows: DataFrame, score: str = "score", tile_us: int = MINUTE_US) -> DataFrame:
    """Largest score of the windows starting in each tile."""
    return windows.groupBy("run_id", "asset_id", floor_to("window_start", tile_us).alias("window_start")).agg(
        F.max(score).alias(score)
    )


def tail_accounting(windows: DataFrame, score: str, threshold: float, stride_seconds: float = 60.0) -> DataFrame:
    """What dropping incomplete tails costs and saves.

    ``windows`` carry ``retained``, ``first_observation`` and ``watermark``.
    """
    alert: Column = F.col(score) >= F.lit(float(threshold))
    false_alert = alert & ~F.col("is_anomaly")
    kept = F.col("retained")
    per_asset = windows.groupBy("run_id", "asset_id").agg(
        ((F.max("watermark") - F.min("first_observation")) / F.lit(3.6e9)).alias("hours"),
        F.count("*").alias("windows"),
        F.count_if(kept).alias("kept"),
        F.count_if(~kept & F.col("is_anomaly")).alias("lost_positive"),
        F.count_if(false_alert).alias("false_all"),
        F.count_if(false_alert & kept).alias("false_kept"),
    )
    days = F.sum("hours") / F.lit(24.0)
    return per_asset.agg(
        F.sum("windows").alias("original_windows"),
        F.sum("kept").alias("retained_windows"),
        (F.sum("windows") - F.sum("kept")).alias("excluded_windows"),
        F.sum("lost_positive").alias("excluded_positive_windows"),
        F.sum("hours").alias("observed_asset_hours"),
        (F.sum("kept") * F.lit(stride_seconds / 3600.0)).alias("retained_window_asset_hours"),
        F.try_divide(F.sum("false_all"), days).alias("false_alerts_per_observed_day"),
        F.try_divide(F.sum("false_kept"), days).alias("retained_false_alerts_per_observed_day"),
    )
