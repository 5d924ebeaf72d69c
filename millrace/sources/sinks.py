"""Writers, the provenance-checked feature cache and partition summaries."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_predictions(df: DataFrame, path: str) -> str:
    """Parquet when the path ends in .parquet, JSON lines otherwise."""
    writer = df.write.mode("errorifexists")
    if path.lower().endswith(".parquet"):
        writer.parquet(path)
    else:
        writer.json(path)
    return path


def write_events(df: DataFrame, path: str) -> str:
    """Event intervals as JSON lines, so no task has to hold them all."""
    df.select("run_id", "asset_id", "event_id", "start_us", "end_us").write.mode("errorifexists").json(path)
    return path


def write_partitions(df: DataFrame, path: str, column: str = "partition") -> str:
    """Normalised telemetry as zstd Parquet, one directory per partition value."""
    df.write.mode("errorifexists").option("compression", "zstd").partitionBy(column).parquet(path)
    return path


def write_scored(df: DataFrame, path: str, scores: list[str], mode: str = "errorifexists") -> str:
    """Identity, labels and scores of windows, kept for later audit."""
    keep = [
        c
        for c in ("run_id", "asset_id", "asset_class", "window_start", "window_end", "is_anomaly", "event_id", "event_start_us")
        if c in df.columns
    ]
    df.select(*keep, *scores).write.mode(mode).option("compression", "zstd").parquet(path)
    return path


def cached_features(spark: SparkSession, path: str, provenance: dict, build) -> DataFrame:
    """Reuse a feature table when its recorded provenance equals ``provenance``; refuse when it differs.

    ``build`` is called only when there is no table yet. The provenance row is
    written last, so a half-written table is never taken for a complete one.
    """
    wanted = json.dumps(provenance, sort_keys=True)
    data, note = f"{path}/features", f"{path}/provenance"

    def read(target: str, fmt: str):
        try:
            return spark.read.format(fmt).load(target)
        except AnalysisException as problem:
            if "PATH_NOT_FOUND" in str(problem) or "UNABLE_TO_INFER_SCHEMA" in str(problem):
                return None
            raise

    recorded = read(note, "text")
    if recorded is not None:
        found = recorded.first()
        if found is None or found[0] != wanted:
            raise ValueError("Feature cache was built from other data, schema or options")
        return spark.read.parquet(data)
    if read(data, "parquet") is not None:
        raise ValueError("Feature cache has no provenance; use a new path")
    build().write.parquet(data)
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(note)
    return spark.read.parquet(data)


def partition_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Row, run, asset and label counts. Distinct counts come from a pre-reduced (run, asset) table."""
    pairs = df.groupBy(*by, "run_id", "asset_id").agg(
        F.count("*").alias("rows"), F.count_if("is_anomaly").alias("anomalous")
    )
    runs = pairs.groupBy(*by, "run_id").agg(F.sum("rows").alias("rows"), F.sum("anomalous").alias("anomalous"))
    assets = pairs.groupBy(*by, "asset_id").agg(F.lit(1).alias("one"))
    by_run = runs.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        (F.sum("rows") - F.sum("anomalous")).alias("normal_rows"),
        F.sum("anomalous").alias("anomalous_rows"),
        F.count("*").alias("runs"),
        F.count_if(F.col("anomalous") == 0).alias("normal_runs"),
        F.count_if(F.col("anomalous") > 0).alias("event_runs"),
    )
    by_asset = assets.groupBy(*by).agg(F.count("*").alias("assets"))
    return by_run.join(by_asset, by)


def asset_label_counts(df: DataFrame) -> DataFrame:
    """Normal and anomalous row counts per asset."""
    return df.groupBy("asset_id").agg(
        F.count_if(~F.col("is_anomaly")).alias("normal_rows"), F.count_if("is_anomaly").alias("anomalous_rows")
    )
