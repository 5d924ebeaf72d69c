"""Assembling one data set from independently produced batches."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.reshape import namespaced

# Columns and key a batch must have.
BATCH_COLUMNS = ("run_id", "asset_id", "tag_id", "timestamp", "value", "is_anomaly", "event_id")
BATCH_KEY = ("run_id", "asset_id", "tag_id", "timestamp")


def combine_batches(batches: Mapping[str, DataFrame]) -> DataFrame:
    """Union batches of identical schema, namespacing run and event ids by batch."""
    schemas = {name: [(f.name, f.dataType) for f in df.schema.fields] for name, df in batches.items()}
    reference = next(iter(schemas.values()))
    drifted = sorted(name for name, schema in schemas.items() if schema != reference)
    if drifted:
        raise ValueError(f"Schema drift in {drifted}")
    missing = sorted(set(BATCH_COLUMNS) - {c for c, _ in reference})
    if missing:
        raise ValueError(f"Batches lack columns: {missing}")
    named = [namespaced(df, name).withColumn("source_dataset_id", F.lit(name)) for name, df in batches.items()]
    return reduce(DataFrame.unionByName, named)


def batch_report(df: DataFrame, by: str = "source_dataset_id") -> DataFrame:
    """Per batch: rows, runs, duplicate keys, and null or anomalous labels."""
    keyed = df.groupBy(by, *BATCH_KEY).agg(
        F.count("*").alias("copies"),
        F.count_if(F.col("is_anomaly").isNull()).alias("unlabelled"),
        F.count_if(F.col("is_anomaly")).alias("anomalous"),
    )
    runs = keyed.groupBy(by, "run_id").agg(
        F.sum("copies").alias("rows"),
        F.sum(F.when(F.col("copies") > 1, F.col("copies")).otherwise(0)).alias("duplicates"),
        F.sum("unlabelled").alias("unlabelled"),
        F.sum("anomalous").alias("anomalous"),
    )
    return runs.groupBy(by).agg(
        F.sum("rows").alias("rows"),
        F.count("run_id").alias("runs"),
        F.count_if(F.col("run_id").isNull()).alias("unnamed_runs"),
        F.sum("duplicates").alias("duplicate_rows"),
        F.sum("unlabelled").alias("unlabelled_rows"),
        F.sum("anomalous").alias("anomalous_rows"),
    )


def check_batches(df: DataFrame, normal_only: bool) -> DataFrame:
    """Refuse assembled data with duplicate keys, missing labels or names, or anomalies in a normal-only part."""
    report = batch_report(df)
    wrong = (F.col("duplicate_rows") > 0) | (F.col("unlabelled_rows") > 0) | (F.col("unnamed_runs") > 0)
    if normal_only:
        wrong = wrong | (F.col("anomalous_rows") > 0)
    first = report.filter(wrong).first()
    if first is not None:
        raise ValueError(f"Batch refused: {first.asDict()}")
    return df
