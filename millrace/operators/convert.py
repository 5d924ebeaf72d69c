"""Unit conversion of telemetry values."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.units import find_unit, fold_column, unit_rows


def _with_units(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Attach source and target unit definitions. Both tables have a fixed or configured size."""
    spark = df.sparkSession
    schema = "_key string, _dimension string, _scale double, _offset double"
    known = F.broadcast(spark.createDataFrame(unit_rows(), schema))
    wanted = []
    for signal, unit in targets.items():
        found = find_unit(unit) or (None, None, None)
        wanted.append((signal, unit, *found))
    target = F.broadcast(
        spark.createDataFrame(
            wanted, "signal_class string, _unit string, _to_dimension string, _to_scale double, _to_offset double"
        )
    )
    keyed = df.withColumn("_key", fold_column(F.col("unit")))
    return keyed.join(target, "signal_class", "left").join(known, "_key", "left").select(
        *df.columns, "_unit", "_to_dimension", "_to_scale", "_to_offset", "_dimension", "_scale", "_offset"
    )


def _problem():
    """Why a row with a configured target cannot be converted, or null."""
    return (
        F.when(F.col("_unit").isNull(), F.lit(None).cast("string"))
        .when(F.col("_to_dimension").isNull(), F.lit("unsupported target unit"))
        .when(F.col("unit").isNull(), F.lit("missing unit"))
        .when(F.col("_dimension").isNull(), F.lit("unsupported source unit"))
        .when(F.col("_dimension") != F.col("_to_dimension"), F.lit("incompatible unit"))
    )


def unit_problems(df: DataFrame, targets: Mapping[str, str]) -> DataFrame:
    """Rows that cannot be converted, counted per signal, unit and reason."""
    return (
        _with_units(df, targets)
        .withColumn("problem", _problem())
        .filter(F.col("problem").isNotNull())
        .groupBy("signal_class", "unit", "problem")
        .agg(F.count("*").alias("rows"))
    )


def convert_units(df: DataFrame, targets: Mapping[str, str] | None) -> DataFrame:
    """Convert configured signals to their target unit; others pass through.

    A row that cannot be converted fails the query, in the same pass.
    """
    if not targets:
        return df
    if "unit" not in df.columns:
        raise ValueError("Unit conversion needs a unit column")
    rows = _with_units(df, targets).withColumn("_problem", _problem())
    factor = F.col("_scale") / F.col("_to_scale")
    offset = (F.col("_offset") - F.col("_to_offset")) / F.col("_to_scale")
    value = F.col("value").cast("double")
    message = F.concat(F.col("_problem"), F.lit(" for signal "), F.col("signal_class"))
    converted = (
        F.when(F.col("_unit").isNull(), value)
        .when(F.col("_problem").isNotNull(), F.raise_error(message).cast("double"))
        .otherwise(value * factor + offset)
    )
    replaced = {
        "value": converted.alias("value"),
        "unit": F.coalesce(F.col("_unit"), F.col("unit")).alias("unit"),
    }
    return rows.select(*[replaced.get(c, F.col(c)) for c in df.columns])
