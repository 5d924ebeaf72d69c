"""Long-format telemetry: reading mixed files, typing them, and checking the contract."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.arrays import finite

# The contract of a telemetry table.
REQUIRED_COLUMNS = ("run_id", "asset_id", "timestamp", "tag_id", "signal_class", "value")
OBSERVATION_KEY = ("run_id", "asset_id", "timestamp", "tag_id")
QUALITIES = ("good", "uncertain", "bad")
GUARDED_PARTITION = "challenge"

# Types of the optional columns; anything else keeps the type it was read with.
COLUMN_TYPES = {
    "run_id": "string", "asset_id": "string", "tag_id": "string", "signal_class": "string",
    "sampling_interval_ms": "double", "engineering_min": "double", "engineering_max": "double",
    "event_start_us": "bigint",
}


def guard_partition(path: str, allow_challenge: bool = False) -> str:
    """Refuse paths with a ``challenge`` component unless the caller opts in."""
    parts = {p.casefold() for p in PurePosixPath(str(path).split("://")[-1]).parts}
    if GUARDED_PARTITION in parts and not allow_challenge:
        raise PermissionError("Reading a challenge partition needs allow_challenge=True")
    return path


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """Smallest type both sides fit; text when nothing else does."""
    if left == right:
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(right, T.NullType):
        return left
    ladder = [T.BooleanType, T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType]
    kinds = [type(left), type(right)]
    if all(k in ladder for k in kinds):
        if set(kinds) & {T.LongType, T.IntegerType} and T.FloatType in kinds:
            return T.DoubleType()
        return ladder[max(ladder.index(k) for k in kinds)]()
    if all(k in (T.DateType, T.TimestampType, T.TimestampNTZType) for k in kinds):
        return T.TimestampType()
    return T.StringType()


def union_relaxed(frames: Sequence[DataFrame]) -> DataFrame:
    """Union by name; absent columns become null and differing types meet at their common type."""
    types: dict[str, T.DataType] = {}
    for frame in frames:
        for field in frame.schema.fields:
            types[field.name] = common_type(types.get(field.name, T.NullType()), field.dataType)
    cast = [f.select(*[F.col(c).cast(types[c]).alias(c) for c in f.columns]) for f in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def _list_files(spark: SparkSession, path: str, suffix: str) -> list[str]:
    """Sorted file paths; only names are listed, contents are not read."""
    if path.endswith(suffix):
        return [path]
    if path.endswith((".csv", ".parquet")):
        return []
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", f"*{suffix}")
        .load(path)
        .select("path")
    )
    return sorted(r[0] for r in files.collect())


def _read_csv(spark: SparkSession, path: str) -> list[DataFrame]:
    """CSV files grouped by header, one scan per distinct header. Everything stays text until typed."""
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in _list_files(spark, path, ".csv"):
        header = tuple(spark.read.option("header", "true").csv(file).columns)
        by_header.setdefault(header, []).append(file)
    return [
        spark.read.option("header", "true").schema(", ".join(f"`{c}` string" for c in header)).csv(files)
        for header, files in by_header.items()
    ]


def _read_parquet(spark: SparkSession, path: str) -> list[DataFrame]:
    """Parquet files in one merged scan; files whose types conflict are grouped by schema instead."""
    if path.endswith(".csv"):
        return []
    reader = spark.read.option("mergeSchema", "true")
    try:
        if path.endswith(".parquet"):
            return [reader.parquet(path)]
        return [reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(path)]
    except AnalysisException as problem:
        if "UNABLE_TO_INFER_SCHEMA" in str(problem):
            return []
        raise
    except PySparkException:
        groups: dict[str, list[str]] = {}
        for file in _list_files(spark, path, ".parquet"):
            groups.setdefault(spark.read.parquet(file).schema.json(), []).append(file)
        return [spark.read.parquet(*files) for files in groups.values()]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV and Parquet file below a path as one relation."""
    frames = _read_parquet(spark, path) + _read_csv(spark, path)
    if not frames:
        raise ValueError(f"No CSV or Parquet files below {path}")
    return frames[0] if len(frames) == 1 else union_relaxed(frames)


def has_column(spark: SparkSession, path: str, name: str) -> bool:
    """Whether any file below a path has a column; reads footers and headers only."""
    return any(name in f.columns for f in _read_parquet(spark, path) + _read_csv(spark, path))


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED_COLUMNS) -> DataFrame:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required columns: {missing}")
    return df


def utc_timestamp(df: DataFrame, column: str = "timestamp") -> Column:
    """Text is parsed strictly (as UTC when it has no offset); dates and timestamps are cast."""
    return F.col(column).cast("timestamp")


def strict_label(df: DataFrame, column: str = "is_anomaly") -> Column:
    """Boolean label from boolean, 0/1, or the same as text; anything else fails the query."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.BooleanType):
        return F.col(column)
    text = F.lower(F.col(column).cast("string"))
    return (
        F.when(F.col(column).isNull(), F.lit(None).cast("boolean"))
        .when(text.isin("1", "1.0", "true"), F.lit(True))
        .when(text.isin("0", "0.0", "false"), F.lit(False))
        .otherwise(F.raise_error(F.lit(f"Column {column} has a label that is neither true or false nor 1 or 0")).cast("boolean"))
    )


def typed(df: DataFrame) -> DataFrame:
    """Apply the contract's types; a text that does not parse fails the query."""
    require_columns(df)
    columns = []
    for name in df.columns:
        if name == "timestamp":
            columns.append(utc_timestamp(df).alias(name))
        elif name == "value":
            columns.append(F.col(name).cast("double").alias(name))
        elif name == "is_anomaly":
            columns.append(strict_label(df).alias(name))
        elif name in COLUMN_TYPES:
            columns.append(F.col(name).cast(COLUMN_TYPES[name]).alias(name))
        else:
            columns.append(F.col(name))
    return df.select(*columns)


def duplicate_observations(df: DataFrame, key: Sequence[str] = OBSERVATION_KEY) -> DataFrame:
    """Keys that occur more than once. Counting combines before the shuffle, so a hot key is one row per task."""
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def contract_report(df: DataFrame) -> DataFrame:
    """Violations per rule, in one pass over the rows."""
    empty = F.lit(False)
    for name in REQUIRED_COLUMNS:
        empty = empty | F.col(name).isNull()
    quality = (
        F.col("quality").isNotNull() & ~F.col("quality").isin(*QUALITIES) if "quality" in df.columns else F.lit(False)
    )
    return df.agg(
        F.count("*").alias("rows"),
        F.count_if(empty).alias("null_required"),
        F.count_if(quality).alias("bad_quality_label"),
        F.count_if(F.col("value").isNotNull() & ~finite(F.col("value"))).alias("non_finite"),
    )


def checked(df: DataFrame) -> DataFrame:
    """Return the rows unchanged, or raise on the first violated rule."""
    found = contract_report(df).first()
    if found["null_required"]:
        raise ValueError("A required column has null values")
    if found["bad_quality_label"]:
        raise ValueError("An observation has a quality other than good, uncertain, bad and null")
    if found["non_finite"]:
        raise ValueError("An observation has an infinite or undefined value")
    if not duplicate_observations(df).limit(1).isEmpty():
        raise ValueError("Several observations share run, asset, time and tag")
    return df


def load_telemetry(spark: SparkSession, path: str, allow_challenge: bool = False, validate: bool = True) -> DataFrame:
    """Read, type and check a telemetry directory or file."""
    df = typed(read_raw(spark, guard_partition(path, allow_challenge)))
    return checked(df) if validate else df


def read_wide(spark: SparkSession, path: str, tags: Sequence[str], time: str = "timestamp") -> DataFrame:
    """Wide instance files, one column per tag, as CSV, Parquet or both.

    Empty text is null, the time becomes a timestamp and tags that a file has
    become numbers; text that does not parse fails the query. Other columns stay
    as they were read, and tags of no file stay absent.
    """
    df = require_columns(read_raw(spark, path), [time])
    columns = []
    for field in df.schema.fields:
        text = isinstance(field.dataType, T.StringType)
        column = F.nullif(F.col(f"`{field.name}`"), F.lit("")) if text else F.col(f"`{field.name}`")
        if field.name == time:
            column = column.cast("timestamp")
        elif field.name in tags:
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)
