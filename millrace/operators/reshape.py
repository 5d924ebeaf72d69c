"""Wide to long, sentinels, tag mapping, labels from codes, and first-copy deduplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common well channels, tag -> (signal class, unit).
WELL_CHANNELS = {
    "P-PDG": ("downhole_pressure", "Pa"),
    "P-TPT": ("subsea_tree_pressure", "Pa"),
    "T-TPT": ("subsea_tree_temperature", "degC"),
    "P-MON-CKP": ("production_choke_upstream_pressure", "Pa"),
    "T-JUS-CKP": ("production_choke_downstream_temperature", "degC"),
    "P-JUS-CKGL": ("gas_lift_choke_downstream_pressure", "Pa"),
    "QGL": ("gas_lift_flow", "m3/s"),
}
# Readings that mean "not available".
WELL_SENTINELS = {"P-PDG": (-1.180116e42,)}
MIN_COMMON_CHANNELS = 4
# Units of encoded states rather than measured quantities.
STATE_UNITS = ("code", "enum", "state")


def common_tags(columns: Sequence[str], mapping: Mapping[str, object], least: int = MIN_COMMON_CHANNELS) -> list[str]:
    """Mapped tags a wide table has, in mapping order; too few are refused."""
    tags = [t for t in mapping if t in columns]
    if len(tags) < least:
        raise ValueError(f"Too few common channels: {tags}")
    return tags


def _is_sentinel(tag: str, values: Sequence[float]) -> Column:
    return F.col(f"`{tag}`").cast("double").isin([float(v) for v in values])


def blank_sentinels(df: DataFrame, sentinels: Mapping[str, Sequence[float]]) -> DataFrame:
    """Replace exact sentinel readings by null."""
    out = df
    for tag, values in sentinels.items():
        if tag in df.columns:
            out = out.withColumn(tag, F.when(_is_sentinel(tag, values), None).otherwise(F.col(f"`{tag}`").cast("double")))
    return out


def count_sentinels(df: DataFrame, sentinels: Mapping[str, Sequence[float]], label: str, by: Sequence[str] = ()) -> DataFrame:
    """Sentinel readings on labelled rows, per tag."""
    counts = [
        F.count_if(_is_sentinel(tag, values) & F.col(label).isNotNull()).alias(tag)
        for tag, values in sentinels.items()
        if tag in df.columns
    ]
    return df.groupBy(*by).agg(*counts)


def unpivot_signals(df: DataFrame, keep: Sequence[str], tags: Sequence[str], name: str = "tag_id", value: str = "value") -> DataFrame:
    """One row per non-null reading."""
    cast = df.select(*keep, *[F.col(f"`{t}`").cast("double").alias(t) for t in tags])
    return cast.unpivot(list(keep), [F.col(f"`{t}`") for t in tags], name, value).filter(F.col(value).isNotNull())


def map_tags(df: DataFrame, mapping: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Add signal class and unit of each tag; an unmapped tag fails the query. The mapping is configuration-sized."""
    rows = [(tag, signal, unit) for tag, (signal, unit) in mapping.items()]
    table = F.broadcast(df.sparkSession.createDataFrame(rows, "tag_id string, signal_class string, unit string"))
    joined = df.join(table, "tag_id", "left")
    unmapped = F.raise_error(F.concat(F.lit("Unmapped tag "), F.col("tag_id"))).cast("string")
    return joined.withColumn("signal_class", F.when(F.col("signal_class").isNull(), unmapped).otherwise(F.col("signal_class")))


def labelled_only(df: DataFrame, label: str) -> DataFrame:
    """Drop rows without a label; they are neither normal nor anomalous."""
    return df.filter(F.col(label).isNotNull())


def labels_from_code(df: DataFrame, code: str, run: str = "run_id") -> DataFrame:
    """Any non-zero code is anomalous; the event id joins run and code."""
    positive = F.col(code) != 0
    return df.withColumn("is_anomaly", positive).withColumn(
        "event_id", F.when(positive, F.concat_ws(":", F.col(run), F.col(code).cast("bigint").cast("string")))
    )


def first_copies(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep one row per key: the first by ``order``, then by content.

    An aggregate, not a row number: copies are reduced before the shuffle, so a
    key with very many copies does not end up in one task.
    """
    rest = [c for c in df.columns if c not in key]
    lead = [c for c in order if c not in key]
    body = [*lead, *[c for c in rest if c not in lead]]
    kept = df.groupBy(*key).agg(F.min(F.struct(*body)).alias("_first"), F.count("*").alias("_copies"))
    return kept.select(*[F.col(c) if c in key else F.col(f"_first.{c}").alias(c) for c in df.columns], "_copies")


def removed_copies(kept: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows kept and removed, from the result of ``first_copies``."""
    return kept.groupBy(*by).agg(
        F.count("*").alias("kept"), (F.sum("_copies") - F.count("*")).alias("removed")
    )


def asset_from_path(path: Column, pattern: str = r"(?i)WELL-(\d+)", prefix: str = "WELL-", digits: int = 5) -> Column:
    """``WELL-00019`` from a path naming well 19; ``unknown`` without a number."""
    number = F.regexp_extract(path, pattern, 1)
    padded = F.lpad(number.try_cast("bigint").cast("string"), digits, "0")
    return F.when(number == "", F.lit("unknown")).otherwise(F.concat(F.lit(prefix), padded))


def with_roles(df: DataFrame) -> DataFrame:
    """Point role from the tag, value kind from the unit, lower-case quality; source labels are dropped."""
    out = df.drop("is_anomaly", "event_id", "event_start_us")
    if "tag_id" in out.columns:
        out = out.withColumn("measurement_role", F.col("tag_id").cast("string"))
    if "unit" in out.columns:
        coded = F.lower(F.col("unit").cast("string")).isin(*STATE_UNITS)
        out = out.withColumn("value_kind", F.when(coded, F.lit("categorical")).otherwise(F.lit("continuous")))
    if "quality" in out.columns:
        out = out.withColumn("quality", F.lower(F.col("quality").cast("string")))
    return out


def namespaced(df: DataFrame, prefix: Column | str, columns: Sequence[str] = ("run_id", "event_id"), separator: str = "::") -> DataFrame:
    """Prefix identifiers; null stays null."""
    head = F.lit(prefix) if isinstance(prefix, str) else prefix
    out = df
    for column in columns:
        if column in df.columns:
            out = out.withColumn(column, F.concat(head, F.lit(separator), F.col(column)))
    return out
