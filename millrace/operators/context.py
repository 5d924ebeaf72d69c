"""Context vocabulary and one-hot context features."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.hashing import short_sha1
from millrace.operators.features import CONTEXTS


def context_vocabulary(windows: DataFrame) -> DataFrame:
    """Distinct non-null context values as (context, value)."""
    parts = [
        windows.select(F.lit(c).alias("context"), F.col(c).cast("string").alias("value")).filter(F.col("value").isNotNull())
        for c in CONTEXTS
        if c in windows.columns
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def vocabulary_lists(vocabulary: DataFrame) -> dict[str, list[str]]:
    """The vocabulary as sorted lists. Its entries become column names, so it is schema-sized."""
    out: dict[str, list[str]] = {c: [] for c in CONTEXTS}
    for row in vocabulary.orderBy("context", "value").collect():
        out[row["context"]].append(row["value"])
    return out


def encode_contexts(windows: DataFrame, vocabulary: Mapping[str, Sequence[str]]) -> DataFrame:
    """Add a boolean column per known context value, and whether the regime is unknown."""
    columns = []
    for context in CONTEXTS:
        value = F.coalesce(F.col(context).cast("string"), F.lit("unknown")) if context in windows.columns else F.lit("unknown")
        known = list(vocabulary.get(context, []))
        columns += [(value == v).alias(f"context_{context}_{short_sha1(v)}") for v in known]
        if context == "operating_regime":
            columns.append((~value.isin(known) if known else F.lit(True)).alias("context_regime_unknown"))
    return windows.select("*", *columns)


def context_columns(vocabulary: Mapping[str, Sequence[str]]) -> list[str]:
    """Names of the columns ``encode_contexts`` adds, in order."""
    names = [f"context_{c}_{short_sha1(v)}" for c in CONTEXTS for v in vocabulary.get(c, [])]
    return [*names, "context_regime_unknown"]
