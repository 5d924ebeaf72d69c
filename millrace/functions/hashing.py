"""Stable digests used for splits and draws; they do not depend on row order or partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest_prefix(text: Column) -> Column:
    """First 32 bits of the SHA-256 of a text, as a bigint."""
    return F.conv(F.substring(F.sha2(text.cast("string"), 256), 1, 8), 16, 10).cast("bigint")


def run_bucket(column: Column | str, modulo: int) -> Column:
    """Stable bucket of a whole run; independent of labels and row order."""
    if modulo < 2:
        raise ValueError("A split needs a modulo of at least 2")
    source = F.col(column) if isinstance(column, str) else column
    return F.pmod(digest_prefix(source), F.lit(modulo).cast("bigint"))


def short_sha1(text: str) -> str:
    """Eight hex digits that name a context value inside a column name."""
    import hashlib

    return hashlib.sha1(text.encode()).hexdigest()[:8]
