"""Words of whole texts, as bytes, for operators that work inside Python tasks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

# Rows of an Arrow batch that are turned into Python objects together.
ROWS_AT_ONCE = 1000

# Runs of digits, ASCII letters and anything beyond ASCII, after lower-casing A-Z.
ALNUM_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def utf8(text: str | None) -> bytes:
    """UTF-8 of a text, empty for null."""
    return b"" if text is None else text.encode("utf-8")


def lowered(text: str | None) -> bytes:
    """UTF-8 with only A-Z in lower case, as ``bytes.lower`` has it."""
    return utf8(text).lower()


def alnum_words(text: str | None) -> list[bytes]:
    return ALNUM_WORD.findall(lowered(text))


def spaced_words(text: str | None) -> list[bytes]:
    """Words between runs of space, tab, line feed, vertical tab, form feed and return."""
    return lowered(text).split()


def add_columns(df: DataFrame, inputs: list[str], added: T.StructType, make: Callable[[], Callable[..., list[list]]]) -> DataFrame:
    """Add columns that Python computes from the values of ``inputs``.

    ``make`` runs once per task and returns a function from one list per input
    column to one list per added column. Rows go through in Arrow batches and
    keep their other columns as they are; columns named as an added one are
    replaced.
    """
    names = {f.name for f in added.fields}
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + added.fields)
    types = to_arrow_schema(added)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            for first in range(0, batch.num_rows, ROWS_AT_ONCE):
                part = batch.slice(first, ROWS_AT_ONCE)
                values = compute(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in inputs])
                columns = [part.column(part.schema.get_field_index(f.name)) for f in kept]
                columns += [pa.array(v, type=t.type) for v, t in zip(values, types, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.fieldNames())

    return df.mapInArrow(run, schema)


def fresh_name(schema: T.StructType, wanted: str) -> str:
    """A column name that the table does not use, in any case."""
    taken = {f.name.lower() for f in schema.fields}
    name = wanted
    while name.lower() in taken:
        name = f"_{name}"
    return name


def sheltered(df: DataFrame, names: Iterable[str]) -> tuple[DataFrame, list[Column]]:
    """Rename columns that clash with ``names``; the second value selects all columns under their old names."""
    clashing = {c: fresh_name(df.schema, f"kept_{c}") for c in df.columns if c in set(names)}
    return df.withColumnsRenamed(clashing), [F.col(f"`{clashing.get(c, c)}`").alias(c) for c in df.columns]
