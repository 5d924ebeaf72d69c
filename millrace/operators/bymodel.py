"""Apply a fitted model per key to rows, vectorised inside tasks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions.keys import key_places
from millrace.session import settle

# Fitted state up to this many array entries (8 bytes each) is sent to every executor.
BROADCAST_ENTRIES = 16_000_000
SALT_ROWS = 50_000


_reused: list[dict[tuple, tuple]] = []


@contextmanager
def reused_state() -> Iterator[None]:
    """Keep what fitted tables send to executors while the block runs, and release it at its end.

    Scoring a stream goes through the same tables for every micro-batch; inside
    the block each is measured, collected and broadcast once. Results that use
    them must be written before the block ends.
    """
    held: dict[tuple, tuple] = {}
    _reused.append(held)
    try:
        yield
    finally:
        _reused.remove(held)
        for _, value in held.values():
            if isinstance(value, Broadcast):
                value.destroy()


def once(table: DataFrame, name: str, make: Callable[[], object]) -> object:
    """``make()``, or inside ``reused_state`` what it made first for this table and name."""
    if not _reused:
        return make()
    held = _reused[-1]
    key = id(table), name
    if key not in held:
        # The table is kept with it, so that its id stays taken.
        held[key] = table, make()
    return held[key][1]


def _entries(models: DataFrame) -> int:
    def leaves(column, kind):
        if isinstance(kind.elementType, T.ArrayType):
            return F.aggregate(column, F.lit(0), lambda total, item: total + F.size(item))
        return F.size(column)

    sizes = [
        leaves(F.col(f.name), f.dataType) for f in models.schema.fields if isinstance(f.dataType, T.ArrayType)
    ]
    total = sizes[0]
    for size in sizes[1:]:
        total = total + size
    return int(models.agg(F.coalesce(F.sum(total.cast("bigint")), F.lit(0))).first()[0])


def _plain(key):
    """A key as it came, with every kind of missing as None."""
    return None if pd.isna(key) else key


def _stacked(vectors: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, dtype=float) for v in vectors]) if len(vectors) else np.empty((0, 0))


def _matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one width as a matrix; missing entries are NaN."""
    widths = vectors.value_lengths()
    if vectors.null_count or pc.min(widths) != pc.max(widths):
        raise ValueError("The vectors of a key must have one width")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(vectors), widths[0].as_py())


def _column(result: np.ndarray | dict[str, np.ndarray], kind: pa.DataType) -> pa.Array:
    """One item per row: numbers, the rows of a matrix as arrays, or several of these by name."""
    if isinstance(result, dict):
        return pa.StructArray.from_arrays([_column(result[field.name], field.type) for field in kind], fields=list(kind))
    if result.ndim == 1:
        return pa.array(result, kind)
    ends = np.arange(len(result) + 1, dtype=np.int32) * np.int32(result.shape[1])
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(result.ravel())).cast(kind)


def sendable(models: Sequence[DataFrame], broadcast_entries: int = BROADCAST_ENTRIES) -> bool:
    """Whether these written tables of fitted state may be sent to every executor together."""
    return sum(once(m, "entries", lambda m=m: _entries(m)) for m in models) <= broadcast_entries


def apply_sent(
    rows: DataFrame, shared: Broadcast, key: str, compute: Callable[[object, np.ndarray], np.ndarray | dict[str, np.ndarray]], output: str, kind: str, vector: str = "vector"
) -> DataFrame:
    """Add ``output`` = ``compute(state of the key, vectors)`` to every row, where the row is; a dict of results makes a struct."""
    arrow_kind = to_arrow_type(T._parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(keys: pa.Array, vectors: pa.Array) -> pa.Array:
        found, order = [], []
        for (value,), places in key_places([keys], len(keys)):
            whole = len(places) == len(keys)
            x = _matrix(vectors if whole else vectors.take(pa.array(places)))
            found.append(_column(compute(shared.value[_plain(value)], x), arrow_kind))
            order.append(places)
        if len(found) < 2:
            return found[0] if found else pa.array([], arrow_kind)
        back = np.empty(len(keys), dtype=np.int64)
        back[np.concatenate(order)] = np.arange(len(keys))
        return pa.concat_arrays(found).take(pa.array(back))

    return rows.withColumn(output, run(F.col(key), F.col(vector)))


def apply_models(
    rows: DataFrame,
    models: DataFrame,
    key: str,
    prepare: Callable[[pd.DataFrame], object],
    compute: Callable[[object, np.ndarray], np.ndarray],
    output: str,
    kind: str,
    vector: str = "vector",
    broadcast_entries: int = BROADCAST_ENTRIES,
    salt_rows: int = SALT_ROWS,
) -> DataFrame:
    """Add ``output`` = ``compute(prepare(model rows of the key), vectors)`` to every row.

    ``models`` should be a written table. While it is small it is broadcast and
    rows stay where they are. Beyond that, rows are salted so that a large key
    makes many groups of about ``salt_rows``, and each group meets its model in a
    cogroup; no task sees a whole key.
    """
    if sendable([models], broadcast_entries):

        def send() -> Broadcast:
            frame = models.toPandas()
            return rows.sparkSession.sparkContext.broadcast({_plain(k): prepare(g) for k, g in frame.groupby(key, sort=False, dropna=False)})

        return apply_sent(rows, once(models, f"prepared-{output}", send), key, compute, output, kind, vector)

    salts = settle(rows.groupBy(key).agg(F.ceil(F.count("*") / F.lit(salt_rows)).cast("int").alias("_salts")), "salts")
    placed = rows.join(salts, key).withColumn(
        "_salt", F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.col("_salts")).cast("int")
    ).drop("_salts")
    copies = models.join(salts, key).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))).drop("_salts")
    names = rows.columns

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        result = left[names].copy()
        if len(left):
            result[output] = list(compute(prepare(right), _stacked(left[vector])))
        else:
            result[output] = []
        return result

    schema = T.StructType([*rows.schema.fields, T.StructField(output, T._parse_datatype_string(kind))])
    return (
        placed.groupBy(key, "_salt").cogroup(copies.groupBy(key, "_salt")).applyInPandas(meet, schema)
    )
