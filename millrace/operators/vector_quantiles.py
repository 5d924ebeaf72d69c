"""Exact quantiles of every entry of vectors, per key, without a row per entry.

A quantile lies between two order statistics. Each is bracketed by counting:

* tasks keep one histogram per key, entry and order statistic, over bins of
  the bracket, and send only the counts on;
* the bin that holds the order statistic is the next bracket, cut to the least
  and largest value found in it, so that equal values close it at once;
* once few values are left inside the brackets, they alone are sent, with
  their counts, and the order statistic is read off.

Bins divide the order of doubles as integers (sign, exponent, digits), so every
round narrows a bracket by the number of bins, whatever the scale of the values.
Brackets are as many as keys times entries and are sent to every task; that is
checked, and beyond ``STATE_ENTRIES`` the entries are ranked as rows instead.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from millrace.functions.keys import key_places
from millrace.operators.ranks import exact_quantiles
from millrace.session import settle

# Bins of a bracket; fewer where there are so many entries that a task would hold more than ``BIN_CELLS`` counts.
BINS = 128
LEAST_BINS = 16
BIN_CELLS = 8_000_000
STATE_ENTRIES = 2_000_000
# Values inside all brackets that may be sent on, with their counts.
SENT_VALUES = 1_000_000
_SIGN = np.int64(0x7FFFFFFFFFFFFFFF)


def _ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as integers in the same order; every NaN is one value above all others, and zero has one sign."""
    x = np.where(np.isnan(x), np.nan, x) + 0.0
    bits = x.view(np.int64)
    return np.where(bits < 0, bits ^ _SIGN, bits)


def _plain(ordered: np.ndarray) -> np.ndarray:
    return np.where(ordered < 0, ordered ^ _SIGN, ordered).view(np.float64)


def _matrix(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as a matrix of ordered integers and where it has values; short vectors end in gaps."""
    flat = vectors.flatten()
    known = ~flat.is_null().to_numpy(zero_copy_only=False)
    x = _ordered(flat.to_numpy(zero_copy_only=False).astype(np.float64))
    widths = np.nan_to_num(vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)).astype(np.int64)
    if len(widths) and (widths == widths[0]).all():
        return x.reshape(len(widths), -1), known.reshape(len(widths), -1)
    place = np.repeat(np.arange(len(widths)), widths), np.concatenate([np.arange(w) for w in widths]).astype(np.int64)
    shape = len(widths), int(widths.max(initial=0))
    out, held = np.zeros(shape, np.int64), np.zeros(shape, bool)
    out[place], held[place] = x, known
    return out, held


def _bounds(key_types: list[pa.DataType]):
    """Per task one row for each key and entry: how many values, the least and the largest."""
    top, bottom = np.iinfo(np.int64).max, np.iinfo(np.int64).min
    empty = (0, top, bottom)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list[np.ndarray]] = {}
        for batch in batches:
            for key, places in key_places(batch.columns[:-1], batch.num_rows):
                x, known = _matrix(batch.columns[-1].take(pa.array(places)))
                found = [known.sum(axis=0), np.where(known, x, top).min(axis=0), np.where(known, x, bottom).max(axis=0)]
                before = held.get(key, [np.zeros(0, np.int64)] * 3)
                width = max(len(before[0]), len(found[0]))
                (n, low, high), (n2, low2, high2) = (
                    [np.pad(a, (0, width - len(a)), constant_values=v) for a, v in zip(part, empty, strict=True)] for part in (before, found)
                )
                held[key] = [n + n2, np.minimum(low, low2), np.maximum(high, high2)]
        for key, values in held.items():
            width = len(values[0])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([k] * width, t) for k, t in zip(key, key_types, strict=True)), pa.array(np.arange(width), pa.int32()), *map(pa.array, values)],
                names=[*(f"k{i}" for i in range(len(key))), "position", "n", "low", "high"],
            )

    return run


class _State:
    """Of one key, by entry and order statistic: its bracket, how many values lie below, and its rank."""

    def __init__(self, counts: np.ndarray, low: np.ndarray, high: np.ndarray, ranks: np.ndarray):
        self.counts, self.ranks = counts, ranks
        shape = ranks.shape
        self.low, self.high = (np.broadcast_to(a, shape).copy() for a in (low, high))
        self.below = np.zeros(shape, np.int64)
        self.inside = np.broadcast_to(counts, shape).copy()
        self.high = np.where(self.inside > 0, self.high, self.low)

    def open(self) -> np.ndarray:
        return self.low < self.high


def _alike(low: np.ndarray, high: np.ndarray) -> list[tuple[int, tuple[int, ...]]]:
    """Order statistics with the same brackets, which are counted once: (the first of them, all)."""
    groups: dict[tuple[bytes, bytes], list[int]] = {}
    for r in range(len(low)):
        groups.setdefault((low[r].tobytes(), high[r].tobytes()), []).append(r)
    return [(g[0], tuple(g)) for g in groups.values()]


def _counts(brackets, bins: int, exact: bool):
    """Per task, counts and bounds of the values inside open brackets by bin; a bin is a value itself if ``exact``."""
    top, bottom = np.iinfo(np.int64).max, np.iinfo(np.int64).min

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = brackets.value
        held: dict[tuple, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for key, places in key_places(batch.columns[:-1], batch.num_rows):
                number, low, high, width = known[key]
                x, has = _matrix(batch.columns[-1].take(pa.array(places)))
                for r, same in _alike(low, high):
                    entries = np.flatnonzero(low[r] < high[r])
                    entries = entries[entries < x.shape[1]]
                    if not len(entries):
                        continue
                    values, lows, highs = x[:, entries], low[r, entries], high[r, entries]
                    row, column = np.nonzero(has[:, entries] & (values >= lows) & (values <= highs))
                    entry, found = entries[column], values[row, column]
                    if exact:
                        pairs, n = np.unique(np.stack([entry, found]), axis=1, return_counts=True)
                        for each in same:
                            yield _rows(number, pairs[0], each, pairs[1], n, pairs[1], pairs[1])
                        continue
                    place = ((found.astype(np.uint64) - lows[column].astype(np.uint64)) // width[r, entry]).astype(np.int64)
                    size = low.shape[1] * bins
                    if (number, same) not in held:
                        held[number, same] = np.zeros(size, np.int64), np.full(size, top), np.full(size, bottom)
                    counted, least, most = held[number, same]
                    at = entry * bins + place
                    counted += np.bincount(at, minlength=size)
                    np.minimum.at(least, at, found)
                    np.maximum.at(most, at, found)
        for (number, same), (counted, least, most) in held.items():
            places = np.flatnonzero(counted)
            for each in same:
                yield _rows(number, places // bins, each, places % bins, counted[places], least[places], most[places])

    return run


def _rows(number: int, entry: np.ndarray, r: int, *counted: np.ndarray) -> pa.RecordBatch:
    size = len(entry)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(size, number), pa.int32()), pa.array(entry, pa.int32()), pa.array(np.full(size, r), pa.int32()), *(pa.array(c, pa.int64()) for c in counted)],
        names=["key", "position", "r", "bin", "n", "low", "high"],
    )


def _narrow(source: DataFrame, states: dict[tuple, _State], bins: int, exact: bool) -> None:
    """One pass over the vectors: every open bracket becomes the bin that holds its order statistic."""
    context = source.sparkSession.sparkContext
    numbers = {key: i for i, key in enumerate(states)}
    # Spans are up to the whole range of 64 bits, so their widths are unsigned.
    widths = {k: ((s.high.astype(np.uint64) - s.low.astype(np.uint64)) // np.uint64(bins) + np.uint64(1)) for k, s in states.items()}
    brackets = context.broadcast({k: (numbers[k], s.low, s.high, widths[k]) for k, s in states.items()})
    wanted = [
        (numbers[k], int(e), int(r), int(s.ranks[r, e] - s.below[r, e]))
        for k, s in states.items() for r, e in zip(*np.nonzero(s.open()), strict=True)
    ]
    targets = source.sparkSession.createDataFrame(
        pa.table({n: pa.array(v, t) for n, v, t in zip(("key", "position", "r", "want"), zip(*wanted, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)})
    )
    counted = source.mapInArrow(_counts(brackets, bins, exact), "key int, position int, r int, bin long, n long, low long, high long")
    summed = counted.groupBy("key", "position", "r", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    # A bracket has as many bins as a histogram, or few values.
    upto = F.sum("n").over(Window.partitionBy("key", "position", "r").orderBy("bin"))
    joined = summed.withColumn("upto", upto).join(targets, ["key", "position", "r"])
    found = joined.where((F.col("upto") > F.col("want")) & (F.col("upto") - F.col("n") <= F.col("want"))).drop("want").collect()
    brackets.destroy()
    by_number = list(states)
    for row in found:
        state, at = states[by_number[row.key]], (row.r, row.position)
        state.below[at] += row.upto - row.n
        state.inside[at] = row.n
        state.low[at], state.high[at] = row.low, row.high


def vector_quantiles(
    rows: DataFrame, keys: Sequence[str], vector: str, probabilities: Sequence[float], names: Sequence[str],
    bins: int = BINS, state_entries: int = STATE_ENTRIES, sent_values: int = SENT_VALUES,
) -> DataFrame:
    """Rows (keys, counts, one array per probability): linear quantiles of every entry's values, nulls left out.

    A null key is a key; rows without a vector are left out; an entry without
    values has null quantiles; no rows give no rows.
    """
    keys, names = list(keys), list(names)
    source = settle(rows.where(F.col(vector).isNotNull()).select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.col(vector).cast("array<double>").alias("vector")), "vectors")
    kinds = [f.dataType for f in source.schema.fields[:-1]]
    key_fields = [T.StructField(f"k{i}", kind) for i, kind in enumerate(kinds)]
    added = [T.StructField("position", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("n", "low", "high"))]
    bounds = source.mapInArrow(_bounds([to_arrow_type(k) for k in kinds]), T.StructType(key_fields + added))
    by = [f.name for f in key_fields]
    merged = settle(bounds.groupBy(*by, "position").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")), "vector-bounds")
    shape = T.StructType(
        [T.StructField(k, kind) for k, kind in zip(keys, kinds, strict=True)]
        + [T.StructField("counts", T.ArrayType(T.LongType())), *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in names)]
    )
    per_entry = 2 * len(probabilities)
    if merged.count() * per_entry > state_entries:
        return _ranked(source, by, keys, probabilities, names)
    bins = min(bins, max(LEAST_BINS, BIN_CELLS // max(1, merged.count())))
    states: dict[tuple, _State] = {}
    table = merged.orderBy(*by, "position").toArrow().combine_chunks()
    columns = {c: table.column(c).to_numpy() for c in ("n", "low", "high")}
    for key, places in key_places([_whole(table.column(c)) for c in by], table.num_rows):
        n = columns["n"][places]
        at = np.array(probabilities)[:, None] * (n - 1)
        ranks = np.concatenate([np.floor(at), np.ceil(at)]).astype(np.int64)
        states[key] = _State(n, columns["low"][places], columns["high"][places], ranks)
    while any(s.open().any() for s in states.values()):
        inside = sum(int(s.inside[s.open()].sum()) for s in states.values())
        _narrow(source, states, bins, inside <= sent_values)
    out = []
    for key, state in states.items():
        half = len(probabilities)
        low, high = _plain(state.low[:half]), _plain(state.low[half:])
        at = np.array(probabilities)[:, None] * (state.counts - 1)
        with np.errstate(invalid="ignore"):
            value = np.where(low == high, low, low + (high - low) * (at - np.floor(at)))
        held = state.counts > 0
        out.append((*key, state.counts.tolist(), *([v if h else None for v, h in zip(q, held.tolist(), strict=True)] for q in value.tolist())))
    return rows.sparkSession.createDataFrame(out, shape)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def _ranked(source: DataFrame, by: list[str], keys: list[str], probabilities: Sequence[float], names: list[str]) -> DataFrame:
    """The same by a row per entry, for more keys and entries than tasks can be sent brackets for."""
    entries = source.select(F.struct(*by).alias("key"), F.posexplode("vector").alias("position", "x"))
    found = exact_quantiles(entries, ["key", "position"], "x", probabilities, names)
    packed = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("position", "n", *names))).alias("items"))
    return packed.select(*[F.col(f"key.{b}").alias(k) for b, k in zip(by, keys, strict=True)], F.col("items.n").alias("counts"), *[F.col(f"items.{n}").alias(n) for n in names])
