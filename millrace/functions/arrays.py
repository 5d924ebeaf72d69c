"""Array expressions for fixed-layout feature vectors."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body``.

    An expression used inside an array lambda is evaluated for every item, even
    when it was a column of an earlier select, because Spark merges selects.
    Binding it to a lambda variable first avoids that.
    """
    return F.get(F.transform(F.array(value), lambda bound: body(bound)), F.lit(0))


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda total, item: total + item)


def array_mean(values: Column) -> Column:
    return F.try_divide(array_total(values), F.size(values))


def _middle(ordered: Column) -> Column:
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / F.lit(2.0)).cast("int"))
    high = F.get(ordered, F.floor(n / F.lit(2.0)).cast("int"))
    return F.when(n > 0, (low + high) / F.lit(2.0))


def sorted_median(ordered: Column) -> Column:
    """Median of an ascending array, linear between the two middle items; null when empty."""
    return let(ordered, _middle)


def median_and_deviation(values: Column) -> Column:
    """Struct of the median and the median absolute deviation of an unordered array."""

    def spread(ordered: Column) -> Column:
        return let(
            _middle(ordered),
            lambda m: F.struct(
                m.alias("median"), sorted_median(F.array_sort(F.transform(ordered, lambda v: F.abs(v - m)))).alias("mad")
            ),
        )

    return let(F.array_sort(values), spread)


def largest_items(values: Column, count: int) -> Column:
    """The ``count`` largest items as (value, position), ascending.

    Among equal values the later positions are kept.
    """

    def last(tagged: Column) -> Column:
        keep = F.least(F.lit(count), F.size(tagged))
        return F.slice(tagged, F.size(tagged) - keep + 1, keep)

    return let(
        F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("value"), i.alias("position")))), last
    )


def finite(value: Column) -> Column:
    """True for a non-null number that is neither NaN nor infinite."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def entrywise(compute: Callable[..., pa.Array], *arrays: pa.Array) -> pa.Array:
    """Inside a task: ``compute`` over the entries of arrays of doubles, null where one of a row's arrays ends early.

    Spark evaluates a lambda over every entry of every row, which takes far longer.
    """
    if not all(a.value_lengths().equals(arrays[0].value_lengths()) for a in arrays[1:]):
        rows = [None if None in row else row for row in zip(*(a.to_pylist() for a in arrays), strict=True)]
        widths = [0 if row is None else max(map(len, row)) for row in rows]
        arrays = [
            pa.array([None if row is None else row[i] + [None] * (w - len(row[i])) for row, w in zip(rows, widths, strict=True)], pa.list_(pa.float64()))
            for i in range(len(arrays))
        ]
    widths = arrays[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(widths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), compute(*(a.flatten() for a in arrays)), mask=arrays[0].is_null())
