"""Keys of Arrow rows inside tasks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa


def key_places(columns: Sequence[pa.Array], rows: int) -> Iterator[tuple[tuple, np.ndarray]]:
    """Every key that occurs, as a tuple with None for null, with the places of its rows in order."""
    if not rows:
        return
    codes, values = np.zeros(rows, dtype=np.int64), []
    for column in columns:
        coded = column.dictionary_encode(null_encoding="encode")
        values.append(coded.dictionary.to_pylist())
        codes = codes * len(values[-1]) + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(codes, kind="stable")
    for places in np.split(order, np.flatnonzero(np.diff(codes[order])) + 1):
        code, key = int(codes[places[0]]), []
        for known in reversed(values):
            code, digit = divmod(code, len(known))
            key.append(known[digit])
        yield tuple(reversed(key)), places
