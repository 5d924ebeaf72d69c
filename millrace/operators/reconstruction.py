"""Reconstruction detector: a linear autoencoder per key, i.e. its leading principal subspace."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.arrays import entrywise
from millrace.operators.bymodel import apply_models
from millrace.operators.vector_quantiles import vector_quantiles
from millrace.operators.vectors import CLASS

LATENT = 16
TOP_K = 4
RESIDUAL_QUANTILE = 0.95
RESIDUAL_FLOOR = 1e-8


def fit_subspace(rows: DataFrame, latent: int = LATENT, key: str = CLASS, vector: str = "vector") -> DataFrame:
    """Mean and leading directions per key.

    Each task sums its rows into one small moment matrix per key; the sums are
    added per matrix row, and a key's matrix (as wide as its vector) is
    decomposed in one task.
    """

    def partial(batches):
        sums: dict = {}
        for pdf in batches:
            for value, group in pdf.groupby(key, sort=False):
                x = np.vstack(group[vector].to_numpy())
                n, s, g = sums.get(value, (0, 0.0, 0.0))
                sums[value] = (n + len(x), s + x.sum(axis=0), g + x.T @ x)
        for value, (n, s, g) in sums.items():
            yield pd.DataFrame(
                {key: value, "position": np.arange(len(s)), "n": n, "total": s, "products": list(g)}
            )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        head = pdf.iloc[0]
        return pd.DataFrame(
            {
                key: [head[key]],
                "position": [head["position"]],
                "n": [pdf["n"].sum()],
                "total": [pdf["total"].sum()],
                "products": [np.vstack(pdf["products"].to_numpy()).sum(axis=0)],
            }
        )

    def decompose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        n = float(pdf["n"].iloc[0])
        mean = pdf["total"].to_numpy() / n
        covariance = np.vstack(pdf["products"].to_numpy()) / n - np.outer(mean, mean)
        _, directions = np.linalg.eigh((covariance + covariance.T) / 2)
        kept = max(2, min(latent, len(mean)))
        basis = directions[:, ::-1][:, :kept].T
        # A direction is only defined up to its sign: make its largest entry positive.
        lead = basis[np.arange(len(basis)), np.abs(basis).argmax(axis=1)]
        basis = basis * np.where(lead < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame(
            {key: [pdf[key].iloc[0]], "rows": [int(n)], "mean": [mean.tolist()], "basis": [[b.tolist() for b in basis]]}
        )

    kind = rows.schema[key].dataType.simpleString()
    sums = f"`{key}` {kind}, position int, n bigint, total double, products array<double>"
    moments = rows.select(key, vector).mapInPandas(partial, sums)
    added = moments.groupBy(key, "position").applyInPandas(add, sums)
    return added.groupBy(key).applyInPandas(
        decompose, f"`{key}` {kind}, rows bigint, mean array<double>, basis array<array<double>>"
    )


def subspace_errors(model: tuple[np.ndarray, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Squared difference between vectors and their projection."""
    mean, basis = model
    centred = x - mean
    return (centred - centred @ basis.T @ basis) ** 2


def prepared_subspace(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and directions from the row of one key."""
    row = pdf.iloc[0]
    return np.asarray(row["mean"], dtype=float), np.vstack([np.asarray(b, dtype=float) for b in row["basis"]])


def reconstruction_errors(rows: DataFrame, subspaces: DataFrame, key: str = CLASS, vector: str = "vector", **options) -> DataFrame:
    """Add ``errors``: squared reconstruction error per entry."""
    return apply_models(
        rows, subspaces, key, prepared_subspace, subspace_errors, "errors", "array<double>", vector, **options
    )


def row_error(errors: Column) -> Column:
    """Plain row score: mean error over entries."""

    @F.arrow_udf("double")
    def mean(errors: pa.Array) -> pa.Array:
        out, missing = np.zeros(len(errors)), np.ones(len(errors), dtype=bool)
        for places, x, null in _of_one_width(errors):
            if x.shape[1]:
                out[places], missing[places] = row_totals(x) / x.shape[1], null.any(axis=1)
        return pa.array(out, mask=missing)

    return mean(errors.cast("array<double>"))


def _of_one_width(rows: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Arrays that are not null, by width: their places, their entries as a matrix, and which entries are null."""
    widths = rows.value_lengths().fill_null(-1).to_numpy()
    for width in np.unique(widths[widths >= 0]):
        places = np.flatnonzero(widths == width)
        flat = (rows if len(places) == len(rows) else rows.take(pa.array(places))).flatten()
        x = flat.to_numpy(zero_copy_only=False).astype(float, copy=False)
        yield places, x.reshape(len(places), width), flat.is_null().to_numpy(zero_copy_only=False).reshape(len(places), width)


def row_totals(x: np.ndarray) -> np.ndarray:
    """Sums of rows, added from first to last as a fold does."""
    return np.cumsum(x, axis=1)[:, -1] + 0.0 if x.shape[1] else np.zeros(len(x))


def tail_shares(order: np.ndarray, ratio: np.ndarray, top_k: int) -> tuple[np.ndarray, np.ndarray]:
    """What the ``top_k`` entries of a row that are largest by ``order`` add to its score, else zero, and which they are."""
    last = np.argsort(order, axis=1, kind="stable")[:, -top_k:]
    kept = np.zeros(ratio.shape, dtype=bool)
    np.put_along_axis(kept, last, True, axis=1)
    return np.where(kept, ratio / max(1, last.shape[1]), 0.0), kept


def residual_scales(rows: DataFrame, key: str = CLASS, quantile: float = RESIDUAL_QUANTILE, floor: float = RESIDUAL_FLOOR) -> DataFrame:
    """Upper quantile of each entry's error on held-out normal rows, never below the floor."""
    if not 0 < quantile < 1 or not 0 < floor < float("inf"):
        raise ValueError("The residual quantile must lie inside (0, 1) and the floor be positive")
    found = vector_quantiles(rows, [key], "errors", [quantile], ["scale"])
    return found.select(key, F.transform("scale", lambda s: F.greatest(s, F.lit(floor))).alias("scale"))


def tail_score(errors: Column, scale: Column, top_k: int = TOP_K) -> Column:
    """Struct of ``score`` (mean of the largest normalised errors) and additive ``contributions``; of equal ones the later count."""
    if top_k < 1:
        raise ValueError("top_k must be positive")

    @F.arrow_udf("struct<score:double,contributions:array<double>>")
    def mark(errors: pa.Array, scale: pa.Array) -> pa.Array:
        ratios = entrywise(pc.divide, errors, scale)
        score, missing = np.zeros(len(ratios)), np.ones(len(ratios), dtype=bool)
        found, order = [], []
        for places, ratio, null in _of_one_width(ratios):
            # Missing ratios are below all others.
            share, kept = tail_shares(np.where(null, -np.inf, ratio), ratio, top_k)
            score[places], missing[places] = row_totals(share), (kept & null).any(axis=1)
            ends = np.arange(len(places) + 1, dtype=np.int32) * np.int32(ratio.shape[1])
            found.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(share.ravel(), mask=(kept & null).ravel())))
            order.append(places)
        back = np.zeros(len(ratios), dtype=np.int64)
        if order:
            back[np.concatenate(order)] = np.arange(sum(map(len, order)))
        absent = ratios.is_null()
        shares = pa.concat_arrays(found) if found else pa.array([], pa.list_(pa.float64()))
        shares = shares.take(pa.array(back, mask=absent.to_numpy(zero_copy_only=False)))
        return pa.StructArray.from_arrays([pa.array(score, mask=missing), shares], ["score", "contributions"])

    return mark(errors.cast("array<double>"), scale.cast("array<double>"))


def apply_tail(rows: DataFrame, scales: DataFrame, key: str = CLASS, top_k: int = TOP_K) -> DataFrame:
    """Add ``tail`` (score and contributions) from ``errors`` and per-key scales."""
    return rows.join(scales.select(key, "scale"), key).withColumn(
        "tail", tail_score(F.col("errors"), F.col("scale"), top_k)
    ).drop("scale")
