"""Detector variants side by side: several representations, each with several scores, in one set of passes.

A representation says which entries of a vector count, how they are scaled, and
whether all classes share a model. Every row appears once for each of them,
under the key ``unit`` (representation and class), and all fits and scores run
by that key, so five representations cost as many jobs as one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.calibration import calibrate, ensemble, ensemble_weights, fit_curve, fused, normal_quantile
from millrace.operators.forest import fit_forest, isolation_scores
from millrace.operators.joins import complete_lookup
from millrace.operators.reconstruction import apply_tail, fit_subspace, reconstruction_errors, residual_scales, row_error
from millrace.operators.vectors import CLASS, apply_scaler, fit_scaler
from millrace.session import settle

# Scores of a representation, in output order.
SCORES = ("mean_ae", "tail_ae", "isolation", "mean_ensemble", "tail_ensemble")


@dataclass(frozen=True)
class Representation:
    """``keep`` tells from an entry's position, from 0, whether it counts; without it all do."""

    name: str
    by_class: bool
    scaler: str
    keep: Callable[[Column], Column] | None = None


def _entries(vector: Column, keep: Callable[[Column], Column] | None) -> Column:
    return F.filter(vector, lambda _, i: keep(i)) if keep else vector


def represented(rows: DataFrame, representations: Sequence[Representation], vector: str = "vector") -> DataFrame:
    """Every row once for each representation, with ``representation``, ``unit``, ``scaler`` and its own vector."""
    layouts = []
    for r in representations:
        kept = _entries(F.col(vector), r.keep)
        unit = F.concat_ws("/", F.lit(r.name), F.col(CLASS)) if r.by_class else F.lit(r.name)
        layouts.append(F.struct(F.lit(r.name).alias("representation"), unit.alias("unit"), F.lit(r.scaler).alias("scaler"), kept.alias(vector)))
    others = [c for c in rows.columns if c != vector]
    return rows.select(*others, F.explode(F.array(*layouts)).alias("_r")).select(*others, "_r.*")


def score_representations(
    rows: DataFrame,
    identity: Sequence[str],
    fit: Column,
    stop: Column,
    reference: Column,
    latent: int = 8,
    trees: int = 200,
    top_k: int = 4,
    detectors: Callable[[DataFrame], DataFrame] | None = None,
    digits: int | None = None,
) -> DataFrame:
    """Add the five calibrated scores to represented rows.

    Models are fitted on the rows where ``fit`` holds, residuals scaled on
    ``stop``, and scores calibrated on ``reference``. ``detectors`` may replace
    the subspace and the forest: it adds ``errors`` and ``isolation_raw`` to
    scaled rows. ``digits`` rounds raw scores, which then tie alike everywhere.
    """
    rows = settle(rows.withColumn("_fit", fit).withColumn("_stop", stop).withColumn("_reference", reference), "represented")
    scalers = [fit_scaler(rows.filter(F.col("_fit") & (F.col("scaler") == kind)), ["unit"], kind) for kind in ("robust", "standard")]
    scaled = settle(apply_scaler(rows, scalers[0].unionByName(scalers[1]), ["unit"]), "represented-scaled")
    if detectors is None:
        fitted = scaled.filter("_fit")
        forest = settle(fit_forest(fitted, identity, "unit", trees), "forests")
        found = reconstruction_errors(scaled, settle(fit_subspace(fitted, latent, "unit"), "subspaces"), "unit")
        found = isolation_scores(found, forest, "unit").withColumnRenamed("isolation", "isolation_raw")
    else:
        found = detectors(scaled)
    found = settle(found, "detected")
    tails = apply_tail(found, residual_scales(found.filter("_stop"), "unit"), "unit", top_k)
    exact = (lambda c: F.round(c, digits)) if digits is not None else (lambda c: c)
    raw = settle(
        tails.withColumn("mean_raw", exact(row_error(F.col("errors")))).withColumn("tail_raw", exact(F.col("tail.score")))
        .withColumn("isolation_raw", exact(F.col("isolation_raw"))).drop("tail", "errors", "vector"),
        "raw-scores",
    )
    out = raw
    for source, name in (("mean_raw", "mean_ae"), ("tail_raw", "tail_ae"), ("isolation_raw", "isolation")):
        out = calibrate(out, fit_curve(raw.filter("_reference"), ["unit"], source), ["unit"], source, name)
    halves = ensemble_weights(1, 1)
    for kind in ("mean", "tail"):
        out = out.withColumn(f"{kind}_ensemble", ensemble(F.col(f"{kind}_ae"), F.col("isolation"), halves))
    return out


def long_scores(scored: DataFrame, identity: Sequence[str]) -> DataFrame:
    """Rows (identity, representation, score_name, score, reference): one for each representation and score of a row."""
    pairs = F.explode(F.array(*[F.struct(F.lit(s).alias("score_name"), F.col(s).alias("score")) for s in SCORES])).alias("_s")
    return scored.select(*identity, "representation", F.col("_reference").alias("reference"), pairs).select(*identity, "representation", "reference", "_s.*")


def frozen_cuts(scores: DataFrame, quantile: float = 0.995) -> DataFrame:
    """The cut of each representation and score on its reference rows; alerts are strictly above it."""
    return normal_quantile(scores.filter("reference"), "score", quantile, ["representation", "score_name"])


def with_frozen_supplement(scored: DataFrame, identity: Sequence[str], main: tuple[str, str], supplement: tuple[str, str], name: str = "fused") -> DataFrame:
    """Rows (identity, main, supplement, fused): the larger of two representations' scores, each calibrated on its own references.

    A row that only one of them has fails the job.
    """

    def one(choice: tuple[str, str], as_name: str) -> DataFrame:
        return scored.filter(F.col("representation") == choice[0]).select(*identity, F.col(choice[1]).alias(as_name))

    both = complete_lookup(one(main, "main"), one(supplement, "supplement"), list(identity), "supplement")
    return both.withColumn(name, fused(F.col("main"), F.col("supplement")))
