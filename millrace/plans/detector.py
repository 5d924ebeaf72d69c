"""Fit, store, apply and evaluate the two-detector model.

Two families share the code. ``contextual`` fits one model set per asset class on
the channels that apply to it and scores the tail of normalised residuals.
``pooled`` fits one set for all windows, adds context features, and scores the mean
residual. State is a set of small tables keyed by ``group``.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.hashing import run_bucket
from millrace.operators.bymodel import apply_sent, once, sendable
from millrace.operators.calibration import (
    DEFAULT_THRESHOLD,
    Curve,
    calibrate,
    calibrated_threshold,
    ensemble,
    ensemble_weights,
    fit_curve,
    fused,
    normal_only,
    score_summary,
)
from millrace.operators.channels import (
    applicable_features,
    channel_intervals,
    chosen_statistics,
    class_channels,
    continuous_only,
    exclude_inputs,
    with_channel,
)
from millrace.operators.context import context_columns, context_vocabulary, encode_contexts, vocabulary_lists
from millrace.operators.convert import convert_units
from millrace.operators.explain import prediction_records
from millrace.operators.features import contains_anomaly, window_features
from millrace.operators.forest import fit_forest, isolation, isolation_scores, pack_forest
from millrace.operators.intervals import event_details, event_summary, label_windows, refuse_bad_intervals
from millrace.operators.joins import complete_lookup
from millrace.operators.metrics import by_detector, evaluate_windows
from millrace.operators.ranks import exact_quantiles
from millrace.operators.reconstruction import (
    apply_tail,
    fit_subspace,
    prepared_subspace,
    reconstruction_errors,
    residual_scales,
    row_error,
    row_totals,
    subspace_errors,
    tail_shares,
)
from millrace.operators.selection import refuse_leakage
from millrace.operators.vectors import (
    apply_scaler,
    class_vectors,
    fit_scaler,
    non_finite_vectors,
    pooled_vectors,
    refuse_unknown_classes,
)
from millrace.operators.windows import WindowPlan
from millrace.session import outliving, scratch_scope, settle

POOLED = "pooled"
WINDOW_ID = ["run_id", "asset_id", "window_start"]
DETECTORS = ("autoencoder", "isolation_forest", "irregularity")


@dataclass
class Options:
    family: str = "contextual"
    size: str = "15m"
    stride: str = "1m"
    tail: str = "legacy"
    families: dict[str, bool] = field(default_factory=dict)
    compact: bool = False
    exclude_signal_classes: list[str] = field(default_factory=list)
    exclude_measurement_roles: list[str] = field(default_factory=list)
    canonical_units: dict[str, str] = field(default_factory=dict)
    split_group: str = "run_id"
    scaler: str = "robust"
    latent: int = 16
    trees: int = 300
    max_samples: int | float | None = None
    max_features: float = 1.0
    top_k: int = 4
    residual_quantile: float = 0.95
    residual_floor: float = 1e-8
    calibration_quantile: float = 0.99
    decision_threshold: float = DEFAULT_THRESHOLD
    autoencoder_weight: float = 0.5
    isolation_weight: float = 0.5
    early_stop_modulo: int = 5
    calibration_modulo: int = 2
    min_partition_windows: int = 20
    seed: int = 42
    model_version: str = "0.1.0"

    @property
    def plan(self) -> WindowPlan:
        return WindowPlan.of(self.size, self.stride, self.tail)

    @property
    def statistics(self) -> list[str]:
        return list(chosen_statistics(self.families, self.compact))


@dataclass
class Model:
    options: Options
    channels: list[str]
    intervals: dict[str, float]
    vocabulary: dict[str, list[str]]
    threshold: float
    tables: dict[str, DataFrame]
    metrics: DataFrame | None = None


def prepare_rows(rows: DataFrame, options: Options) -> DataFrame:
    """Unit conversion and exclusions, as both fitting and scoring need them."""
    return exclude_inputs(
        convert_units(rows, options.canonical_units), options.exclude_signal_classes, options.exclude_measurement_roles
    )


def build_windows(rows: DataFrame, options: Options, channels=None, intervals=None, vocabulary=None) -> DataFrame:
    features = window_features(
        prepare_rows(rows, options), options.plan, channels, intervals,
        {**options.families},
    )
    return encode_contexts(features, vocabulary) if vocabulary is not None else features


def vectorise(windows: DataFrame, model: Model) -> DataFrame:
    """Windows with ``group`` and ``vector``, and per-class ``channels``. Names follow in ``named``, so that no table repeats them in every row."""
    statistics = model.options.statistics
    if model.options.family == "contextual":
        out = class_vectors(windows, model.tables["channels"], statistics).withColumn("group", F.col("asset_class"))
    else:
        extra = context_columns(model.vocabulary)
        out = pooled_vectors(windows, model.channels, statistics, extra).withColumn("group", F.lit(POOLED))
    return out.drop("names")


def named(rows: DataFrame, model: Model) -> DataFrame:
    """Add ``names`` of the vector entries, and ``channels`` if they are the same in every row."""
    statistics = model.options.statistics
    if model.options.family == "contextual":
        return rows.withColumn("names", applicable_features(F.col("channels"), statistics))
    names = [f"{c}_{s}" for c in model.channels for s in statistics] + context_columns(model.vocabulary)
    return rows.withColumn("names", F.array(*[F.lit(n) for n in names])).withColumn("channels", F.array(*[F.lit(c) for c in model.channels]))


def reconstructed(vectors: DataFrame, model: Model) -> DataFrame:
    """Add ``errors`` (explanation basis) and ``autoencoder_raw``; ``vector`` is scaled, ``raw_vector`` is as it came."""
    t = model.tables
    rows = apply_scaler(vectors.withColumn("raw_vector", F.col("vector")), t["scaler"], ["group"])
    rows = reconstruction_errors(rows, t["subspace"], "group")
    if model.options.family == "contextual":
        rows = apply_tail(rows, t["scales"], "group", model.options.top_k)
        return rows.withColumn("autoencoder_raw", F.col("tail.score")).withColumn("errors", F.col("tail.contributions")).drop("tail")
    return rows.withColumn("autoencoder_raw", row_error(F.col("errors")))


RAW = {"errors": "array<double>", "autoencoder_raw": "double", "isolation_raw": "double"}


def raw_scores(vectors: DataFrame, model: Model, wanted: Sequence[str] = tuple(RAW)) -> DataFrame:
    """Add ``errors`` (explanation basis), ``autoencoder_raw`` and ``isolation_raw``, or those of them that are ``wanted``.

    While the fitted tables are small, one Python worker takes a task's vectors
    through all steps; step after step, each would have a worker of its own and
    pass the vectors on.
    """
    t, top_k = model.tables, model.options.top_k
    parts = ["scaler", "subspace", "forest", *(["scales"] if model.options.family == "contextual" else [])]
    if not sendable([t[p] for p in parts]):
        return isolation_scores(reconstructed(vectors, model), t["forest"], "group").withColumnRenamed("isolation", "isolation_raw")

    def send() -> Broadcast:
        frames = {p: dict(list(t[p].toPandas().groupby("group", sort=False))) for p in parts}
        state = {}
        for group, scaler in frames["scaler"].items():
            # A list with gaps becomes an array of objects; as numbers they are NaN.
            center, spread = (np.array(scaler[c].iloc[0], dtype=float) for c in ("center", "spread"))
            scale = np.array(frames["scales"][group]["scale"].iloc[0], dtype=float) if "scales" in frames else None
            state[group] = center, spread, prepared_subspace(frames["subspace"][group]), scale, pack_forest(frames["forest"][group])
        return vectors.sparkSession.sparkContext.broadcast(state)

    def steps(state: tuple, x: np.ndarray) -> dict[str, np.ndarray]:
        center, spread, subspace, scale, forest = state
        scaled = (x - center) / spread
        found = {}
        if "errors" in wanted or "autoencoder_raw" in wanted:
            errors = subspace_errors(subspace, scaled)
            if scale is None:
                found = {"errors": errors, "autoencoder_raw": row_totals(errors) / max(1, errors.shape[1])}
            else:
                ratio = errors / scale
                share, _ = tail_shares(ratio, ratio, top_k)
                found = {"errors": share, "autoencoder_raw": row_totals(share)}
        if "isolation_raw" in wanted:
            found["isolation_raw"] = isolation(forest, scaled)
        return found

    shared = once(t["forest"], f"prepared-{'-'.join(parts)}", send)
    # Rows of a group without a scaler leave before they are scored; the scaled vector is made where it is read.
    known = vectors.filter(F.col("group").isin(sorted(shared.value)))
    rows = apply_scaler(known.withColumn("raw_vector", F.col("vector")), t["scaler"], ["group"])
    kind = f"struct<{','.join(f'{c}:{RAW[c]}' for c in wanted)}>"
    out = apply_sent(rows, shared, "group", steps, "_raw", kind, "raw_vector")
    return out.select("*", "_raw.*").drop("_raw")


def curves(references: DataFrame) -> dict[str, Curve]:
    """The reference curve of each detector."""

    def fit(detector: str, raw: str) -> Curve:
        return fit_curve(references.filter(F.col("detector") == detector).select("group", F.col("raw").alias(raw)), ["group"], raw)

    return {d: once(references, f"curve-{d}", lambda: fit(d, raw)) for d, raw in (("autoencoder", "autoencoder_raw"), ("isolation_forest", "isolation_raw"))}


def calibrated(raw: DataFrame, references: DataFrame, options: Options) -> DataFrame:
    """Add the three calibrated scores."""
    known = curves(references)
    out = calibrate(raw, known["autoencoder"], ["group"], "autoencoder_raw", "autoencoder")
    out = calibrate(out, known["isolation_forest"], ["group"], "isolation_raw", "isolation_forest")
    weights = ensemble_weights(options.autoencoder_weight, options.isolation_weight)
    return out.withColumn("irregularity", ensemble(F.col("autoencoder"), F.col("isolation_forest"), weights))


def references_of(raw: DataFrame) -> DataFrame:
    both = F.explode(
        F.array(
            F.struct(F.lit("autoencoder").alias("detector"), F.col("autoencoder_raw").alias("raw")),
            F.struct(F.lit("isolation_forest").alias("detector"), F.col("isolation_raw").alias("raw")),
        )
    )
    return raw.select("group", both.alias("_r")).select("group", "_r.*")


def _require_windows(parts: dict[str, DataFrame], least: int) -> None:
    """Every group needs enough windows in every part."""
    counts: dict[str, dict[str, int]] = {}
    for name, part in parts.items():
        for row in part.groupBy("group").count().collect():
            counts.setdefault(row["group"], {})[name] = row["count"]
    short = {g: c for g, c in counts.items() if any(c.get(name, 0) < least for name in parts)}
    if short:
        raise ValueError(f"Insufficient windows (need {least} in each of {list(parts)}): {short}")


def fit_model(train: DataFrame, validation: DataFrame, options: Options) -> Model:
    """Fit on normal training telemetry, calibrate on normal validation telemetry."""
    if options.family not in ("contextual", POOLED):
        raise ValueError("family must be contextual or pooled")
    refuse_leakage(train, validation, options.split_group)
    prepared = with_channel(continuous_only(prepare_rows(train, options)))
    channels = sorted(r[0] for r in prepared.select("channel").distinct().collect())
    intervals = (
        {r["channel"]: r["median_interval_ms"] for r in channel_intervals(prepared).collect()}
        if "sampling_interval_ms" in prepared.columns
        else {}
    )
    spark = train.sparkSession
    # Tables as large as the windows go as soon as no later step reads them; what is fitted stays.
    with scratch_scope(spark) as fitting:
        model, raw, reference = _fitted(train, validation, prepared, channels, intervals, options, fitting)
    t = model.tables
    t["references"] = settle(references_of(reference), "references")
    if options.family == "contextual":
        own = calibrated(reference, t["references"], options)
        model.threshold = calibrated_threshold(own, "irregularity", options.calibration_quantile)
    scored = settle(calibrated(raw, t["references"], options), "scored")
    t["summary"] = score_summary(scored, DETECTORS)
    t["raw_p99"] = exact_quantiles(t["references"], ["group", "detector"], "raw", [0.99], ["raw_p99"])
    if "is_anomaly" in scored.columns:
        model.metrics = evaluate(scored, model)
    return model


def _settled_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str, outlives: list[str] | None = None) -> DataFrame:
    """Write what ``make`` returns and remove the tables that it was made from."""
    with scratch_scope(spark) as steps:
        made = make()
        with outliving(steps if outlives is None else outlives):
            return settle(made, label)


def _fitted(
    train: DataFrame, validation: DataFrame, prepared: DataFrame, channels: list[str], intervals: dict[str, float], options: Options, fitting: list[str]
) -> tuple[Model, DataFrame, DataFrame]:
    """A model without references, and the raw scores of development and reference windows; they outlive the scope ``fitting``."""
    spark = train.sparkSession
    contextual = options.family == "contextual"
    with scratch_scope(spark) as building:
        tr = _settled_alone(spark, lambda: build_windows(train, options, channels, intervals), "train-windows")
        va = _settled_alone(spark, lambda: build_windows(validation, options, channels, intervals), "validation-windows")
        if "is_anomaly" in tr.columns and contains_anomaly(tr):
            raise ValueError("The training partition must hold normal windows only")
        vocabulary = vocabulary_lists(context_vocabulary(tr)) if {"asset_class", "operating_regime"} & set(tr.columns) else {}
        tr, va = encode_contexts(tr, vocabulary), encode_contexts(va, vocabulary)
        model = Model(options, channels, intervals, vocabulary, options.decision_threshold, {})
        if "asset_class" in prepared.columns:
            model.tables["channels"] = _settled_alone(spark, lambda: class_channels(prepared), "channels", fitting)
        if contextual:
            if "asset_class" not in tr.columns or "is_anomaly" not in va.columns:
                raise ValueError("Contextual fitting needs asset_class and labelled validation windows")
            refuse_unknown_classes(va, model.tables["channels"])
        described = [*WINDOW_ID, "window_end", "is_anomaly", "event_id", "event_start_us", "group", "vector"]

        def vectors_of(windows: DataFrame, label: str) -> DataFrame:
            rows = vectorise(windows, model)
            return settle(rows.select(*[c for c in described if c in rows.columns]), label)

        with outliving(building):
            all_validation = vectors_of(va, "validation-vectors")
            train_rows = vectors_of(tr, "train-vectors")
    if contextual:
        early = run_bucket("run_id", options.early_stop_modulo)
        held = run_bucket("run_id", options.calibration_modulo)
        fit, stop = train_rows.filter(early != 0), train_rows.filter(early == 0)
        calibration = normal_only(all_validation.filter(held == 0))
        development = all_validation.filter(held != 0)
        if development.limit(1).isEmpty():
            raise ValueError("The whole-run split left no development windows")
        _require_windows({"fit": fit, "early_stop": stop, "calibration": calibration}, options.min_partition_windows)
    else:
        fit, calibration, development = train_rows, normal_only(all_validation), all_validation
        stop = calibration
    if not non_finite_vectors(fit).limit(1).isEmpty():
        raise ValueError("Training features must be finite")
    t = model.tables
    t["scaler"] = _settled_alone(spark, lambda: fit_scaler(fit, ["group"], options.scaler), "scaler", fitting)
    fit_scaled = apply_scaler(fit, t["scaler"], ["group"])
    t["subspace"] = _settled_alone(spark, lambda: fit_subspace(fit_scaled, options.latent, "group"), "subspace", fitting)
    t["forest"] = _settled_alone(
        spark, lambda: fit_forest(fit_scaled, WINDOW_ID, "group", options.trees, options.max_samples, options.max_features, options.seed), "forest", fitting
    )
    if contextual:
        residuals = reconstruction_errors(apply_scaler(stop, t["scaler"], ["group"]), t["subspace"], "group")
        t["scales"] = _settled_alone(
            spark, lambda: residual_scales(residuals, "group", options.residual_quantile, options.residual_floor), "scales", fitting
        )
    # Every window is scored once, and kept without the arrays that no later step reads.
    marks = ["autoencoder_raw", "isolation_raw"]
    kept = ["group", *marks, *[c for c in ("is_anomaly", "event_id", "event_start_us", "window_end") if c in all_validation.columns]]
    with outliving(fitting):
        raw = settle(raw_scores(development, model, marks).select(*kept), "raw")
        reference = settle(raw_scores(calibration, model, marks).select(*kept), "reference") if contextual else normal_only(raw)
    return model, raw, reference


def score(rows: DataFrame, model: Model, tail: str | None = None) -> DataFrame:
    """Scored windows of new telemetry; settle what is read more than once."""
    options = model.options if tail is None else Options(**{**asdict(model.options), "tail": tail})
    windows = build_windows(rows, options, model.channels, model.intervals, model.vocabulary)
    return score_windows(windows, model)


def score_windows(windows: DataFrame, model: Model) -> DataFrame:
    """Windows with their vectors, errors and scores.

    No table of vectors or errors is written: they are many times as large as
    the statistics that they are made from. Scored rows stay where they are
    unless a reference curve is too large to be sent to them; then the numbers
    of the rows and their raw scores alone go to its ranges.
    """
    moved = any(curve.points is not None for curve in curves(model.tables["references"]).values())
    if moved:
        windows = windows.withColumn("_window", F.monotonically_increasing_id())
    if model.options.family == "contextual" or moved:
        windows = settle(windows, "windows")
    if model.options.family == "contextual":
        refuse_unknown_classes(windows, model.tables["channels"])
    if not moved:
        return named(calibrated(raw_scores(vectorise(windows, model), model), model.tables["references"], model.options), model)
    marks = ["autoencoder_raw", "isolation_raw"]
    raw = settle(raw_scores(vectorise(windows, model), model, marks).select("_window", "group", *marks), "raw")
    moved_back = calibrated(raw, model.tables["references"], model.options).drop("group")
    # They come back to the statistics, which are small; vectors and errors are made after that.
    scored = windows.join(moved_back, "_window").drop("_window")
    return named(raw_scores(vectorise(scored, model), model, ["errors"]), model)


def with_supplement(scored: DataFrame, supplement: DataFrame, name: str = "fused") -> DataFrame:
    """Add the larger of the main score and a second model's reconstruction score, window by window.

    A supplement fitted on value statistics only is a model whose options switch
    the quality and sampling families off. Every window must be in both.
    """
    other = supplement.withColumnRenamed("autoencoder", "_supplement")
    joined = complete_lookup(scored, other, WINDOW_ID, "_supplement")
    return joined.withColumn(name, fused(F.col("irregularity"), F.col("_supplement"))).drop("_supplement")


def predict(rows: DataFrame, model: Model, tail: str | None = None) -> DataFrame:
    """Explained prediction records of new telemetry."""
    scored = score(rows, model, tail)
    applicable = model.tables.get("channels")
    if applicable is not None:
        applicable = applicable.withColumnRenamed("channels", "applicable")
    extra = {}
    if (tail or model.options.tail) == "complete":
        extra["window_tail_policy"] = F.lit("complete")
    if model.options.family == "contextual":
        extra["contribution_basis"] = F.lit("share of top-k normalized squared reconstruction error")
    return prediction_records(
        scored, model.options.statistics, model.threshold, applicable, model.options.model_version, extra=extra
    )


def evaluate(scored: DataFrame, model: Model, label: str = "is_anomaly") -> DataFrame:
    """Window metrics of both detectors and the ensemble."""
    keep = [c for c in (label, "event_id", "event_start_us", "window_end") if c in scored.columns]
    long = by_detector(scored.select(*keep, *DETECTORS), DETECTORS)
    return evaluate_windows(
        long, ["detector"], "score", model.threshold, label,
        window_seconds=model.options.plan.stride_us / 1e6, with_events="event_id" in scored.columns,
    )


def evaluate_against_events(scored: DataFrame, events: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Window metrics with labels from event intervals, and interval metrics per detector."""
    refuse_bad_intervals(events)
    labelled = settle(label_windows(scored, events), "labelled")
    windows = evaluate(labelled, model, "overlaps_event")
    parts = None
    for name in DETECTORS:
        one = event_summary(event_details(events, labelled, name, model.threshold)).withColumn("detector", F.lit(name))
        parts = one if parts is None else parts.unionByName(one)
    return windows, parts


def save_model(model: Model, path: str) -> None:
    """Tables as Parquet, the rest as one JSON line."""
    spark = next(iter(model.tables.values())).sparkSession
    for name, table in model.tables.items():
        table.write.mode("errorifexists").parquet(f"{path}/{name}")
    note = {
        "options": asdict(model.options), "channels": model.channels, "intervals": model.intervals,
        "vocabulary": model.vocabulary, "threshold": model.threshold, "tables": sorted(model.tables),
    }
    spark.createDataFrame([(json.dumps(note),)], "value string").coalesce(1).write.text(f"{path}/model")


def load_model(spark: SparkSession, path: str) -> Model:
    note = json.loads(spark.read.text(f"{path}/model").first()[0])
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in note["tables"]}
    return Model(
        Options(**note["options"]), note["channels"], note["intervals"], note["vocabulary"], note["threshold"], tables
    )
