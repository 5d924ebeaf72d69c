"""Queries over scaling, detectors, calibration, explanations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.hashing import run_bucket
from millrace.operators.calibration import calibrate, ensemble, ensemble_weights, fused, normal_only, normal_quantile
from millrace.operators.channels import STATISTICS, VALUE_STATISTICS, class_channels, with_channel
from millrace.operators.context import encode_contexts
from millrace.operators.explain import prediction_records
from millrace.operators.features import long, window_features
from millrace.operators.forest import draw_samples, fit_forest, isolation_scores
from millrace.operators.ranks import exact_quantiles
from millrace.operators.reconstruction import apply_tail, fit_subspace, reconstruction_errors, residual_scales, row_error
from millrace.operators.vectors import (
    apply_scaler,
    center_by_regime,
    class_vectors,
    exploded,
    fit_regimes,
    fit_scaler,
    non_finite_vectors,
    pooled_vectors,
    unknown_classes,
)
from millrace.operators.windows import WindowPlan
from millrace.plans.detector import Options, fit_model, predict
from millrace.plans.registry import registered
from millrace.plans.variants import Representation, frozen_cuts, long_scores, represented, score_representations, with_frozen_supplement
from millrace.plans.views import SCORED, TELEMETRY, VECTORS, rounded, scored_windows, shaped, sql_rounded, table, telemetry, vectors, with_sql
from millrace.plans.window_queries import CHANNELS, COMPLETE, DEFAULTS, KNOWN, channel_sql
from millrace.session import scratch_path, settle
from millrace.streaming.silence import silent_assets
from millrace.streaming.windows import closed_windows, fresh_observations, run_available

ROBUST = """scaler AS (SELECT asset_class, position, median(x) AS center, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS spread FROM entries GROUP BY ALL),
scaled AS (SELECT e.*, (x - center) / CASE WHEN spread = 0 THEN 1.0 ELSE spread END AS z FROM entries e JOIN scaler USING (asset_class, position))"""
STANDARD = ROBUST.replace("median(x)", "avg(x)").replace("quantile_cont(x, 0.75) - quantile_cont(x, 0.25)", "stddev_pop(x)")


def scaled_rows(spark, sf, kind="robust"):
    v = vectors(spark, sf)
    return apply_scaler(v, fit_scaler(v, kind=kind))


def scaled_entries(spark, sf, kind):
    out = exploded(scaled_rows(spark, sf, kind), ["vec_id"])
    return out.select("vec_id", F.col("position").cast("bigint").alias("position"), rounded("x").alias("z"))


@registered("robust_scaling", with_sql([VECTORS, ROBUST], f"SELECT vec_id, position, {sql_rounded('z')} AS z FROM scaled"))
def robust(spark, sf):
    return scaled_entries(spark, sf, "robust")


@registered("standard_scaling", with_sql([VECTORS, STANDARD], f"SELECT vec_id, position, {sql_rounded('z')} AS z FROM scaled"))
def standard(spark, sf):
    return scaled_entries(spark, sf, "standard")


@registered(
    "non_finite_vectors",
    with_sql([VECTORS], "SELECT vec_id FROM vectors WHERE vec_id % 7 = 0 OR vec_id % 11 = 0"),
)
def broken_vectors(spark, sf):
    bad = F.when(F.col("vec_id") % 7 == 0, F.lit(float("nan"))).when(F.col("vec_id") % 11 == 0, F.lit(float("inf"))).otherwise(0.0)
    v = vectors(spark, sf).withColumn("vector", F.concat("vector", F.array(bad)))
    return non_finite_vectors(v).select("vec_id")


@registered("untrained_classes", with_sql([VECTORS], "SELECT DISTINCT asset_class FROM vectors WHERE asset_class NOT IN ('class-0', 'class-2')"))
def new_classes(spark, sf):
    v = vectors(spark, sf)
    return unknown_classes(v, v.filter(F.col("asset_class").isin("class-0", "class-2")).select("asset_class").distinct())


def bucket_sql(modulo: int, column: str = "run_id") -> str:
    return f"('0x' || substr(sha256({column}), 1, 8))::BIGINT % {modulo}"


FIT_STOP = f"""residual AS (SELECT *, z * z AS e, {bucket_sql(5)} = 0 AS stop FROM scaled),
scales AS (SELECT asset_class, position, greatest(quantile_cont(e, 0.95), 1e-8) AS scale FROM residual WHERE stop GROUP BY ALL),
ratios AS (SELECT r.asset_class, r.vec_id, r.run_id, r.position, r.e / s.scale AS ratio FROM residual r JOIN scales s USING (asset_class, position)),
top AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ratio DESC, position DESC) AS rn FROM ratios),
tails AS (SELECT asset_class, run_id, vec_id, sum(ratio) / 4 AS score FROM top WHERE rn <= 4 GROUP BY ALL)"""


def squared(spark, sf):
    """Squared scaled entries stand in for reconstruction errors, so that SQL can follow."""
    return scaled_rows(spark, sf).withColumn("errors", F.transform("vector", lambda z: z * z))


def tail_rows(spark, sf):
    e = settle(squared(spark, sf), "errors")
    return apply_tail(e, residual_scales(e.filter(run_bucket("run_id", 5) == 0)))


@registered(
    "residual_scales",
    with_sql([VECTORS, ROBUST, FIT_STOP], f"SELECT asset_class, position, {sql_rounded('scale')} AS scale FROM scales"),
)
def residuals(spark, sf):
    found = residual_scales(squared(spark, sf).filter(run_bucket("run_id", 5) == 0))
    return found.select("asset_class", F.posexplode("scale").alias("position", "_s")).select(
        "asset_class", F.col("position").cast("bigint").alias("position"), rounded("_s").alias("scale")
    )


@registered("tail_errors", with_sql([VECTORS, ROBUST, FIT_STOP], f"SELECT vec_id, {sql_rounded('score')} AS score FROM tails"))
def tail_errors(spark, sf):
    return tail_rows(spark, sf).select("vec_id", rounded("tail.score").alias("score"))


@registered(
    "tail_contributions",
    with_sql([VECTORS, ROBUST, FIT_STOP], f"SELECT vec_id, position, {sql_rounded('ratio / 4')} AS contribution FROM top WHERE rn <= 4"),
)
def tail_contributions(spark, sf):
    out = tail_rows(spark, sf).select("vec_id", F.posexplode("tail.contributions").alias("position", "_c")).filter(F.col("_c") > 0)
    return out.select("vec_id", F.col("position").cast("bigint").alias("position"), rounded("_c").alias("contribution"))


# Every second entry stands for the compact features, every third for those that describe values.
REPRESENTATIONS = [
    Representation("pooled_robust_all", False, "robust"),
    Representation("pooled_standard_compact", False, "standard", lambda i: i % 2 == 0),
    Representation("class_robust_all", True, "robust"),
    Representation("class_robust_compact", True, "robust", lambda i: i % 2 == 0),
    Representation("class_standard_compact", True, "standard", lambda i: i % 2 == 0),
]
PHYSICAL = Representation("class_robust_physical", True, "robust", lambda i: i % 3 == 0)


def represented_sql(rows: str) -> list[str]:
    return [
        VECTORS,
        f"kinds AS (SELECT * FROM (VALUES {rows}) v(representation, by_class, scaler, every))",
        f"""laid AS (SELECT representation, CASE WHEN by_class THEN representation || '/' || asset_class ELSE representation END AS unit, scaler, vec_id, position, x,
  {bucket_sql(5)} <> 0 AS fit, {bucket_sql(2)} = 0 AS reference FROM entries, kinds WHERE position % every = 0)""",
        """centres AS (SELECT unit, position, CASE any_value(scaler) WHEN 'robust' THEN median(x) ELSE avg(x) END AS center,
  CASE any_value(scaler) WHEN 'robust' THEN quantile_cont(x, 0.75) - quantile_cont(x, 0.25) ELSE stddev_pop(x) END AS spread FROM laid WHERE fit GROUP BY ALL)""",
        "z AS (SELECT l.*, (x - center) / CASE WHEN spread = 0 THEN 1.0 ELSE spread END AS z FROM laid l JOIN centres USING (unit, position))",
        "limits AS (SELECT unit, position, greatest(quantile_cont(z * z, 0.95), 1e-8) AS scale FROM z WHERE NOT fit GROUP BY ALL)",
        "ratios AS (SELECT z.*, z * z / scale AS ratio FROM z JOIN limits USING (unit, position))",
        "top AS (SELECT *, row_number() OVER (PARTITION BY unit, vec_id ORDER BY ratio DESC, position DESC) AS rn FROM ratios)",
        """raws AS (SELECT representation, unit, vec_id, reference, round(avg(z * z), 9) AS mean_ae, round(sum(ratio) FILTER (WHERE rn <= 4) / 4, 9) AS tail_ae,
  round(max(abs(z)), 9) AS isolation FROM top GROUP BY ALL)""",
        "raw AS (UNPIVOT raws ON mean_ae, tail_ae, isolation INTO NAME detector VALUE score)",
        """cdfs AS (SELECT r.*, (SELECT count(*) FROM raw o WHERE o.reference AND o.unit = r.unit AND o.detector = r.detector AND o.score <= r.score)
  / (SELECT count(*) FROM raw o WHERE o.reference AND o.unit = r.unit AND o.detector = r.detector) AS cdf FROM raw r)""",
        """wide AS (SELECT representation, vec_id, reference, max(CASE detector WHEN 'mean_ae' THEN cdf END) AS mean_ae, max(CASE detector WHEN 'tail_ae' THEN cdf END) AS tail_ae,
  max(CASE detector WHEN 'isolation' THEN cdf END) AS isolation FROM cdfs GROUP BY ALL)""",
        "scores AS (SELECT *, 0.5::DOUBLE * mean_ae + 0.5::DOUBLE * isolation AS mean_ensemble, 0.5::DOUBLE * tail_ae + 0.5::DOUBLE * isolation AS tail_ensemble FROM wide)",
    ]


FIVE = ", ".join(f"('{r.name}', {r.by_class}, '{r.scaler}', {2 if r.keep else 1})" for r in REPRESENTATIONS)


def variant_scores(spark, sf, representations):
    """Squared scaled entries and the largest one stand in for the two detectors, so that SQL can follow."""

    def detectors(rows):
        return rows.withColumn("errors", F.transform("vector", lambda z: z * z)).withColumn("isolation_raw", F.array_max(F.transform("vector", F.abs)))

    early = run_bucket("run_id", 5) == 0
    rows = represented(vectors(spark, sf), representations)
    return score_representations(rows, ["vec_id"], ~early, early, run_bucket("run_id", 2) == 0, detectors=detectors, digits=9)


@registered(
    "score_variants_calibrated",
    with_sql(
        [*represented_sql(FIVE), "long AS (UNPIVOT scores ON mean_ae, tail_ae, isolation, mean_ensemble, tail_ensemble INTO NAME score_name VALUE score)"],
        f"SELECT vec_id, representation, score_name, {sql_rounded('score')} AS score FROM long",
    ),
)
def variants(spark, sf):
    long_form = long_scores(variant_scores(spark, sf, REPRESENTATIONS), ["vec_id"])
    return long_form.select("vec_id", "representation", "score_name", rounded("score").alias("score"))


@registered(
    "variant_cuts",
    with_sql(
        [
            *represented_sql(FIVE),
            "long AS (UNPIVOT scores ON mean_ae, tail_ae, isolation, mean_ensemble, tail_ensemble INTO NAME score_name VALUE score)",
            """placed AS (SELECT *, row_number() OVER (PARTITION BY representation, score_name ORDER BY score) - 1 AS place,
  count(*) OVER (PARTITION BY representation, score_name) AS n FROM long WHERE reference)""",
        ],
        f"SELECT representation, score_name, max(n) AS n, {sql_rounded('min(score) FILTER (WHERE place = ceil(0.995::DOUBLE * (n - 1)))')} AS cut FROM placed GROUP BY ALL",
    ),
)
def variant_cuts(spark, sf):
    cut = frozen_cuts(long_scores(variant_scores(spark, sf, REPRESENTATIONS), ["vec_id"]))
    return cut.select("representation", "score_name", "n", rounded("cut").alias("cut"))


@registered(
    "frozen_supplement",
    with_sql(
        represented_sql("('class_robust_all', true, 'robust', 1), ('class_robust_physical', true, 'robust', 3)"),
        f"""SELECT vec_id, {sql_rounded('m.tail_ensemble')} AS main, {sql_rounded('s.tail_ae')} AS supplement, {sql_rounded('greatest(m.tail_ensemble, s.tail_ae)')} AS fused
FROM scores m JOIN scores s USING (vec_id) WHERE m.representation = 'class_robust_all' AND s.representation = 'class_robust_physical'""",
    ),
)
def supplement(spark, sf):
    """A second model per class on other entries, with references of its own, raises the main score where it is larger."""
    scored = variant_scores(spark, sf, [REPRESENTATIONS[2], PHYSICAL])
    out = with_frozen_supplement(scored, ["vec_id"], ("class_robust_all", "tail_ensemble"), ("class_robust_physical", "tail_ae"))
    return out.select("vec_id", *[rounded(c).alias(c) for c in ("main", "supplement", "fused")])


CDF = """cdf AS (SELECT s.*, (SELECT count(*) FROM scored r WHERE r.asset_class = s.asset_class AND NOT r.is_anomaly AND r.autoencoder <= s.autoencoder)
  / (SELECT count(*) FROM scored r WHERE r.asset_class = s.asset_class AND NOT r.is_anomaly) AS ae FROM scored s)"""


def calibrated_scores(spark, sf):
    w = scored_windows(spark, sf)
    return calibrate(w, normal_only(w), ["asset_class"], "autoencoder", "ae")


@registered("empirical_cdf", with_sql([TELEMETRY, SCORED, CDF], f"SELECT seq, {sql_rounded('ae')} AS ae FROM cdf"))
def empirical_cdf(spark, sf):
    return calibrated_scores(spark, sf).select("seq", rounded("ae").alias("ae"))


@registered(
    "ensemble_alerts",
    with_sql(
        [TELEMETRY, SCORED, CDF],
        f"SELECT seq, {sql_rounded('0.75::DOUBLE * ae + 0.25::DOUBLE * isolation')} AS score, 0.75::DOUBLE * ae + 0.25::DOUBLE * isolation >= 0.85 AS alert FROM cdf",
    ),
)
def ensemble_alerts(spark, sf):
    score = ensemble(F.col("ae"), F.col("isolation"), ensemble_weights(3, 1))
    return calibrated_scores(spark, sf).select("seq", rounded(score).alias("score"), (score >= 0.85).alias("alert"))


@registered(
    "calibrated_cut_per_class",
    with_sql(
        [
            TELEMETRY,
            SCORED,
            "ordered AS (SELECT asset_class, isolation, row_number() OVER (PARTITION BY asset_class ORDER BY isolation) - 1 AS place, count(*) OVER (PARTITION BY asset_class) AS n FROM scored WHERE NOT is_anomaly)",
        ],
        f"SELECT asset_class, max(n) AS n, {sql_rounded('min(isolation) FILTER (WHERE place = ceil(0.99::DOUBLE * (n - 1)))')} AS cut FROM ordered GROUP BY ALL",
    ),
)
def cuts(spark, sf):
    out = normal_quantile(normal_only(scored_windows(spark, sf)), "isolation", 0.99, ["asset_class"])
    return out.select("asset_class", "n", rounded("cut").alias("cut"))


@registered(
    "raw_score_p99",
    with_sql([TELEMETRY, SCORED], f"SELECT asset_class, count(*) AS n, {sql_rounded('quantile_cont(isolation, 0.99)')} AS p99 FROM scored GROUP BY ALL"),
)
def p99(spark, sf):
    out = exact_quantiles(scored_windows(spark, sf), ["asset_class"], "isolation", [0.99], ["p99"])
    return out.select("asset_class", "n", rounded("p99").alias("p99"))


@registered(
    "fused_detectors",
    with_sql([TELEMETRY, SCORED], f"SELECT seq, {sql_rounded('greatest(autoencoder, isolation)')} AS score FROM scored"),
)
def fusion(spark, sf):
    return scored_windows(spark, sf).select("seq", rounded(fused(F.col("autoencoder"), F.col("isolation"))).alias("score"))


@registered(
    "regime_centred_vectors",
    with_sql(
        [
            VECTORS,
            f"fit AS (SELECT * FROM entries WHERE {bucket_sql(5)} <> 0)",
            "per_regime AS (SELECT asset_class, operating_regime, position, median(x) AS c FROM fit GROUP BY ALL HAVING count(*) >= 20)",
            "fallback AS (SELECT asset_class, position, median(x) AS c FROM fit GROUP BY ALL)",
        ],
        f"""SELECT e.vec_id, e.position, {sql_rounded('e.x - coalesce(r.c, f.c)')} AS x, r.c IS NULL AS regime_fallback FROM entries e
LEFT JOIN per_regime r USING (asset_class, operating_regime, position) JOIN fallback f USING (asset_class, position)""",
    ),
)
def regimes(spark, sf):
    v = vectors(spark, sf)
    found, fallback = fit_regimes(v.filter(run_bucket("run_id", 5) != 0))
    out = exploded(center_by_regime(v, found, fallback), ["vec_id", "regime_fallback"])
    return out.select("vec_id", F.col("position").cast("bigint").alias("position"), rounded("x").alias("x"), "regime_fallback")


@registered("subspace_reconstruction")
def reconstruction(spark, sf):
    rows = settle(scaled_rows(spark, sf), "scaled")
    subspace = settle(fit_subspace(rows, 8), "subspace")
    return reconstruction_errors(rows, subspace).select("vec_id", rounded(row_error(F.col("errors"))).alias("error"))


@registered("isolation_forest_scores")
def forest(spark, sf):
    rows = settle(scaled_rows(spark, sf), "scaled")
    trees = settle(fit_forest(rows, ["vec_id"]), "forest")
    return isolation_scores(rows, trees).select("vec_id", rounded("isolation").alias("isolation"))


@registered(
    "forest_sample_sizes",
    with_sql(
        [VECTORS, "counts AS (SELECT asset_class, count(*) AS n FROM vectors GROUP BY ALL)"],
        "SELECT asset_class, tree::INTEGER AS tree, least(64, n)::BIGINT AS rows, least(64, n)::BIGINT AS distinct_rows FROM counts, range(40) r(tree)",
    ),
)
def sample_sizes(spark, sf):
    drawn = draw_samples(vectors(spark, sf), ["vec_id"], trees=40, sample=64)
    return drawn.groupBy("asset_class", "tree").agg(F.count("*").alias("rows"), F.count_distinct("vec_id").alias("distinct_rows"))


@registered(
    "forest_of_large_samples",
    with_sql(
        [VECTORS, "counts AS (SELECT asset_class, count(*) AS n FROM vectors GROUP BY ALL)"],
        """SELECT asset_class, tree::INTEGER AS tree, greatest(1, floor(n * 0.5::DOUBLE))::BIGINT AS sample, 1::BIGINT AS leaves_above_splits
  FROM counts, range(20) r(tree)""",
    ),
)
def large_samples(spark, sf):
    """Samples of half a class, grown by levels until a node has 64 rows."""
    rows = settle(vectors(spark, sf), "vectors")
    trees = fit_forest(rows, ["vec_id"], trees=20, sample=0.5, task_rows=64)
    splits = F.size(F.filter("feature", lambda f: f >= 0))
    return trees.select("asset_class", "tree", "sample", (F.size("feature") - 2 * splits).cast("long").alias("leaves_above_splits"))


PLAN = WindowPlan.of("24h", "24h")
KNOWN_REGIMES = {"asset_class": KNOWN["asset_class"], "operating_regime": ["steady", "mixed"]}
CONTEXT_SQL = """contexts AS (SELECT run_id, asset_id, window_start, coalesce(max(constant), CASE count(DISTINCT operating_regime) WHEN 0 THEN 'unknown' WHEN 1 THEN min(operating_regime) ELSE 'mixed' END) AS regime
  FROM member JOIN (SELECT asset_id, CASE WHEN count(DISTINCT operating_regime) = 1 THEN min(operating_regime) END AS constant FROM telemetry GROUP BY ALL) USING (asset_id) GROUP BY ALL)"""
# A channel's deviation label looks at its name; the event types have none of the words, so two are renamed.
RENAMED = "CASE channel WHEN 'click' THEN 'vibration' WHEN 'error' THEN 'temperature' ELSE channel END"
EXPLAIN_SQL = [
    *channel_sql(PLAN),
    CONTEXT_SQL,
    "named AS (SELECT * REPLACE (" + RENAMED + " AS channel) FROM stats)",
    f"""features AS (UNPIVOT (SELECT run_id, asset_id, window_start, channel, {', '.join(s + '::DOUBLE AS ' + s for s in STATISTICS)} FROM named)
  ON {', '.join(STATISTICS)} INTO NAME statistic VALUE value)""",
    "summed AS (SELECT run_id, asset_id, window_start, greatest(sum(abs(value)), 1e-12) AS total FROM features GROUP BY ALL)",
    "shares AS (SELECT f.*, abs(value) / total AS share FROM features f JOIN summed USING (run_id, asset_id, window_start))",
    f"""per_channel AS (SELECT run_id, asset_id, window_start, channel, sum(share) AS share FROM shares WHERE share > 0
  AND statistic IN ({', '.join(repr(s) for s in VALUE_STATISTICS)}) GROUP BY ALL)""",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, asset_id, window_start ORDER BY share DESC, channel) AS rn FROM per_channel)""",
    """flags AS (SELECT s.run_id, s.asset_id, s.window_start, sum(CASE WHEN statistic = 'mean' THEN value END) / 397.0::DOUBLE AS score,
  bool_or(statistic = 'missing' AND value > 0) AS loss, bool_or(statistic = 'coverage_ratio' AND value < 0.8) AS sparse,
  bool_or(statistic IN ('bad_ratio', 'uncertain_ratio') AND share > 0 AND value > 0) AS quality FROM shares s GROUP BY ALL)""",
    """tops AS (SELECT run_id, asset_id, window_start, min(rn) FILTER (WHERE channel = 'vibration') AS v, min(rn) FILTER (WHERE channel = 'temperature') AS t
  FROM ranked WHERE rn <= 3 GROUP BY ALL)""",
    """tags AS (SELECT f.*, c.regime NOT IN ('steady', 'mixed') AS mismatch, score >= 0.5 AS alert, t.v, t.t FROM flags f JOIN contexts c USING (run_id, asset_id, window_start)
  LEFT JOIN tops t USING (run_id, asset_id, window_start))""",
]


def explained(spark, sf):
    t = telemetry(spark, sf).drop("is_anomaly", "event_id", "event_start_us", "asset_class")
    names = F.when(F.col("signal_class") == "click", "vibration").when(F.col("signal_class") == "error", "temperature").otherwise(F.col("signal_class"))
    channels = sorted(["vibration", "temperature", "purchase", "signup", "view"])
    defaults = {"vibration": DEFAULTS["click"], "view": DEFAULTS["view"]}
    features = encode_contexts(
        window_features(t.withColumn("signal_class", names), PLAN, channels, defaults), {"operating_regime": ["steady", "mixed"]}
    )
    v = pooled_vectors(features, channels, STATISTICS)
    means = [F.get("vector", F.lit(i * len(STATISTICS))) for i in range(len(channels))]
    total = means[0]
    for m in means[1:]:
        total = total + m
    scored = (
        v.withColumn("channels", F.array(*[F.lit(c) for c in channels]))
        .withColumn("raw_vector", F.col("vector"))
        .withColumn("errors", F.transform("vector", lambda x: F.abs(x)))
        .withColumn("irregularity", total / F.lit(397.0))
        .withColumn("autoencoder", F.col("irregularity"))
        .withColumn("isolation_forest", F.col("irregularity"))
        .withColumn("asset_class", F.lit("any"))
    )
    applicable = spark.createDataFrame([("any", channels)], "asset_class string, applicable array<string>")
    return prediction_records(scored, list(STATISTICS), 0.5, applicable)


@registered(
    "explained_predictions",
    with_sql(
        EXPLAIN_SQL,
        f"""SELECT run_id, asset_id, strftime(make_timestamp(window_start), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS window_start, {sql_rounded('score')} AS score,
  CASE WHEN alert AND NOT mismatch AND NOT loss AND NOT sparse AND NOT quality AND v IS NULL AND t IS NULL THEN 'multivariate_novelty' ELSE concat_ws(',',
    CASE WHEN mismatch THEN 'regime_mismatch' END, CASE WHEN loss THEN 'signal_loss' END, CASE WHEN sparse THEN 'sampling_degradation' END,
    CASE WHEN alert AND quality THEN 'quality_degradation' END, CASE WHEN alert AND v < coalesce(t, 9) THEN 'vibration_deviation' END,
    CASE WHEN alert AND t IS NOT NULL THEN 'thermal_deviation' END, CASE WHEN alert AND v > t THEN 'vibration_deviation' END) END AS observations
FROM tags""",
    ),
)
def explanations(spark, sf):
    return explained(spark, sf).select(
        "run_id", "asset_id", "window_start", rounded("scores.irregularity").alias("score"), F.concat_ws(",", "observations").alias("observations")
    )


@registered(
    "feature_contribution_shares",
    with_sql(
        EXPLAIN_SQL,
        f"""SELECT asset_id, window_start, channel || '_' || statistic AS feature, {sql_rounded('share')} AS share FROM
  (SELECT asset_id, strftime(make_timestamp(window_start), '%Y-%m-%dT%H:%M:%S') || '+00:00' AS window_start, channel, statistic, share FROM shares) WHERE share > 0""",
    ),
)
def contributions(spark, sf):
    out = explained(spark, sf).select("asset_id", "window_start", F.explode("feature_contributions").alias("feature", "_s")).filter(F.col("_s") > 0)
    return out.select("asset_id", "window_start", "feature", rounded("_s").alias("share"))


@registered(
    "class_feature_vectors",
    with_sql(
        channel_sql(PLAN),
        f"""SELECT s.run_id, s.asset_id, s.window_start, count(*) * {len(STATISTICS)} AS width, {sql_rounded('sum(mean + sample_count)', 4)} AS checksum
FROM stats s JOIN (SELECT DISTINCT asset_id, asset_class FROM telemetry) a USING (asset_id)
WHERE s.channel <> 'signup' OR a.asset_class = 'class-2' GROUP BY ALL""",
    ),
)
def class_layout(spark, sf):
    t = telemetry(spark, sf)
    features = window_features(t, PLAN, CHANNELS, DEFAULTS)
    applies = class_channels(with_channel(t).filter("signal_class <> 'signup' OR asset_class = 'class-2'"))
    v = class_vectors(features, applies, STATISTICS)
    n = len(STATISTICS)
    count_at = STATISTICS.index("sample_count")
    picked = F.filter("vector", lambda x, i: (i % n == 0) | (i % n == count_at))
    total = F.aggregate(picked, F.lit(0.0), lambda a, x: a + x)
    return v.select("run_id", "asset_id", "window_start", F.size("vector").cast("bigint").alias("width"), rounded(total, 4).alias("checksum"))


def fitted_and_explained(spark, sf, run_days=None, **chosen):
    """Fit on the normal days of three fifths of the assets, calibrate on those of the rest, explain every window of all assets.

    With ``run_days`` a run is that many days of an asset, and runs are split instead of assets.
    """
    t = telemetry(spark, sf)
    part = [F.floor(F.col("us") / F.lit(run_days * 86_400_000_000)).cast("string")] if run_days else []
    # Fitting and scoring go over the rows many times; they are made and matched with the eventful days once.
    rows = settle(t.withColumn("run_id", F.concat_ws("/", "run_id", "asset_id", *part)), "telemetry")
    day = F.date_trunc("day", "timestamp")
    eventful = settle(rows.filter("is_anomaly").select("run_id", "asset_id", day.alias("day")).distinct(), "eventful-days")
    split = run_bucket("run_id" if run_days else "asset_id", 5)
    train = settle(rows.filter(split < 3).withColumn("day", day).join(eventful, ["run_id", "asset_id", "day"], "left_anti").drop("day"), "train")
    validation = rows.filter(split >= 3)
    options = Options(size="24h", stride="24h", exclude_signal_classes=[], early_stop_modulo=2, min_partition_windows=5, **chosen)
    model = fit_model(train, validation, options)
    out = predict(rows, model)
    return out.select("run_id", "asset_id", "window_start", rounded("scores.irregularity").alias("irregularity"), F.concat_ws(",", "observations").alias("observations"))


@registered("detector_end_to_end")
def end_to_end(spark, sf):
    """One pair of detectors for all asset classes together."""
    return fitted_and_explained(spark, sf, family="pooled")


@registered("contextual_detector_end_to_end")
def contextual_end_to_end(spark, sf):
    """One pair of detectors per asset class, tail scores, and a threshold calibrated on normal windows."""
    return fitted_and_explained(spark, sf, run_days=3, family="contextual", calibration_quantile=0.9)


DAILY_CLOSED = with_sql(
    [*channel_sql(COMPLETE), "bound AS (SELECT (max(us) - 3600000000) // 1000 * 1000 AS watermark FROM telemetry)"],
    "SELECT run_id, asset_id, window_start, window_end, channel, "
    + ", ".join(f"{sql_rounded(s + '::DOUBLE', 8 if s == 'slope' else 6)} AS {s}" for s in STATISTICS)
    + " FROM stats, bound WHERE window_end <= watermark",
)


def event_stream(spark, sf):
    batch = table(spark, sf, "events")
    raw = spark.readStream.schema(batch.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return shaped(raw).select("run_id", "asset_id", "timestamp", "tag_id", "signal_class", "value", "quality", "sampling_interval_ms", "us")


@registered("stream_closed_windows", DAILY_CLOSED)
def stream_windows(spark, sf):
    """The event table as a stream: late and repeated rows dropped, windows closed once the watermark and their asset pass them."""
    path = scratch_path(spark, "stream")
    closed = closed_windows(fresh_observations(event_stream(spark, sf), "1 hour"), COMPLETE, CHANNELS, DEFAULTS)
    run_available(closed, f"{path}/out", f"{path}/state")
    out = long(spark.read.parquet(f"{path}/out"))
    return out.select(
        "run_id", "asset_id", "window_start", "window_end", "channel", *[rounded(s, 8 if s == "slope" else 6).alias(s) for s in STATISTICS]
    )


@registered(
    "stream_silent_assets",
    with_sql(
        [TELEMETRY],
        """SELECT run_id, asset_id, max(us) AS last_us FROM telemetry GROUP BY ALL
HAVING max(us) // 1000 + 21600000 <= (SELECT max(us) // 1000 FROM telemetry)""",
    ),
)
def silent(spark, sf):
    path = scratch_path(spark, "silence")
    run_available(silent_assets(event_stream(spark, sf), 6 * 3_600_000), f"{path}/out", f"{path}/state")
    return spark.read.parquet(f"{path}/out").select("run_id", "asset_id", "last_us")
