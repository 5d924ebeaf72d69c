"""Queries over windowing and window features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.channels import STATISTICS, channel_of, check_feature_schema, chosen_statistics, feature_names
from millrace.operators.context import context_vocabulary, encode_contexts, vocabulary_lists
from millrace.operators.features import SORTED_CELLS, long, order_statistics, pane_cells, readings, wide, window_features
from millrace.operators.joins import unmatched_rows
from millrace.operators.windows import WindowPlan, window_membership
from millrace.functions.hashing import short_sha1
from millrace.plans.registry import registered
from millrace.plans.views import TELEMETRY, rounded, sql_rounded, telemetry, with_sql
from millrace.session import settle

CHANNELS = ["click", "error", "purchase", "signup", "view"]
DEFAULTS = {"click": 7_200_000.0, "view": 1_800_000.0}
DAILY = WindowPlan.of("24h", "24h")
SLIDING = WindowPlan.of("24h", "6h")
GAPPED = WindowPlan.of("6h", "24h")
COMPLETE = WindowPlan.of("24h", "24h", "complete")
SHORT = WindowPlan.of("90min", "1h")


def member_sql(plan: WindowPlan) -> list[str]:
    slack = plan.stride_us if plan.tail == "legacy" else 0
    return [
        TELEMETRY,
        "bounds AS (SELECT run_id, asset_id, min(us) AS low, max(us) AS high FROM telemetry GROUP BY ALL)",
        f"""member AS (SELECT *, unnest(generate_series((us - {plan.size_us}) // {plan.stride_us} + 1, us // {plan.stride_us}))
  * {plan.stride_us} AS window_start FROM telemetry)""",
        f"""emitted AS (SELECT DISTINCT run_id, asset_id, window_start FROM member JOIN bounds USING (run_id, asset_id)
  WHERE window_start >= low // {plan.stride_us} * {plan.stride_us} AND window_start <= high - {plan.size_us} + {slack})""",
    ]


def channel_sql(plan: WindowPlan) -> list[str]:
    ok = "FILTER (WHERE quality IS NULL OR quality <> 'bad')"
    return [
        *member_sql(plan),
        f"""chan AS (SELECT run_id, asset_id, window_start, channel, count(*)::DOUBLE AS n,
  avg(value) {ok} AS mean, median(value) {ok} AS median, min(value) {ok} AS min, max(value) {ok} AS max,
  stddev_pop(value) {ok} AS std, mad(value) {ok} AS mad, arg_max(value, us) {ok} AS last, arg_min(value, us) {ok} AS first,
  CASE WHEN count(*) {ok} > 1 AND max(us) {ok} > min(us) {ok} THEN regr_slope(value, (us - window_start) / 1e6) {ok} END AS slope,
  arg_min_null(sampling_interval_ms, us) AS interval_ms,
  count(*) FILTER (WHERE quality = 'good') / count(*) AS good_ratio,
  count(*) FILTER (WHERE quality IS NULL OR quality = 'uncertain') / count(*) AS uncertain_ratio,
  count(*) FILTER (WHERE quality = 'bad') / count(*) AS bad_ratio
  FROM member GROUP BY ALL)""",
        f"""defaults AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {DEFAULTS.get(c, 'NULL')}::DOUBLE)" for c in CHANNELS)}) v(channel, default_ms))""",
        f"""stats AS (SELECT e.run_id, e.asset_id, e.window_start, e.window_start + {plan.size_us} AS window_end, d.channel,
  coalesce(mean, 0.0) AS mean, coalesce(median, 0.0) AS median, coalesce(min, 0.0) AS min, coalesce(max, 0.0) AS max,
  coalesce(max - min, 0.0) AS range, coalesce(std, 0.0) AS std, coalesce(mad, 0.0) AS mad, coalesce(last, 0.0) AS last,
  coalesce(last - first, 0.0) AS delta, coalesce(slope, 0.0) AS slope, coalesce(n, 0.0) AS sample_count,
  CASE WHEN n IS NULL THEN coalesce({plan.size_us}.0 / (default_ms * 1000.0), 0.0)
    WHEN interval_ms > 0 THEN {plan.size_us}.0 / (interval_ms * 1000.0) ELSE n END AS expected_sample_count,
  CASE WHEN n IS NULL THEN 0.0 WHEN interval_ms > 0 THEN least(n / ({plan.size_us}.0 / (interval_ms * 1000.0)), 1.0) ELSE 1.0 END AS coverage_ratio,
  coalesce(good_ratio, 0.0) AS good_ratio, coalesce(uncertain_ratio, 0.0) AS uncertain_ratio, coalesce(bad_ratio, 1.0) AS bad_ratio,
  CASE WHEN n IS NULL THEN 1.0 ELSE 0.0 END AS missing
  FROM emitted e CROSS JOIN defaults d LEFT JOIN chan c USING (run_id, asset_id, window_start, channel))""",
    ]


def long_sql(plan: WindowPlan) -> str:
    columns = ", ".join(f"{sql_rounded(s + '::DOUBLE', 8 if s == 'slope' else 6)} AS {s}" for s in STATISTICS)
    return with_sql(channel_sql(plan), f"SELECT run_id, asset_id, window_start, window_end, channel, {columns} FROM stats")


def unlabelled(spark: SparkSession, sf: str) -> DataFrame:
    return telemetry(spark, sf).drop("asset_class", "operating_regime", "is_anomaly", "event_id", "event_start_us")


def long_features(spark: SparkSession, sf: str, plan: WindowPlan) -> DataFrame:
    out = long(window_features(unlabelled(spark, sf), plan, CHANNELS, DEFAULTS))
    keys = ["run_id", "asset_id", "window_start", "window_end", "channel"]
    return out.select(*keys, *[rounded(s, 8 if s == "slope" else 6).alias(s) for s in STATISTICS])


@registered("window_features_tumbling", long_sql(DAILY))
def tumbling(spark, sf):
    return long_features(spark, sf, DAILY)


@registered("window_features_sliding", long_sql(SLIDING))
def sliding(spark, sf):
    return long_features(spark, sf, SLIDING)


@registered("window_features_gapped", long_sql(GAPPED))
def gapped(spark, sf):
    return long_features(spark, sf, GAPPED)


@registered("window_features_complete_tail", long_sql(COMPLETE))
def complete(spark, sf):
    return long_features(spark, sf, COMPLETE)


@registered(
    "window_membership_counts",
    with_sql(member_sql(SHORT), "SELECT run_id, asset_id, window_start, count(*) AS observations FROM member GROUP BY ALL"),
)
def membership(spark, sf):
    rows = window_membership(telemetry(spark, sf), SHORT)
    return rows.groupBy("run_id", "asset_id", "window_start").agg(F.count("*").alias("observations"))


WIDE_STATS = chosen_statistics({"quality": False, "sampling": False})


@registered(
    "window_features_wide_families",
    with_sql(
        channel_sql(DAILY),
        "SELECT run_id, asset_id, window_start, window_end, "
        + ", ".join(
            f"max(CASE WHEN channel = '{c}' THEN {sql_rounded(s + '::DOUBLE', 8 if s == 'slope' else 6)} END) AS {c}_{s}"
            for c in CHANNELS
            for s in WIDE_STATS
        )
        + " FROM stats GROUP BY ALL",
    ),
)
def wide_families(spark, sf):
    features = window_features(unlabelled(spark, sf), DAILY, CHANNELS, DEFAULTS, {"quality": False, "sampling": False})
    out = wide(features, CHANNELS)
    keys = ["run_id", "asset_id", "window_start", "window_end"]
    return out.select(*keys, *[rounded(c, 8 if c.endswith("_slope") else 6).alias(c) for c in out.columns if c not in keys])


@registered(
    "features_of_a_trained_schema",
    with_sql(
        channel_sql(DAILY),
        """SELECT channel, count(*) * %d AS cells, %s AS above_one FROM stats WHERE channel IN (%s) GROUP BY ALL"""
        % (len(WIDE_STATS), " + ".join(f"count(*) FILTER (WHERE {s} > 1)" for s in WIDE_STATS), ", ".join(f"'{c}'" for c in CHANNELS)),
    ),
)
def trained_schema(spark, sf):
    """Features told from identity by name, held against a trained schema, and their values above one counted per channel of the name."""
    out = wide(window_features(unlabelled(spark, sf), DAILY, CHANNELS, DEFAULTS, {"quality": False, "sampling": False}), CHANNELS)
    trained = [f"{c}_{s}" for c in CHANNELS for s in WIDE_STATS]
    check_feature_schema(out.columns, trained)
    try:
        check_feature_schema([*out.columns, "depth_mean"], trained[1:])
    except ValueError:
        pass
    else:
        raise ValueError("Another schema was taken for the trained one")
    by_channel = {}
    for name in feature_names(out.columns):
        by_channel.setdefault(channel_of(name), []).append(name)
    counts = out.agg(*[sum((F.count_if(F.col(n) > 1) for n in names), F.lit(0).cast("bigint")).alias(c) for c, names in by_channel.items()], F.count("*").alias("_rows"))
    sizes = F.array(*[F.struct(F.lit(c).alias("channel"), (F.col("_rows") * len(names)).alias("cells"), F.col(c).alias("above_one")) for c, names in by_channel.items()])
    return counts.select(F.inline(sizes))


LABEL_SQL = [
    *member_sql(SLIDING),
    """per_event AS (SELECT run_id, asset_id, window_start, event_id, coalesce(min(event_start_us), min(us)) AS start
  FROM member WHERE event_id IS NOT NULL GROUP BY ALL)""",
    """first_event AS (SELECT run_id, asset_id, window_start, arg_min(event_id, (start, event_id)) AS event_id, min(start) AS event_start_us
  FROM per_event GROUP BY ALL)""",
    """constants AS (SELECT run_id, asset_id,
  CASE WHEN count(DISTINCT asset_class) = 1 THEN min(asset_class) END AS class_constant,
  CASE WHEN count(DISTINCT operating_regime) = 1 THEN min(operating_regime) END AS regime_constant,
  CASE WHEN count(DISTINCT event_id) = 1 AND count(event_id) = count(*) THEN min(event_id) END AS event_constant,
  coalesce(min(event_start_us), min(us) FILTER (WHERE event_id IS NOT NULL)) AS event_constant_us
  FROM telemetry GROUP BY ALL)""",
    """labels AS (SELECT run_id, asset_id, window_start,
  CASE count(DISTINCT asset_class) WHEN 0 THEN 'unknown' WHEN 1 THEN min(asset_class) ELSE 'mixed' END AS class_local,
  CASE count(DISTINCT operating_regime) WHEN 0 THEN 'unknown' WHEN 1 THEN min(operating_regime) ELSE 'mixed' END AS regime_local,
  bool_or(coalesce(is_anomaly, false)) AS is_anomaly FROM member GROUP BY ALL)""",
    """windows AS (SELECT run_id, asset_id, window_start, coalesce(class_constant, class_local) AS asset_class,
  coalesce(regime_constant, regime_local) AS operating_regime, l.is_anomaly, coalesce(event_constant, f.event_id) AS event_id,
  CASE WHEN event_constant IS NOT NULL THEN event_constant_us ELSE f.event_start_us END AS event_start_us
  FROM emitted JOIN labels l USING (run_id, asset_id, window_start) JOIN constants USING (run_id, asset_id)
  LEFT JOIN first_event f USING (run_id, asset_id, window_start))""",
]


def labelled_features(spark: SparkSession, sf: str, plan: WindowPlan = SLIDING) -> DataFrame:
    return window_features(
        telemetry(spark, sf), plan, CHANNELS, DEFAULTS, {"statistical": False, "slopes": False}
    )


@registered("window_context_and_labels", with_sql(LABEL_SQL, "SELECT * FROM windows"))
def context_labels(spark, sf):
    return labelled_features(spark, sf).select(
        "run_id", "asset_id", "window_start", "asset_class", "operating_regime", "is_anomaly", "event_id", "event_start_us"
    )


KNOWN = {"asset_class": [f"class-{i}" for i in range(4)], "operating_regime": ["mixed", "regime-0", "regime-1", "steady"]}


@registered(
    "context_one_hot",
    with_sql(
        LABEL_SQL,
        "SELECT run_id, asset_id, window_start, "
        + ", ".join(
            f"coalesce({context}, 'unknown') = '{value}' AS context_{context}_{short_sha1(value)}"
            for context, values in KNOWN.items()
            for value in values
        )
        + ", coalesce(operating_regime, 'unknown') NOT IN ('"
        + "', '".join(KNOWN["operating_regime"])
        + "') AS context_regime_unknown FROM windows",
    ),
)
def one_hot(spark, sf):
    features = labelled_features(spark, sf)
    encoded = encode_contexts(features, KNOWN)
    return encoded.drop("window_end", "asset_class", "operating_regime", "is_anomaly", "event_id", "event_start_us", "stats")


@registered(
    "context_vocabulary",
    with_sql(
        LABEL_SQL,
        """SELECT DISTINCT 'asset_class' AS context, asset_class AS value FROM windows WHERE asset_class IS NOT NULL
UNION SELECT DISTINCT 'operating_regime', operating_regime FROM windows WHERE operating_regime IS NOT NULL""",
    ),
)
def vocabulary(spark, sf):
    return context_vocabulary(labelled_features(spark, sf))


@registered(
    "training_window_anomalies",
    with_sql(LABEL_SQL, "SELECT asset_class, count(*) AS windows, count(*) FILTER (WHERE is_anomaly) AS anomalous FROM windows GROUP BY ALL"),
)
def window_anomalies(spark, sf):
    return labelled_features(spark, sf).groupBy("asset_class").agg(
        F.count("*").alias("windows"), F.count_if("is_anomaly").alias("anomalous")
    )


@registered(
    "unlabelled_window_count",
    with_sql(member_sql(SLIDING), "SELECT count(*) AS windows FROM emitted"),
)
def window_count(spark, sf):
    plain = unlabelled(spark, sf)
    return window_features(plain, SLIDING, families={"statistical": False, "slopes": False}).agg(F.count("*").alias("windows"))


@registered(
    "median_and_mad_large_blocks",
    with_sql(
        member_sql(WindowPlan.of("240h", "120h")),
        f"""SELECT run_id, asset_id, window_start, channel, {sql_rounded('median(value)')} AS median, {sql_rounded('mad(value)')} AS mad
FROM member WHERE quality IS NULL OR quality <> 'bad' GROUP BY ALL""",
    ),
)
def large_blocks(spark, sf):
    """Most blocks exceed the small limit, so both the in-task and the range-split way are used."""
    plan = WindowPlan.of("240h", "120h")
    rows = readings(telemetry(spark, sf))
    cells = settle(pane_cells(rows, plan), "cells")
    out = order_statistics(rows, cells, plan, limit=12)
    return out.select("run_id", "asset_id", "window_start", "channel", rounded("median").alias("median"), rounded("mad").alias("mad"))


@registered(
    "complete_tail_equals_filtered_legacy",
    with_sql(
        member_sql(COMPLETE),
        f"""SELECT count(*) AS complete_windows, 0::BIGINT AS unmatched FROM emitted
WHERE window_start + {COMPLETE.size_us} <= (SELECT max(b.high) FROM bounds b WHERE b.run_id = emitted.run_id AND b.asset_id = emitted.asset_id)""",
    ),
)
def tail_equality(spark, sf):
    plain = unlabelled(spark, sf)
    families = {"statistical": False, "slopes": False}
    generated = long(window_features(plain, COMPLETE, CHANNELS, DEFAULTS, families))
    observations = plain.count()
    bounds = plain.groupBy("run_id", "asset_id").agg(F.max("us").alias("_high"))
    if observations > SORTED_CELLS:
        bounds = bounds.hint("shuffle_hash")
    legacy = long(window_features(plain, DAILY, CHANNELS, DEFAULTS, families))
    filtered = legacy.join(bounds, ["run_id", "asset_id"]).filter(F.col("window_end") <= F.col("_high")).drop("_high")
    # A daily window that is emitted holds an observation, and has a row for each channel.
    different = unmatched_rows(generated, filtered, rows=len(CHANNELS) * observations).agg(F.count("*").alias("unmatched"))
    counted = generated.filter(F.col("channel") == CHANNELS[0]).agg(F.count("*").alias("complete_windows"))
    return counted.withColumn("_row", F.lit(0)).join(different.withColumn("_row", F.lit(0)), "_row").drop("_row")
