"""Telemetry-shaped views over the given tables, in Spark and as the same SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.timeline import DAY_US, HOUR_US, MINUTE_US
from millrace.session import prepare_session


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare_session(spark).read.parquet(f"{sf}/{name}.parquet")


def rounded(column: Column | str, digits: int = 6) -> Column:
    """Rounded, with negative zero made plain zero."""
    # A double is rounded by way of a decimal, which is slow, so it is written once: adding zero drops the sign of a zero.
    return F.round(F.col(column) if isinstance(column, str) else column, digits) + F.lit(0.0)


def sql_rounded(expression: str, digits: int = 6) -> str:
    return f"(CASE WHEN round({expression}, {digits}) = 0 THEN 0.0::DOUBLE ELSE round({expression}, {digits}) END)"


def shaped(events: DataFrame) -> DataFrame:
    """Events as telemetry; works for batch and streaming input."""
    user, seq = F.col("user_id"), F.col("event_id")
    text = user.cast("string")
    ts = F.col("ts").cast("timestamp")
    us = F.unix_micros(ts)
    high = F.col("value") > 150
    span = F.call_function("div", us, F.lit(3 * DAY_US).cast("bigint"))
    kind = F.col("event_type")
    return events.select(
        F.concat(F.lit("run-"), (user % 20).cast("string")).alias("run_id"),
        F.concat(F.lit("user-"), text).alias("asset_id"),
        F.concat(F.lit("class-"), (user % 4).cast("string")).alias("asset_class"),
        ts.alias("timestamp"),
        kind.alias("tag_id"),
        kind.alias("signal_class"),
        "value",
        F.when(kind == "click", "bar").when(kind == "error", " kPa").when(kind == "view", "°F")
        .when(kind == "signup", "%").otherwise("L/min").alias("unit"),
        F.when(seq % 20 == 0, "bad").when(seq % 20 < 3, "uncertain").when(seq % 20 == 3, None).otherwise("good").alias("quality"),
        F.when(seq % 7 == 0, None).otherwise(F.lit(3600000.0)).alias("sampling_interval_ms"),
        F.when(user % 3 == 0, "steady").when(seq % 11 == 0, None)
        .otherwise(F.concat(F.lit("regime-"), F.floor(F.dayofmonth(ts) / F.lit(10)).cast("string"))).alias("operating_regime"),
        high.alias("is_anomaly"),
        F.when(high, F.concat(F.lit("evt-"), text, F.lit("-"), span.cast("string"))).alias("event_id"),
        F.when(high & (seq % 2 == 0), us - MINUTE_US).alias("event_start_us"),
        seq.alias("seq"),
        us.alias("us"),
    )


TELEMETRY = """telemetry AS (
  SELECT 'run-' || (user_id % 20) AS run_id, 'user-' || user_id AS asset_id, 'class-' || (user_id % 4) AS asset_class,
    ts AS "timestamp", event_type AS tag_id, event_type AS signal_class, event_type AS channel, value,
    CASE event_type WHEN 'click' THEN 'bar' WHEN 'error' THEN ' kPa' WHEN 'view' THEN '°F' WHEN 'signup' THEN '%' ELSE 'L/min' END AS unit,
    CASE WHEN event_id % 20 = 0 THEN 'bad' WHEN event_id % 20 < 3 THEN 'uncertain' WHEN event_id % 20 = 3 THEN NULL ELSE 'good' END AS quality,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE 3600000.0::DOUBLE END AS sampling_interval_ms,
    CASE WHEN user_id % 3 = 0 THEN 'steady' WHEN event_id % 11 = 0 THEN NULL ELSE 'regime-' || (day(ts) // 10) END AS operating_regime,
    value > 150 AS is_anomaly,
    CASE WHEN value > 150 THEN 'evt-' || user_id || '-' || (epoch_us(ts) // 259200000000) END AS event_id,
    CASE WHEN value > 150 AND event_id % 2 = 0 THEN epoch_us(ts) - 60000000 END AS event_start_us,
    event_id AS seq, epoch_us(ts) AS us
  FROM events)"""


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return shaped(table(spark, sf, "events"))


def scored_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour windows starting at each observation, with two scores and noisy labels."""
    t = telemetry(spark, sf)
    score = F.least(F.col("value") / F.lit(200.0), F.lit(1.0))
    wave = ((F.col("seq") * 37) % 1000) / F.lit(1000.0)
    label = (F.col("value") + F.col("seq") % 50) > 90
    event = F.concat(F.lit("evt-"), F.col("asset_id"), F.lit("-"), F.call_function("div", F.col("us"), F.lit(3 * DAY_US).cast("bigint")).cast("string"))
    return t.select(
        "run_id", "asset_id", "asset_class", "seq",
        F.col("us").alias("window_start"),
        (F.col("us") + 6 * HOUR_US).alias("window_end"),
        score.alias("autoencoder"),
        (F.lit(0.5) * wave + F.lit(0.5) * score).alias("isolation"),
        label.alias("is_anomaly"),
        F.when(label, event).alias("event_id"),
        F.when(label, F.col("us") - 30 * MINUTE_US).alias("event_start_us"),
    )


SCORED = """scored AS (
  SELECT run_id, asset_id, asset_class, seq, us AS window_start, us + 21600000000 AS window_end,
    least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS autoencoder,
    0.5::DOUBLE * (((seq * 37) % 1000) / 1000.0::DOUBLE) + 0.5::DOUBLE * least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS isolation,
    (value + (seq % 50)) > 90 AS is_anomaly,
    CASE WHEN (value + (seq % 50)) > 90 THEN 'evt-' || asset_id || '-' || (us // 259200000000) END AS event_id,
    CASE WHEN (value + (seq % 50)) > 90 THEN us - 1800000000 END AS event_start_us
  FROM telemetry)"""


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Six-hour event intervals around errors, with a family."""
    t = telemetry(spark, sf).filter((F.col("signal_class") == "error") & (F.col("value") > 20))
    k = F.col("seq") % 5
    family = (
        F.when(k == 0, "cavitation").when(k == 1, "bearing_degradation").when(k == 2, "communication_loss")
        .when(k == 3, "sensor_drift").otherwise("mechanical_overload")
    )
    return t.select(
        "run_id", "asset_id", F.concat(F.lit("iv-"), F.col("seq").cast("string")).alias("event_id"), family.alias("family"),
        (F.col("us") - 2 * HOUR_US).alias("start_us"), (F.col("us") + 4 * HOUR_US).alias("end_us"),
    )


INTERVALS = """intervals AS (
  SELECT run_id, asset_id, 'iv-' || seq AS event_id,
    CASE seq % 5 WHEN 0 THEN 'cavitation' WHEN 1 THEN 'bearing_degradation' WHEN 2 THEN 'communication_loss'
      WHEN 3 THEN 'sensor_drift' ELSE 'mechanical_overload' END AS family,
    us - 7200000000 AS start_us, us + 14400000000 AS end_us
  FROM telemetry WHERE signal_class = 'error' AND value > 20)"""


def quiet_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Short intervals some time after sign-ups; most hold no observation."""
    t = telemetry(spark, sf).filter(F.col("signal_class") == "signup")
    return t.select(
        "run_id", "asset_id", F.concat(F.lit("qv-"), F.col("seq").cast("string")).alias("event_id"),
        (F.col("us") + 37 * MINUTE_US).alias("start_us"), (F.col("us") + 157 * MINUTE_US).alias("end_us"),
    )


QUIET = """quiet AS (
  SELECT run_id, asset_id, 'qv-' || seq AS event_id, us + 2220000000 AS start_us, us + 9420000000 AS end_us
  FROM telemetry WHERE signal_class = 'signup')"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as feature vectors of four classes."""
    e = table(spark, sf, "embeddings")
    return e.select(
        F.concat(F.lit("class-"), (F.col("label") % 4).cast("string")).alias("asset_class"),
        F.concat(F.lit("run-"), (F.col("vec_id") % 20).cast("string")).alias("run_id"),
        F.concat(F.lit("asset-"), (F.col("vec_id") % 50).cast("string")).alias("asset_id"),
        (F.col("vec_id") * MINUTE_US).alias("window_start"),
        "vec_id",
        F.concat(F.lit("regime-"), F.floor(F.col("label") / F.lit(4)).cast("string")).alias("operating_regime"),
        F.transform("embedding", lambda x: x.cast("double")).alias("vector"),
    )


VECTORS = """vectors AS (
  SELECT 'class-' || (label % 4) AS asset_class, 'run-' || (vec_id % 20) AS run_id, 'asset-' || (vec_id % 50) AS asset_id,
    vec_id * 60000000 AS window_start, vec_id, 'regime-' || (label // 4) AS operating_regime, embedding::DOUBLE[] AS vector
  FROM embeddings),
entries AS (
  SELECT asset_class, run_id, vec_id, operating_regime, unnest(generate_series(0, len(vector) - 1)) AS position, unnest(vector) AS x
  FROM vectors)"""


def with_sql(parts: list[str], body: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body
