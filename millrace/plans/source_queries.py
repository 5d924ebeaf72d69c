"""Queries over reading, validating, writing and summarising."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.hashing import run_bucket
from millrace.functions.timeline import duration_us, floor_to
from millrace.operators.joins import truth_for_runs
from millrace.operators.reshape import common_tags, unpivot_signals
from millrace.plans.registry import registered
from millrace.plans.views import INTERVALS, SCORED, TELEMETRY, intervals, rounded, scored_windows, sql_rounded, table, telemetry, with_sql
from millrace.session import scratch_path
from millrace.sources.files import content_digests, digest_mismatches, ordered_fingerprint, read_event_intervals
from millrace.sources.sinks import (
    asset_label_counts,
    cached_features,
    partition_summary,
    write_events,
    write_partitions,
    write_predictions,
    write_scored,
)
from millrace.sources.telemetry import (
    contract_report,
    duplicate_observations,
    guard_partition,
    has_column,
    load_telemetry,
    read_wide,
    require_columns,
)

BASIC = ["run_id", "asset_id", "timestamp", "tag_id", "signal_class", "value", "quality", "is_anomaly"]


@registered(
    "mixed_files_round_trip",
    with_sql(
        [TELEMETRY],
        f"""SELECT run_id, tag_id, count(*) AS observations, {sql_rounded('sum(value)', 4)} AS total,
  count(*) FILTER (WHERE is_anomaly) AS anomalous, count(quality) AS with_quality,
  count(CASE WHEN seq % 2 = 0 THEN sampling_interval_ms END) AS with_interval, min(us) AS low, max(us) AS high
FROM telemetry GROUP BY ALL""",
    ),
)
def mixed_files(spark, sf):
    """Half the telemetry as typed Parquet, half as CSV text without one column; read back as one relation."""
    t = telemetry(spark, sf)
    root = scratch_path(spark, "mixed")
    t.filter(F.col("seq") % 2 == 0).select(*BASIC, "sampling_interval_ms").write.parquet(f"{root}/typed")
    text = t.filter(F.col("seq") % 2 != 0).withColumn("is_anomaly", F.col("is_anomaly").cast("int"))
    text = text.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    text.select(*BASIC).write.option("header", "true").csv(f"{root}/text")
    if has_column(spark, root, "no_such_column") or not has_column(spark, root, "sampling_interval_ms"):
        raise ValueError("Header probe is wrong")
    us = F.unix_micros("timestamp")
    return load_telemetry(spark, root).groupBy("run_id", "tag_id").agg(
        F.count("*").alias("observations"), rounded(F.sum("value"), 4).alias("total"),
        F.count_if("is_anomaly").alias("anomalous"), F.count("quality").alias("with_quality"),
        F.count("sampling_interval_ms").alias("with_interval"), F.min(us).alias("low"), F.max(us).alias("high"),
    )


@registered(
    "contract_violations",
    with_sql(
        [TELEMETRY],
        """SELECT count(*) AS rows, count(*) FILTER (WHERE seq % 19 = 0) AS null_required,
  count(*) FILTER (WHERE seq % 13 = 0) AS bad_quality_label, count(*) FILTER (WHERE seq % 17 = 0 AND seq % 19 <> 0) AS non_finite
FROM telemetry""",
    ),
)
def violations(spark, sf):
    t = telemetry(spark, sf)
    broken = t.withColumn("quality", F.when(F.col("seq") % 13 == 0, "excellent").otherwise(F.col("quality"))).withColumn(
        "value",
        F.when(F.col("seq") % 19 == 0, None).when(F.col("seq") % 17 == 0, F.lit(float("nan"))).otherwise(F.col("value")),
    )
    return contract_report(broken)


@registered(
    "duplicate_observations",
    with_sql(
        [TELEMETRY],
        """SELECT run_id, asset_id, us // 86400000000 AS day, tag_id, count(*) AS copies FROM telemetry
GROUP BY ALL HAVING count(*) > 1""",
    ),
)
def duplicates(spark, sf):
    t = telemetry(spark, sf).withColumn("day", F.call_function("div", F.col("us"), F.lit(86400000000)))
    return duplicate_observations(t, ["run_id", "asset_id", "day", "tag_id"])


@registered(
    "prediction_files_round_trip",
    with_sql(
        [TELEMETRY, SCORED],
        f"""SELECT fmt, asset_class, count(*) AS rows, {sql_rounded('sum(autoencoder)', 4)} AS total, max(window_end) AS last_end
FROM scored CROSS JOIN (VALUES ('jsonl'), ('parquet')) f(fmt) GROUP BY ALL""",
    ),
)
def prediction_files(spark, sf):
    s = scored_windows(spark, sf).select("run_id", "asset_id", "asset_class", "window_end", F.struct("autoencoder", "isolation").alias("scores"))
    root = scratch_path(spark, "predictions")
    lines = write_predictions(s, f"{root}/records.jsonl")
    columns = write_predictions(s, f"{root}/records.parquet")
    both = spark.read.schema(s.schema).json(lines).withColumn("fmt", F.lit("jsonl")).unionByName(
        spark.read.parquet(columns).withColumn("fmt", F.lit("parquet"))
    )
    return both.groupBy("fmt", "asset_class").agg(
        F.count("*").alias("rows"), rounded(F.sum("scores.autoencoder"), 4).alias("total"), F.max("window_end").alias("last_end")
    )


@registered(
    "event_sidecar_round_trip",
    with_sql([TELEMETRY, INTERVALS], "SELECT run_id, asset_id, event_id, start_us, end_us FROM intervals"),
)
def sidecar(spark, sf):
    path = write_events(intervals(spark, sf), f"{scratch_path(spark, 'events')}/events")
    return read_event_intervals(spark, path).select("run_id", "asset_id", "event_id", "start_us", "end_us")


@registered(
    "content_digests",
    "SELECT doc_id::VARCHAR AS name, sha256(text) AS sha256, md5(text) AS md5 FROM documents",
)
def digests(spark, sf):
    return content_digests(table(spark, sf, "documents").withColumn("name", F.col("doc_id").cast("string")), content="text")


@registered(
    "digest_mismatches",
    "SELECT doc_id::VARCHAR AS name, sha256(trim(lower(text))) AS sha256 FROM documents WHERE sha256(trim(lower(text))) <> sha256(text)",
)
def mismatches(spark, sf):
    d = table(spark, sf, "documents").withColumn("name", F.col("doc_id").cast("string"))
    expected = d.select("name", F.sha2(F.trim(F.lower("text")).cast("binary"), 256).alias("sha256"))
    return digest_mismatches(expected, content_digests(d, content="text"))


@registered(
    "content_fingerprint",
    r"""WITH digests AS (SELECT doc_id::VARCHAR AS name, sha256(text) AS sha FROM documents),
buckets AS (SELECT substr(sha256(name), 1, 3) AS bucket, sha256(string_agg(name || ':' || sha, chr(10) ORDER BY name || ':' || sha)) AS digest, count(*) AS items
  FROM digests GROUP BY ALL)
SELECT sha256(string_agg(bucket || ':' || digest, chr(10) ORDER BY bucket)) AS fingerprint, sum(items)::BIGINT AS items FROM buckets""",
)
def content_fingerprint(spark, sf):
    d = table(spark, sf, "documents").withColumn("name", F.col("doc_id").cast("string"))
    return ordered_fingerprint(content_digests(d, content="text"))


PARTITIONED = """parted AS (SELECT *, CASE WHEN bucket < 3 THEN 'train' WHEN bucket < 4 THEN 'validation' ELSE 'test' END AS partition
  FROM (SELECT *, ('0x' || substr(sha256(asset_id), 1, 8))::BIGINT % 5 AS bucket FROM telemetry))"""


def partitioned(spark, sf):
    bucket = run_bucket("asset_id", 5)
    return telemetry(spark, sf).withColumn(
        "partition", F.when(bucket < 3, "train").when(bucket < 4, "validation").otherwise("test")
    )


@registered(
    "partition_store_paths",
    with_sql(
        [TELEMETRY, PARTITIONED],
        f"SELECT partition, signal_class, count(*) AS rows, {sql_rounded('sum(value)', 4)} AS total FROM parted GROUP BY ALL",
    ),
)
def store_paths(spark, sf):
    """Partitions written as directories and recovered from the file paths."""
    path = write_partitions(partitioned(spark, sf).drop("timestamp"), scratch_path(spark, "store"))
    back = spark.read.option("recursiveFileLookup", "true").parquet(path)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"/partition=([^/]+)/", 1)
    return back.select("signal_class", "value", name.alias("partition")).groupBy("partition", "signal_class").agg(
        F.count("*").alias("rows"), rounded(F.sum("value"), 4).alias("total")
    )


@registered(
    "partition_summary",
    with_sql(
        [TELEMETRY, PARTITIONED],
        """SELECT partition, count(*) AS rows, count(*) FILTER (WHERE NOT is_anomaly) AS normal_rows, count(*) FILTER (WHERE is_anomaly) AS anomalous_rows,
  count(DISTINCT run_id) AS runs, count(DISTINCT run_id) - count(DISTINCT CASE WHEN is_anomaly THEN run_id END) AS normal_runs,
  count(DISTINCT CASE WHEN is_anomaly THEN run_id END) AS event_runs, count(DISTINCT asset_id) AS assets FROM parted GROUP BY ALL""",
    ),
)
def summary(spark, sf):
    return partition_summary(partitioned(spark, sf), ["partition"])


@registered(
    "asset_label_counts",
    with_sql(
        [TELEMETRY],
        "SELECT asset_id, count(*) FILTER (WHERE NOT is_anomaly) AS normal_rows, count(*) FILTER (WHERE is_anomaly) AS anomalous_rows FROM telemetry GROUP BY ALL",
    ),
)
def label_counts(spark, sf):
    return asset_label_counts(telemetry(spark, sf))


@registered(
    "scored_window_audit",
    with_sql(
        [TELEMETRY, SCORED],
        f"""SELECT asset_class, is_anomaly, count(*) AS windows, count(event_id) AS with_event, {sql_rounded('avg(autoencoder)')} AS autoencoder,
  {sql_rounded('avg(isolation)')} AS isolation FROM scored GROUP BY ALL""",
    ),
)
def audit(spark, sf):
    path = write_scored(scored_windows(spark, sf), f"{scratch_path(spark, 'scored')}/windows", ["autoencoder", "isolation"])
    return spark.read.parquet(path).groupBy("asset_class", "is_anomaly").agg(
        F.count("*").alias("windows"), F.count("event_id").alias("with_event"),
        rounded(F.avg("autoencoder")).alias("autoencoder"), rounded(F.avg("isolation")).alias("isolation"),
    )


@registered(
    "feature_cache_reuse",
    with_sql(
        [TELEMETRY],
        f"SELECT run_id, channel, count(*) AS n, {sql_rounded('avg(value)')} AS mean FROM telemetry GROUP BY ALL",
    ),
)
def cache_reuse(spark, sf):
    """The first call builds the table, the second must reuse it."""
    path = scratch_path(spark, "cache")
    provenance = {"data": sf, "statistic": "mean"}

    def build():
        return telemetry(spark, sf).groupBy("run_id", F.col("signal_class").alias("channel")).agg(
            F.count("*").alias("n"), rounded(F.avg("value")).alias("mean")
        )

    def refuse():
        raise ValueError("The cache was not reused")

    cached_features(spark, path, provenance, build)
    return cached_features(spark, path, provenance, refuse)


@registered(
    "truth_for_evaluated_runs",
    with_sql(
        [TELEMETRY, INTERVALS],
        """SELECT run_id, count(*) AS events FROM intervals WHERE run_id IN (SELECT run_id FROM telemetry WHERE asset_class = 'class-1')
GROUP BY ALL""",
    ),
)
def evaluated_truth(spark, sf):
    truths = intervals(spark, sf).groupBy("run_id").agg(F.count("*").alias("events"))
    evaluated = telemetry(spark, sf).filter(F.col("asset_class") == "class-1").select("run_id").join(
        truths, "run_id", "left_semi"
    )
    return truth_for_runs(truths, evaluated)


def refused(problem, action) -> bool:
    """Whether an action is refused with the given error."""
    try:
        action()
    except problem:
        return True
    return False


@registered(
    "guarded_partition_read",
    with_sql([TELEMETRY], f"SELECT asset_class, count(*) AS rows, {sql_rounded('sum(value)', 4)} AS total FROM telemetry GROUP BY ALL"),
)
def guarded_read(spark, sf):
    """A guarded partition is read only when asked for, and not without its required columns."""
    path = f"{scratch_path(spark, 'guarded')}/Challenge"
    telemetry(spark, sf).select(*BASIC, "asset_class").write.parquet(path)
    if not refused(PermissionError, lambda: load_telemetry(spark, path)):
        raise ValueError("A guarded partition was read")
    back = load_telemetry(spark, guard_partition(path, True), allow_challenge=True, validate=False)
    if not refused(ValueError, lambda: require_columns(back.drop("tag_id"))):
        raise ValueError("A required column went missing unseen")
    return require_columns(back).groupBy("asset_class").agg(F.count("*").alias("rows"), rounded(F.sum("value"), 4).alias("total"))


# Which quantity each tag of a wide instance stands for; files need not have all tags.
WIDE_TAGS = {"l_quantity": "flow", "l_extendedprice": "pressure", "l_discount": "valve", "l_tax": "temperature", "l_depth": "depth"}


@registered(
    "wide_instances",
    f"""SELECT l_returnflag, tag_id, count(*) AS rows, {sql_rounded('sum(value)', 2)} AS total, min(us) AS low, max(us) AS high FROM (
  UNPIVOT (SELECT l_returnflag, epoch_us(l_shipdate) AS us, l_quantity, l_extendedprice, CASE WHEN l_discount <> 0 THEN l_discount END AS l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME tag_id VALUE value) GROUP BY ALL""",
)
def wide_instances(spark, sf):
    """Wide instances, partly CSV with empty fields and partly Parquet, read as one relation of the tags they share."""
    instances = table(spark, sf, "lineitem").select(
        "l_returnflag", F.col("l_shipdate").cast("timestamp").alias("timestamp"), "l_linenumber",
        "l_quantity", "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax",
    )
    root, odd = scratch_path(spark, "wide"), F.col("l_linenumber") % 2 != 0
    instances.filter(~odd).write.parquet(f"{root}/typed")
    text = instances.filter(odd).withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    text.write.option("header", "true").option("emptyValue", "").csv(f"{root}/text")
    wide = read_wide(spark, root, list(WIDE_TAGS))
    tags = common_tags(wide.columns, WIDE_TAGS)
    long = unpivot_signals(wide, ["l_returnflag", "timestamp"], tags)
    us = F.unix_micros("timestamp")
    return long.groupBy("l_returnflag", "tag_id").agg(
        F.count("*").alias("rows"), rounded(F.sum("value"), 2).alias("total"), F.min(us).alias("low"), F.max(us).alias("high")
    )


# Texts, the marker they are read with, and the microseconds the SQL expects.
DURATIONS = [
    ("1h", 2, 3_600_000_000), ("1.5h", 2, 5_400_000_000), ("90min", 2, 5_400_000_000), ("90.75m", 2, 5_445_000_000),
    ("5400s", 2, 5_400_000_000), ("36s", 2, 36_000_000), ("36s", 1, 60_000_000), ("90.75m", 1, 5_400_000_000),
]


@registered(
    "windows_by_duration_text",
    with_sql(
        [TELEMETRY, "sizes(duration, marker, us) AS (VALUES " + ", ".join(f"('{d}', {m}, {us})" for d, m, us in DURATIONS) + ")"],
        """SELECT duration, marker, size_us, count(*) AS windows, max(rows) AS fullest FROM (
  SELECT duration, marker, s.us AS size_us, run_id, t.us // s.us AS w, count(*) AS rows FROM telemetry t, sizes s GROUP BY ALL) GROUP BY ALL""",
    ),
)
def duration_windows(spark, sf):
    """Windows with observations for sizes given as text, in the present and the older reading of durations."""
    sizes = F.array(*[
        F.struct(F.lit(text).alias("duration"), F.lit(marker).alias("marker"), F.lit(duration_us(text, marker)).cast("bigint").alias("size_us"),
                 floor_to("us", duration_us(text, marker)).alias("start"))
        for text, marker, _ in DURATIONS
    ])
    members = telemetry(spark, sf).select("run_id", F.explode(sizes).alias("_s")).groupBy("_s.duration", "_s.marker", "_s.size_us", "run_id", "_s.start").agg(F.count("*").alias("rows"))
    return members.groupBy("duration", "marker", "size_us").agg(F.count("*").alias("windows"), F.max("rows").alias("fullest"))
