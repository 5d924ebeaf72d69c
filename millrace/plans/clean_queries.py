"""Queries over unit conversion, channels, reshaping, selection and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.hashing import run_bucket
from millrace.operators.assembly import batch_report, combine_batches
from millrace.operators.channels import (
    COMPACT_STATISTICS,
    applicable_features,
    channel_intervals,
    class_channels,
    continuous_only,
    exclude_inputs,
    unknown_channels,
    with_channel,
)
from millrace.operators.convert import convert_units, unit_problems
from millrace.operators.reshape import (
    asset_from_path,
    blank_sentinels,
    count_sentinels,
    first_copies,
    labelled_only,
    labels_from_code,
    map_tags,
    namespaced,
    removed_copies,
    unpivot_signals,
    with_roles,
)
from millrace.operators.segments import number_segments, usable_segments
from millrace.operators.selection import bounded_runs, evenly_spread, leakage, split_by_folds, unseen_well_instances
from millrace.plans.registry import registered
from millrace.plans.source_queries import PARTITIONED, partitioned
from millrace.plans.views import TELEMETRY, rounded, sql_rounded, table, telemetry, with_sql

TARGETS = {"click": "Pa", "error": "Pa", "view": "degC", "signup": "fraction", "purchase": "m3/s"}


@registered(
    "unit_conversion",
    with_sql(
        [TELEMETRY],
        f"""SELECT asset_id, signal_class, unit, count(*) AS rows, {sql_rounded('min(value) * 1000', 6)} AS low, {sql_rounded('max(value) * 1000', 6)} AS high FROM (
  SELECT asset_id, signal_class,
    CASE signal_class WHEN 'click' THEN value * 1e5 WHEN 'error' THEN value * 1e3 WHEN 'view' THEN value * (5.0::DOUBLE / 9.0::DOUBLE) - 32.0::DOUBLE * 5.0::DOUBLE / 9.0::DOUBLE
      WHEN 'signup' THEN value * 0.01::DOUBLE ELSE value / 60000.0::DOUBLE END AS value,
    CASE signal_class WHEN 'click' THEN 'Pa' WHEN 'error' THEN 'Pa' WHEN 'view' THEN 'degC' WHEN 'signup' THEN 'fraction' ELSE 'm3/s' END AS unit
  FROM telemetry) GROUP BY ALL""",
    ),
)
def conversion(spark, sf):
    return convert_units(telemetry(spark, sf), TARGETS).groupBy("asset_id", "signal_class", "unit").agg(
        F.count("*").alias("rows"), rounded(F.min("value") * 1000).alias("low"), rounded(F.max("value") * 1000).alias("high")
    )


@registered(
    "unit_problems",
    with_sql(
        [TELEMETRY],
        """SELECT signal_class, CASE WHEN seq % 97 = 0 THEN NULL WHEN seq % 89 = 0 THEN 'furlong' ELSE unit END AS unit,
  CASE WHEN seq % 97 = 0 THEN 'missing unit' WHEN seq % 89 = 0 THEN 'unsupported source unit' ELSE 'incompatible unit' END AS problem,
  count(*) AS rows
FROM telemetry WHERE signal_class IN ('click', 'view') AND (seq % 97 = 0 OR seq % 89 = 0 OR signal_class = 'view') GROUP BY ALL""",
    ),
)
def problems(spark, sf):
    t = telemetry(spark, sf)
    unit = F.when(F.col("seq") % 97 == 0, None).when(F.col("seq") % 89 == 0, "furlong").otherwise(F.col("unit"))
    return unit_problems(t.withColumn("unit", unit), {"click": "kPa", "view": "m"})


ROLED = """roled AS (SELECT *, CASE WHEN seq % 23 = 0 THEN NULL ELSE tag_id || '-' || (seq % 3) END AS measurement_role,
  CASE seq % 10 WHEN 0 THEN 'categorical' WHEN 1 THEN NULL ELSE 'continuous' END AS value_kind FROM telemetry)"""


def roled(spark, sf):
    seq = F.col("seq")
    return telemetry(spark, sf).withColumn(
        "measurement_role", F.when(seq % 23 == 0, None).otherwise(F.concat_ws("-", "tag_id", (seq % 3).cast("string")))
    ).withColumn("value_kind", F.when(seq % 10 == 0, "categorical").when(seq % 10 == 1, None).otherwise("continuous"))


@registered(
    "continuous_channels_after_exclusion",
    with_sql(
        [TELEMETRY, ROLED],
        f"""SELECT measurement_role AS channel, count(*) AS rows, {sql_rounded('sum(value)', 4)} AS total FROM roled
WHERE signal_class <> 'signup' AND measurement_role <> 'view-1' AND (value_kind IS NULL OR value_kind = 'continuous') GROUP BY ALL""",
    ),
)
def exclusion(spark, sf):
    kept = continuous_only(exclude_inputs(roled(spark, sf), ["signup"], ["view-1"]))
    return with_channel(kept).groupBy("channel").agg(F.count("*").alias("rows"), rounded(F.sum("value"), 4).alias("total"))


@registered(
    "channel_resolution",
    with_sql(
        [TELEMETRY, ROLED],
        """SELECT 'signal_class' AS source, channel, count(*) AS rows FROM telemetry GROUP BY ALL
UNION ALL SELECT 'measurement_role', coalesce(measurement_role, 'None'), count(*) FROM roled GROUP BY ALL""",
    ),
)
def resolution(spark, sf):
    plain = with_channel(telemetry(spark, sf)).select(F.lit("signal_class").alias("source"), "channel")
    roles = with_channel(roled(spark, sf)).select(F.lit("measurement_role").alias("source"), "channel")
    return plain.unionByName(roles).groupBy("source", "channel").agg(F.count("*").alias("rows"))


@registered(
    "untrained_channels",
    with_sql([TELEMETRY], "SELECT channel, count(*) AS rows FROM telemetry WHERE channel NOT IN ('click', 'error') GROUP BY ALL"),
)
def untrained(spark, sf):
    return unknown_channels(with_channel(telemetry(spark, sf)), ["click", "error"])


MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@registered(
    "unpivot_measures",
    f"""SELECT l_returnflag, tag_id, count(*) AS rows, {sql_rounded('sum(value)', 2)} AS total FROM (
  UNPIVOT (SELECT l_returnflag, l_quantity, l_extendedprice, CASE WHEN l_discount = 0 THEN NULL ELSE l_discount END AS l_discount, l_tax FROM lineitem)
  ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME tag_id VALUE value) GROUP BY ALL""",
)
def unpivot_measures(spark, sf):
    wide = table(spark, sf, "lineitem").withColumn("l_discount", F.nullif(F.col("l_discount"), F.lit(0.0)))
    return unpivot_signals(wide, ["l_returnflag"], MEASURES).groupBy("l_returnflag", "tag_id").agg(
        F.count("*").alias("rows"), rounded(F.sum("value"), 2).alias("total")
    )


SENTINELS = {"l_discount": (0.0, 0.1), "l_tax": (0.08,)}


@registered(
    "sentinel_counts",
    """SELECT l_linestatus, count(*) FILTER (WHERE l_discount IN (0.0, 0.1) AND l_returnflag <> 'N') AS l_discount,
  count(*) FILTER (WHERE l_tax = 0.08 AND l_returnflag <> 'N') AS l_tax FROM lineitem GROUP BY ALL""",
)
def sentinel_counts(spark, sf):
    labelled = table(spark, sf, "lineitem").withColumn("label", F.nullif(F.col("l_returnflag"), F.lit("N")))
    return count_sentinels(labelled, SENTINELS, "label", ["l_linestatus"])


@registered(
    "sentinels_blanked_labelled_rows",
    f"""SELECT l_returnflag AS label, count(*) AS rows, count(*) FILTER (WHERE l_discount NOT IN (0.0, 0.1)) AS discounts,
  {sql_rounded('avg(CASE WHEN l_tax <> 0.08 THEN l_tax END)')} AS tax FROM lineitem WHERE l_returnflag <> 'N' GROUP BY ALL""",
)
def sentinels_blanked(spark, sf):
    labelled = table(spark, sf, "lineitem").withColumn("label", F.nullif(F.col("l_returnflag"), F.lit("N")))
    kept = labelled_only(blank_sentinels(labelled, SENTINELS), "label")
    return kept.groupBy("label").agg(
        F.count("*").alias("rows"), F.count("l_discount").alias("discounts"), rounded(F.avg("l_tax")).alias("tax")
    )


TAGS = {
    "click": ("interaction", "1"), "error": ("fault", "1"), "purchase": ("revenue", "a"),
    "signup": ("growth", "1"), "view": ("interaction", "1"),
}


@registered(
    "tag_mapping",
    """SELECT CASE event_type WHEN 'click' THEN 'interaction' WHEN 'view' THEN 'interaction' WHEN 'error' THEN 'fault'
    WHEN 'purchase' THEN 'revenue' ELSE 'growth' END AS signal_class, CASE event_type WHEN 'purchase' THEN 'a' ELSE '1' END AS unit,
  count(*) AS rows FROM events GROUP BY ALL""",
)
def tag_mapping(spark, sf):
    return map_tags(telemetry(spark, sf).select("tag_id"), TAGS).groupBy("signal_class", "unit").agg(F.count("*").alias("rows"))


@registered(
    "labels_from_codes",
    """SELECT l_linenumber <> 1 AS is_anomaly, CASE WHEN l_linenumber <> 1 THEN 'supp-' || l_suppkey || ':' || (l_linenumber - 1) END AS event_id,
  count(*) AS rows FROM lineitem GROUP BY ALL""",
)
def codes(spark, sf):
    coded = table(spark, sf, "lineitem").select(
        F.concat(F.lit("supp-"), F.col("l_suppkey").cast("string")).alias("run_id"), (F.col("l_linenumber") - 1).alias("code")
    )
    return labels_from_code(coded, "code").groupBy("is_anomaly", "event_id").agg(F.count("*").alias("rows"))


GAP_DAYS = 60
SEGMENTS = f"""history AS (SELECT o_custkey AS source, epoch_us(o_orderdate) AS us, (o_orderstatus = 'F')::INTEGER AS label FROM orders WHERE o_orderstatus <> 'P'),
flagged AS (SELECT *, CASE WHEN lag(us) OVER w IS NOT NULL AND (lag(label) OVER w <> label
    OR us // 1000 - lag(us) OVER w // 1000 > {GAP_DAYS * 86_400_000}) THEN 1 ELSE 0 END AS brk FROM history WINDOW w AS (PARTITION BY source ORDER BY us, label)),
numbered AS (SELECT *, sum(brk) OVER (PARTITION BY source ORDER BY us, label RANGE UNBOUNDED PRECEDING)::BIGINT AS segment FROM flagged)"""


def segmented(spark, sf):
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") != "P")
    history = o.select(
        F.col("o_custkey").alias("source"),
        F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("us"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
    )
    year_us = 365 * 86_400_000_000
    return number_segments(history, ["source"], "us", "label", GAP_DAYS * 86_400_000, year_us)


@registered(
    "segments_by_label_and_gap",
    with_sql([SEGMENTS], "SELECT source, segment, count(*) AS rows, min(us) AS first_us, max(us) AS last_us, max(label) AS label FROM numbered GROUP BY ALL"),
)
def segments(spark, sf):
    return segmented(spark, sf).groupBy("source", "segment").agg(
        F.count("*").alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.max("label").alias("label")
    )


@registered(
    "usable_segments",
    with_sql(
        [SEGMENTS],
        """SELECT 'v1__customer-' || source || '__segment-' || lpad(segment::VARCHAR, greatest(3, len(segment::VARCHAR))::INTEGER, '0') AS run_id, count(*) AS rows
FROM numbered GROUP BY source, segment HAVING count(*) >= 2""",
    ),
)
def segments_usable(spark, sf):
    prefix = F.concat(F.lit("v1__customer-"), F.col("source").cast("string"))
    return usable_segments(segmented(spark, sf), prefix).groupBy("run_id").agg(F.count("*").alias("rows"))


DEDUP_KEY = ["l_suppkey", "l_linenumber", "l_returnflag"]


@registered(
    "first_copies_kept",
    """SELECT l_suppkey, l_linenumber, l_returnflag, l_orderkey, l_partkey, l_quantity, copies FROM (
  SELECT *, row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag ORDER BY l_orderkey, l_partkey, l_quantity) AS rn,
    count(*) OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag) AS copies FROM lineitem) WHERE rn = 1""",
)
def copies(spark, sf):
    rows = table(spark, sf, "lineitem").select(*DEDUP_KEY, "l_orderkey", "l_partkey", "l_quantity")
    return first_copies(rows, DEDUP_KEY, ["l_orderkey"]).withColumnRenamed("_copies", "copies")


@registered(
    "copies_removed",
    """SELECT l_returnflag, count(*) AS kept, (sum(copies) - count(*))::BIGINT AS removed FROM (
  SELECT l_suppkey, l_linenumber, l_returnflag, count(*) AS copies FROM lineitem GROUP BY ALL) GROUP BY ALL""",
)
def copies_removed(spark, sf):
    rows = table(spark, sf, "lineitem").select(*DEDUP_KEY, "l_orderkey", "l_partkey", "l_quantity")
    return removed_copies(first_copies(rows, DEDUP_KEY, ["l_orderkey"]), ["l_returnflag"])


@registered(
    "assets_from_names",
    r"""SELECT s_name AS path, CASE WHEN s_suppkey % 5 = 0 THEN 'unknown' ELSE 'WELL-' || lpad(s_suppkey::VARCHAR, 5, '0') END AS asset_id FROM supplier""",
)
def asset_names(spark, sf):
    s = table(spark, sf, "supplier")
    stem = F.when(F.col("s_suppkey") % 5 == 0, F.lit("0/SIMULATED_")).otherwise(F.lit("0/well-"))
    path = F.concat(stem, F.col("s_suppkey").cast("string"), F.lit("_2020.csv"))
    return s.select(F.col("s_name").alias("path"), asset_from_path(path).alias("asset_id"))


def spread_sql(source: str, keys: str, order: str, limit: int) -> str:
    pick = (
        f"rn - 1 = n // 2" if limit == 1
        else f"rn - 1 IN (SELECT round_even(i * (n - 1) / {limit - 1}.0::DOUBLE, 0) FROM range({limit}) r(i))"
    )
    return f"""SELECT {keys}, {order} FROM (SELECT {keys}, {order}, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS rn,
  count(*) OVER (PARTITION BY {keys}) AS n FROM {source}) WHERE n <= {limit} OR {pick}"""


@registered("evenly_spread_names", spread_sql("customer", "c_nationkey", "c_name", 4))
def spread_names(spark, sf):
    return evenly_spread(table(spark, sf, "customer"), ["c_nationkey"], "c_name", 4)


@registered("middle_name", spread_sql("customer", "c_nationkey", "c_name", 1))
def middle_name(spark, sf):
    return evenly_spread(table(spark, sf, "customer"), ["c_nationkey"], "c_name", 1)


WELLS = """instances AS (SELECT (o_orderkey % 10) || '/WELL-' || lpad((o_custkey % 43)::VARCHAR, 5, '0') || '_' || o_orderkey AS path, o_orderkey % 10 AS code,
  o_custkey % 43 AS well, o_orderkey * 7919 % 100003 AS size, o_orderstatus AS release, CASE WHEN o_orderkey % 3 = 0 THEN 109 ELSE 0 END AS label FROM orders),
v1 AS (SELECT * FROM instances WHERE release <> 'O'), v2 AS (SELECT * FROM instances WHERE release = 'O')"""


@registered(
    "unseen_well_selection",
    with_sql(
        [WELLS],
        "SELECT DISTINCT partition, path FROM ("
        + " UNION ALL ".join(
            [
                "SELECT 'train' AS partition, path FROM (" + spread_sql("(SELECT * FROM v1 WHERE code = 0 AND well IN (1, 2, 4, 5))", "well", "path", 12) + ")",
                "SELECT 'validation', path FROM (" + spread_sql("(SELECT * FROM v1 WHERE code = 0 AND well IN (6, 7, 8))", "well", "path", 12) + ")",
                "SELECT 'validation', path FROM v1 WHERE well IN (6, 7, 8) AND code BETWEEN 1 AND 8",
                "SELECT 'test', path FROM (" + spread_sql("(SELECT * FROM v2 WHERE code = 0 AND well = 19)", "well", "path", 1) + ")",
                "SELECT 'test', path FROM ("
                + spread_sql("(SELECT * FROM v2 WHERE code BETWEEN 1 AND 8 AND (well = 19 OR well BETWEEN 21 AND 32))", "well", "path", 1)
                + ")",
                """SELECT 'challenge', path FROM (SELECT path, row_number() OVER (PARTITION BY well ORDER BY size, path) AS rn FROM v2
  WHERE code = 9 AND well IN (14, 16, 20, 37, 40, 41, 42) AND label IN (9, 109)) WHERE rn = 1""",
            ]
        )
        + ")",
    ),
)
def wells(spark, sf):
    key, well = F.col("o_orderkey"), F.col("o_custkey") % 43
    inst = table(spark, sf, "orders").select(
        F.concat((key % 10).cast("string"), F.lit("/WELL-"), F.lpad(well.cast("string"), 5, "0"), F.lit("_"), key.cast("string")).alias("path"),
        (key % 10).alias("code"), well.alias("well"), (key * 7919 % 100003).alias("size"), F.col("o_orderstatus").alias("release"),
        F.when(key % 3 == 0, 109).otherwise(0).alias("label"),
    )
    second = inst.filter(F.col("release") == "O")
    return unseen_well_instances(inst.filter(F.col("release") != "O"), second, second.select("path", "label"))


@registered(
    "fold_split",
    """WITH folds AS (SELECT l_orderkey * 10 + l_linenumber + l_partkey * 1000000 AS entry, (l_suppkey % 3) || '/' || l_partkey AS path, (l_linenumber % 5)::INTEGER AS fold FROM lineitem),
placed AS (SELECT *, CASE WHEN fold IN (0, 1) THEN 'train' WHEN fold = 2 THEN 'validation' WHEN fold = 4 THEN 'test' END AS partition FROM folds),
firsts AS (SELECT partition, path, min(entry) AS first FROM placed WHERE partition IS NOT NULL AND (partition <> 'train' OR path LIKE '0/%') GROUP BY ALL)
SELECT partition, state, count(*) AS entries FROM (
  SELECT p.partition, CASE WHEN p.entry > f.first THEN 'duplicate' WHEN i.path IS NULL THEN 'missing' ELSE 'selected' END AS state
  FROM placed p JOIN firsts f USING (partition, path)
  LEFT JOIN (SELECT DISTINCT (p_partkey % 3) || '/' || p_partkey AS path FROM part) i USING (path)) GROUP BY ALL""",
)
def folds(spark, sf):
    li = table(spark, sf, "lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber") + F.col("l_partkey") * 1000000).alias("entry"),
        F.concat((F.col("l_suppkey") % 3).cast("string"), F.lit("/"), F.col("l_partkey").cast("string")).alias("path"),
        (F.col("l_linenumber") % 5).alias("fold"),
    )
    inventory = table(spark, sf, "part").select(
        F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("/"), F.col("p_partkey").cast("string")).alias("path")
    )
    return split_by_folds(li, inventory).groupBy("partition", "state").agg(F.count("*").alias("entries"))


@registered(
    "roles_and_value_kinds",
    """SELECT event_type AS measurement_role, CASE WHEN event_id % 4 = 0 THEN 'categorical' ELSE 'continuous' END AS value_kind,
  CASE event_id % 3 WHEN 0 THEN 'good' WHEN 1 THEN 'uncertain' END AS quality, count(*) AS rows FROM events GROUP BY ALL""",
)
def roles(spark, sf):
    seq = F.col("seq")
    t = telemetry(spark, sf).withColumn("unit", F.when(seq % 8 == 0, "ENUM").when(seq % 4 == 0, "Code").otherwise("bar"))
    t = t.withColumn("quality", F.when(seq % 3 == 0, "GOOD").when(seq % 3 == 1, "Uncertain"))
    return with_roles(t).groupBy("measurement_role", "value_kind", "quality").agg(F.count("*").alias("rows"))


@registered(
    "namespaced_identifiers",
    with_sql(
        [TELEMETRY],
        "SELECT 'dev-1::' || run_id AS run_id, CASE WHEN event_id IS NOT NULL THEN 'dev-1::' || event_id END AS event_id, count(*) AS rows FROM telemetry GROUP BY ALL",
    ),
)
def identifiers(spark, sf):
    return namespaced(telemetry(spark, sf), "dev-1").groupBy("run_id", "event_id").agg(F.count("*").alias("rows"))


@registered(
    "batch_assembly",
    with_sql(
        [TELEMETRY],
        """SELECT 'dev-' || substr(asset_class, 7) AS source_dataset_id, count(*) AS rows, count(DISTINCT run_id) AS runs, 0::BIGINT AS unnamed_runs,
  0::BIGINT AS duplicate_rows, 0::BIGINT AS unlabelled_rows, count(*) FILTER (WHERE is_anomaly) AS anomalous_rows FROM telemetry GROUP BY ALL""",
    ),
)
def assembly(spark, sf):
    t = telemetry(spark, sf)
    parts = {f"dev-{i}": t.filter(F.col("asset_class") == f"class-{i}") for i in range(4)}
    return batch_report(combine_batches(parts))


RUNS = """runs AS (SELECT CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS partition, 'user-' || user_id AS run_id,
  CASE WHEN user_id % 3 = 1 THEN 'user-' || user_id >= 'user-3' ELSE bool_or(value > 300) END AS has_events FROM events GROUP BY user_id)"""


@registered(
    "bounded_run_selection",
    with_sql(
        [
            RUNS,
            "ranked AS (SELECT *, row_number() OVER (PARTITION BY partition ORDER BY run_id) AS rn FROM runs WHERE partition <> 'train' OR NOT has_events)",
            "validation AS (SELECT * FROM ranked WHERE partition = 'validation')",
            """chosen AS (SELECT (SELECT count(*) FROM validation WHERE rn <= 4 AND NOT has_events) AS calm, (SELECT count(*) FROM validation WHERE rn <= 4 AND has_events) AS eventful,
  (SELECT min(run_id) FROM validation WHERE NOT has_events) AS first_calm, (SELECT min(run_id) FROM validation WHERE has_events) AS first_event)""",
        ],
        """SELECT partition, run_id, has_events FROM ranked WHERE partition = 'train' AND rn <= 3
UNION ALL SELECT partition, run_id, has_events FROM ranked WHERE partition = 'test'
UNION ALL SELECT partition, run_id, has_events FROM validation, chosen WHERE
  (rn <= 4 AND NOT (rn = 4 AND ((calm = 0 AND first_calm IS NOT NULL AND first_event IS NOT NULL) OR (eventful = 0 AND first_calm IS NOT NULL AND first_event IS NOT NULL))))
  OR (calm = 0 AND first_event IS NOT NULL AND run_id = first_calm) OR (eventful = 0 AND first_calm IS NOT NULL AND run_id = first_event)""",
    ),
)
def run_selection(spark, sf):
    user = F.col("user_id")
    by_user = table(spark, sf, "events").groupBy("user_id").agg(F.bool_or(F.col("value") > 300).alias("_high"))
    run = F.concat(F.lit("user-"), user.cast("string"))
    runs = by_user.select(
        F.when(user % 3 == 0, "train").when(user % 3 == 1, "validation").otherwise("test").alias("partition"),
        run.alias("run_id"),
        F.when(user % 3 == 1, run >= "user-3").otherwise(F.col("_high")).alias("has_events"),
    )
    return bounded_runs(runs, {"train": 3, "validation": 4, "test": None})


@registered(
    "whole_run_hash_split",
    """SELECT asset_id, ('0x' || substr(sha256(asset_id), 1, 8))::BIGINT % 5 AS early_stop, ('0x' || substr(sha256(asset_id), 1, 8))::BIGINT % 2 AS calibration
FROM (SELECT DISTINCT 'user-' || user_id AS asset_id FROM events)""",
)
def hash_split(spark, sf):
    assets = telemetry(spark, sf).select("asset_id").distinct()
    return assets.select("asset_id", run_bucket("asset_id", 5).alias("early_stop"), run_bucket("asset_id", 2).alias("calibration"))


@registered(
    "partition_leakage",
    with_sql(
        [TELEMETRY, PARTITIONED],
        """SELECT run_id, count(DISTINCT partition) AS partitions, min(partition) AS first, max(partition) AS last FROM parted
GROUP BY ALL HAVING count(DISTINCT partition) > 1""",
    ),
)
def partition_leakage(spark, sf):
    return leakage(partitioned(spark, sf), "run_id")


APPLIES = "signal_class <> 'signup' OR asset_class = 'class-2'"


@registered(
    "class_applicable_features",
    with_sql(
        [TELEMETRY],
        f"""SELECT asset_class, string_agg(channel || '_' || stat, ',' ORDER BY channel, place) AS features, count(*) AS width
FROM (SELECT DISTINCT asset_class, channel FROM telemetry WHERE {APPLIES}),
  (SELECT unnest({list(COMPACT_STATISTICS)}) AS stat, generate_subscripts({list(COMPACT_STATISTICS)}, 1) AS place) GROUP BY ALL""",
    ),
)
def class_features(spark, sf):
    t = with_channel(telemetry(spark, sf)).filter(APPLIES)
    names = applicable_features(F.col("channels"), COMPACT_STATISTICS)
    return class_channels(t).select(
        "asset_class", F.concat_ws(",", names).alias("features"), F.size(names).cast("bigint").alias("width")
    )


@registered(
    "channel_median_intervals",
    with_sql(
        [TELEMETRY],
        f"""SELECT channel, {sql_rounded('median(CASE WHEN sampling_interval_ms IS NOT NULL THEN 1000.0::DOUBLE * (1 + seq % 37) END)')} AS median_interval_ms,
  count(sampling_interval_ms) AS n FROM telemetry GROUP BY ALL""",
    ),
)
def median_intervals(spark, sf):
    t = with_channel(telemetry(spark, sf))
    varied = t.withColumn(
        "sampling_interval_ms", F.when(F.col("sampling_interval_ms").isNotNull(), F.lit(1000.0) * (1 + F.col("seq") % 37))
    )
    return channel_intervals(varied).select("channel", rounded("median_interval_ms").alias("median_interval_ms"), "n")
