"""Queries over interval joins, metrics, resampling and experiment tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.timeline import HOUR_US
from millrace.operators.bootstrap import count_change_interval, draw_runs, event_rate_interval, window_metric_intervals
from millrace.operators.calibration import score_summary
from millrace.operators.intervals import (
    PHYSICAL_FAMILIES,
    annotate,
    event_details,
    event_summary,
    family_summary,
    interval_problems,
    label_windows,
)
from millrace.operators.joins import complete_lookup, restrict, unmatched_rows, with_bounds
from millrace.operators.metrics import by_detector, evaluate_windows, ranking_quality, threshold_sweep
from millrace.operators.study import (
    ablation_candidates,
    candidate_means,
    dispersion,
    eligible_candidates,
    finalists,
    mean_ranks,
    operating_points,
    paired_differences,
    paired_values,
)
from millrace.operators.tiling import complete_tiles, tail_accounting, tile_scores
from millrace.plans.registry import registered
from millrace.plans.views import (
    INTERVALS,
    QUIET,
    SCORED,
    TELEMETRY,
    intervals,
    quiet_intervals,
    rounded,
    scored_windows,
    sql_rounded,
    table,
    telemetry,
    with_sql,
)

METRICS = (
    "precision", "recall", "f1", "false_positives_per_asset_hour", "false_positives_per_asset_day",
    "pr_auc", "roc_auc", "event_detection_rate", "mean_detection_latency_seconds",
)
COUNTS = ("samples", "positive_samples", "alerts", "false_positive_windows", "event_count")


def tidy(df, keys, metrics=METRICS, counts=COUNTS):
    return df.select(*keys, *counts, *[rounded(m).alias(m) for m in metrics])


def metric_sql(source: str, keys: str, score: str, alert: str, seconds: float, label: str = "is_anomaly", tag: str = "") -> list[str]:
    """CTEs ending in ``metrics{tag}``."""
    return [
        f"""points{tag} AS (SELECT {keys}, {score} AS s, count(*) AS a, count(*) FILTER (WHERE {label}) AS p FROM {source} GROUP BY ALL)""",
        f"""curve{tag} AS (SELECT *, sum(p) OVER down AS pu, sum(a) OVER down AS au, sum(p) OVER (PARTITION BY {keys}) AS pt, sum(a) OVER (PARTITION BY {keys}) AS at_
  FROM points{tag} WINDOW down AS (PARTITION BY {keys} ORDER BY s DESC))""",
        f"""quality{tag} AS (SELECT {keys}, CASE WHEN max(pt) > 0 THEN sum(p / pt * (pu / au)) END AS pr_auc,
  CASE WHEN max(pt) > 0 AND max(at_) > max(pt) THEN sum((a - p) * (pu - p / 2.0::DOUBLE)) / (max(pt) * (max(at_) - max(pt))) END AS roc_auc FROM curve{tag} GROUP BY ALL)""",
        f"""confusion{tag} AS (SELECT {keys}, count(*) AS samples, count(*) FILTER (WHERE {label}) AS positive_samples, count(*) FILTER (WHERE {alert}) AS alerts,
  count(*) FILTER (WHERE {alert} AND {label}) AS hits, count(*) FILTER (WHERE {alert} AND NOT {label}) AS false_positive_windows FROM {source} GROUP BY ALL)""",
        f"""hits{tag} AS (SELECT {keys}, event_id, bool_or({alert}) AS detected, min(event_start_us) AS onset, min(CASE WHEN {alert} THEN window_end END) AS first_end
  FROM {source} WHERE event_id IS NOT NULL AND event_id <> '' GROUP BY ALL)""",
        f"""rates{tag} AS (SELECT {keys}, count(*) AS event_count, count(*) FILTER (WHERE detected) / count(*) AS event_detection_rate,
  avg(CASE WHEN first_end IS NOT NULL AND onset IS NOT NULL THEN greatest(0.0::DOUBLE, (first_end - onset) / 1e6) END) AS mean_detection_latency_seconds FROM hits{tag} GROUP BY ALL)""",
        f"""metrics{tag} AS (SELECT *, CASE WHEN alerts = 0 THEN 0.0 ELSE hits / alerts END AS precision, CASE WHEN positive_samples = 0 THEN 0.0 ELSE hits / positive_samples END AS recall,
  CASE WHEN alerts + positive_samples = 0 THEN 0.0 ELSE 2.0::DOUBLE * hits / (alerts + positive_samples) END AS f1,
  false_positive_windows / (samples * {seconds}::DOUBLE / 3600) AS false_positives_per_asset_hour,
  false_positive_windows / (samples * {seconds}::DOUBLE / 86400) AS false_positives_per_asset_day
  FROM confusion{tag} JOIN quality{tag} USING ({keys}) LEFT JOIN rates{tag} USING ({keys}))""",
    ]


def metric_select(keys: str, tag: str = "", metrics=METRICS, counts=COUNTS) -> str:
    columns = [f"coalesce({c}, 0)::BIGINT AS {c}" for c in counts] + [f"{sql_rounded(m + '::DOUBLE')} AS {m}" for m in metrics]
    return f"SELECT {keys}, {', '.join(columns)} FROM metrics{tag}"


THRESHOLD = 0.6
STEP_SECONDS = 21600.0


@registered(
    "window_metrics_by_class",
    with_sql([TELEMETRY, SCORED, *metric_sql("scored", "asset_class", "autoencoder", "autoencoder >= 0.6", STEP_SECONDS)], metric_select("asset_class")),
)
def metrics_by_class(spark, sf):
    return tidy(evaluate_windows(scored_windows(spark, sf), ["asset_class"], "autoencoder", THRESHOLD, window_seconds=STEP_SECONDS), ["asset_class"])


DETECTED = """detected AS (SELECT * EXCLUDE (autoencoder, isolation), 'autoencoder' AS detector, autoencoder AS score FROM scored
  UNION ALL SELECT * EXCLUDE (autoencoder, isolation), 'isolation', isolation FROM scored)"""


@registered(
    "window_metrics_by_detector",
    with_sql([TELEMETRY, SCORED, DETECTED, *metric_sql("detected", "detector", "score", "score >= 0.6", STEP_SECONDS)], metric_select("detector")),
)
def metrics_by_detector(spark, sf):
    long = by_detector(scored_windows(spark, sf), ["autoencoder", "isolation"])
    return tidy(evaluate_windows(long, ["detector"], "score", THRESHOLD, window_seconds=STEP_SECONDS), ["detector"])


@registered(
    "ranking_quality_of_text_length",
    with_sql(
        [
            "judged AS (SELECT lang, (quality = 1) AS good, n_chars::DOUBLE AS s FROM labels JOIN documents USING (doc_id))",
            "points AS (SELECT lang, s, count(*) AS a, count(*) FILTER (WHERE good) AS p FROM judged GROUP BY ALL)",
            """curve AS (SELECT *, sum(p) OVER (PARTITION BY lang ORDER BY s DESC) AS pu, sum(a) OVER (PARTITION BY lang ORDER BY s DESC) AS au,
  sum(p) OVER (PARTITION BY lang) AS pt, sum(a) OVER (PARTITION BY lang) AS at_ FROM points)""",
        ],
        f"""SELECT lang, {sql_rounded('CASE WHEN max(pt) > 0 THEN sum(p / pt * (pu / au)) END')} AS pr_auc,
  {sql_rounded('CASE WHEN max(pt) > 0 AND max(at_) > max(pt) THEN sum((a - p) * (pu - p / 2.0::DOUBLE)) / (max(pt) * (max(at_) - max(pt))) END')} AS roc_auc FROM curve GROUP BY ALL""",
    ),
)
def text_ranking(spark, sf):
    judged = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    rows = judged.select("lang", (F.col("quality") == 1).alias("good"), F.col("n_chars").cast("double").alias("s"))
    out = ranking_quality(rows, ["lang"], "good", "s")
    return out.select("lang", rounded("pr_auc").alias("pr_auc"), rounded("roc_auc").alias("roc_auc"))


@registered(
    "interval_annotation",
    with_sql(
        [
            TELEMETRY,
            INTERVALS,
            """matched AS (SELECT t.seq, arg_min(i.event_id, (i.start_us, i.event_id)) AS event_id, min(i.start_us) AS event_start_us FROM telemetry t
  JOIN intervals i ON t.run_id = i.run_id AND t.asset_id = i.asset_id AND t.us BETWEEN i.start_us AND i.end_us GROUP BY ALL)""",
        ],
        "SELECT t.seq, m.event_id IS NOT NULL AS is_anomaly, m.event_id, m.event_start_us FROM telemetry t LEFT JOIN matched m USING (seq)",
    ),
)
def annotation(spark, sf):
    return annotate(telemetry(spark, sf), intervals(spark, sf)).select("seq", "is_anomaly", "event_id", "event_start_us")


@registered(
    "interval_annotation_with_nearest",
    with_sql(
        [
            TELEMETRY,
            QUIET,
            "times AS (SELECT DISTINCT run_id, asset_id, us FROM telemetry)",
            """pairs AS (SELECT q.*, t.us, t.us BETWEEN q.start_us AND q.end_us AS inside, abs(t.us - (q.start_us + q.end_us) // 2) AS distance
  FROM quiet q JOIN times t USING (run_id, asset_id))""",
            """ranked AS (SELECT *, bool_or(inside) OVER e AS observed, row_number() OVER (PARTITION BY run_id, asset_id, event_id ORDER BY distance, us) AS rn
  FROM pairs WINDOW e AS (PARTITION BY run_id, asset_id, event_id))""",
            """marked AS (SELECT run_id, asset_id, us, arg_min(event_id, (start_us, event_id)) AS event_id, min(start_us) AS event_start_us FROM ranked
  WHERE inside OR (NOT observed AND rn = 1) GROUP BY ALL)""",
        ],
        "SELECT t.seq, m.event_id IS NOT NULL AS is_anomaly, m.event_id, m.event_start_us FROM telemetry t LEFT JOIN marked m USING (run_id, asset_id, us)",
    ),
)
def annotation_nearest(spark, sf):
    return annotate(telemetry(spark, sf), quiet_intervals(spark, sf)).select("seq", "is_anomaly", "event_id", "event_start_us")


OVERLAP = "s.run_id = i.run_id AND s.asset_id = i.asset_id AND s.window_start <= i.end_us AND s.window_end > i.start_us"


@registered(
    "window_event_overlap",
    with_sql(
        [TELEMETRY, SCORED, INTERVALS],
        f"SELECT s.seq, EXISTS (SELECT 1 FROM intervals i WHERE {OVERLAP}) AS overlaps_event FROM scored s",
    ),
)
def overlap(spark, sf):
    return label_windows(scored_windows(spark, sf), intervals(spark, sf)).select("seq", "overlaps_event")


DETAILS = f"""details AS (SELECT i.run_id, i.asset_id, i.event_id, i.family, count(s.seq) > 0 AS observable, count(s.seq) FILTER (WHERE s.autoencoder >= 0.6) > 0 AS detected,
  (min(CASE WHEN s.autoencoder >= 0.6 THEN s.window_end END) - i.start_us) / 1e6 AS latency_seconds
  FROM intervals i LEFT JOIN scored s ON {OVERLAP} GROUP BY i.run_id, i.asset_id, i.event_id, i.family, i.start_us)"""


def details(spark, sf, score="autoencoder", threshold=THRESHOLD):
    return event_details(intervals(spark, sf), scored_windows(spark, sf), score, threshold)


@registered(
    "event_interval_details",
    with_sql([TELEMETRY, SCORED, INTERVALS, DETAILS], f"SELECT event_id, observable, detected, {sql_rounded('latency_seconds')} AS latency_seconds FROM details"),
)
def interval_details(spark, sf):
    return details(spark, sf).select("event_id", "observable", "detected", rounded("latency_seconds").alias("latency_seconds"))


@registered(
    "event_interval_summary",
    with_sql(
        [TELEMETRY, SCORED, INTERVALS, DETAILS],
        f"""SELECT run_id, count(*) AS event_count, count(*) FILTER (WHERE detected) AS detected_events, count(*) FILTER (WHERE NOT observable) AS events_without_windows,
  {sql_rounded('count(*) FILTER (WHERE detected) / count(*)')} AS event_detection_rate, {sql_rounded('avg(latency_seconds)', 4)} AS mean_detection_latency_seconds FROM details GROUP BY ALL""",
    ),
)
def interval_summary(spark, sf):
    out = event_summary(details(spark, sf), ["run_id"])
    return out.select(
        "run_id", "event_count", "detected_events", "events_without_windows", rounded("event_detection_rate").alias("event_detection_rate"),
        rounded("mean_detection_latency_seconds", 4).alias("mean_detection_latency_seconds"),
    )


@registered(
    "detections_by_family",
    with_sql(
        [TELEMETRY, SCORED, INTERVALS, DETAILS],
        """SELECT 'family' AS scope, family, count(*) AS events, count(*) FILTER (WHERE detected) AS detected FROM details GROUP BY ALL
UNION ALL SELECT 'subtotal', 'physical', count(*), count(*) FILTER (WHERE detected) FROM details
  WHERE family IN ('cavitation', 'bearing_degradation', 'cooling_degradation', 'mechanical_overload')""",
    ),
)
def by_family(spark, sf):
    return family_summary(details(spark, sf))


@registered(
    "interval_problems",
    with_sql(
        [TELEMETRY, INTERVALS],
        """SELECT run_id, asset_id, family AS event_id, count(*) AS copies, count(*) FILTER (WHERE end_us - 43200000000 < start_us) AS inverted FROM intervals
GROUP BY ALL HAVING count(*) > 1 OR count(*) FILTER (WHERE end_us - 43200000000 < start_us) > 0""",
    ),
)
def bad_intervals(spark, sf):
    broken = intervals(spark, sf).withColumn("event_id", F.col("family")).withColumn("end_us", F.col("end_us") - 12 * HOUR_US)
    return interval_problems(broken)


@registered(
    "restricted_to_grid",
    with_sql(
        [TELEMETRY],
        """SELECT count(*) AS observations, count(DISTINCT asset_id) AS assets FROM telemetry t
WHERE EXISTS (SELECT 1 FROM telemetry g WHERE g.asset_id = t.asset_id AND g.us // 86400000000 = t.us // 86400000000 AND g.value > 150)""",
    ),
)
def grid(spark, sf):
    t = telemetry(spark, sf).withColumn("day", F.call_function("div", F.col("us"), F.lit(86400000000)))
    kept = restrict(t, t.filter(F.col("value") > 150), ["asset_id", "day"])
    return kept.agg(F.count("*").alias("observations"), F.count_distinct("asset_id").alias("assets"))


@registered(
    "complete_lookup",
    with_sql(
        [TELEMETRY],
        f"""SELECT asset_class, {sql_rounded('avg(value / peak)')} AS relative, count(*) AS rows FROM telemetry
JOIN (SELECT asset_id, max(value) AS peak FROM telemetry GROUP BY ALL) USING (asset_id) GROUP BY ALL""",
    ),
)
def lookup(spark, sf):
    t = telemetry(spark, sf)
    peaks = t.groupBy("asset_id").agg(F.max("value").alias("peak"))
    return complete_lookup(t, peaks, ["asset_id"], "peak").groupBy("asset_class").agg(
        rounded(F.avg(F.col("value") / F.col("peak"))).alias("relative"), F.count("*").alias("rows")
    )


BOUNDED = """bounded AS (SELECT s.*, b.low AS first_observation, b.high AS watermark, s.window_end <= b.high AS retained FROM scored s
  JOIN (SELECT run_id, asset_id, min(us) AS low, max(us) AS high FROM telemetry GROUP BY ALL) b USING (run_id, asset_id))"""


@registered(
    "windows_with_observed_bounds",
    with_sql([TELEMETRY, SCORED, BOUNDED], "SELECT seq, first_observation, watermark, retained FROM bounded"),
)
def bounds(spark, sf):
    return with_bounds(scored_windows(spark, sf), telemetry(spark, sf)).select("seq", "first_observation", "watermark", "retained")


@registered(
    "tail_accounting",
    with_sql(
        [TELEMETRY, SCORED, BOUNDED],
        f"""SELECT original_windows, retained_windows, original_windows - retained_windows AS excluded_windows, excluded_positive_windows, {sql_rounded('hours', 4)} AS observed_asset_hours,
  {sql_rounded('retained_windows * 6.0::DOUBLE', 4)} AS retained_window_asset_hours, {sql_rounded('f / (hours / 24)')} AS false_alerts_per_observed_day,
  {sql_rounded('fk / (hours / 24)')} AS retained_false_alerts_per_observed_day
FROM (SELECT count(*) AS original_windows, count(*) FILTER (WHERE retained) AS retained_windows, count(*) FILTER (WHERE NOT retained AND is_anomaly) AS excluded_positive_windows,
    count(*) FILTER (WHERE autoencoder >= 0.6 AND NOT is_anomaly) AS f, count(*) FILTER (WHERE autoencoder >= 0.6 AND NOT is_anomaly AND retained) AS fk FROM bounded),
  (SELECT sum((w - f) / 3.6e9) AS hours FROM (SELECT DISTINCT run_id, asset_id, watermark AS w, first_observation AS f FROM bounded))""",
    ),
)
def tails(spark, sf):
    out = tail_accounting(with_bounds(scored_windows(spark, sf), telemetry(spark, sf)), "autoencoder", THRESHOLD, STEP_SECONDS)
    four = ("observed_asset_hours", "retained_window_asset_hours")
    six = ("false_alerts_per_observed_day", "retained_false_alerts_per_observed_day")
    return out.select(
        "original_windows", "retained_windows", "excluded_windows", "excluded_positive_windows",
        *[rounded(c, 4).alias(c) for c in four], *[rounded(c).alias(c) for c in six],
    )


@registered(
    "threshold_sweep",
    with_sql(
        [
            TELEMETRY,
            SCORED,
            "levels AS (SELECT unnest([0.95, 0.9, 0.85, 0.8, 0.5])::DOUBLE AS threshold)",
            "events_hit AS (SELECT threshold, event_id, bool_or(autoencoder >= threshold) AS hit FROM scored, levels WHERE event_id IS NOT NULL GROUP BY threshold, event_id)",
        ],
        f"""SELECT l.threshold, w.alerts, w.false_alerts, w.recall, e.detected_events, e.event_count FROM levels l
JOIN (SELECT threshold, count(*) FILTER (WHERE autoencoder >= threshold) AS alerts, count(*) FILTER (WHERE autoencoder >= threshold AND NOT is_anomaly) AS false_alerts,
    {sql_rounded('count(*) FILTER (WHERE autoencoder >= threshold AND is_anomaly) / count(*) FILTER (WHERE is_anomaly)')} AS recall FROM scored, levels GROUP BY ALL) w USING (threshold)
JOIN (SELECT threshold, count(*) FILTER (WHERE hit) AS detected_events, count(*) AS event_count FROM events_hit GROUP BY ALL) e USING (threshold)""",
    ),
)
def sweep(spark, sf):
    out = threshold_sweep(scored_windows(spark, sf), "autoencoder", [0.95, 0.9, 0.85, 0.8, 0.5])
    return out.withColumn("recall", rounded("recall"))


REPEATS = 500
EVENT_REPEATS = 2000


def draws_sql(seed: int = 20261005, repeats: int = REPEATS) -> list[str]:
    return [
        "numbered AS (SELECT run_id, row_number() OVER (ORDER BY run_id) - 1 AS slot, count(*) OVER () AS runs FROM (SELECT DISTINCT run_id FROM scored))",
        f"""picked AS (SELECT replicate, ('0x' || substr(sha256('{seed}:' || replicate || ':' || slot), 1, 8))::BIGINT % runs AS slot FROM numbered, range({repeats}) r(replicate))""",
        "draws AS (SELECT replicate, run_id, count(*) AS times FROM picked JOIN numbered USING (slot) GROUP BY ALL)",
    ]


@registered(
    "bootstrap_draws",
    with_sql([TELEMETRY, SCORED, *draws_sql()], "SELECT replicate::INTEGER AS replicate, run_id, times FROM draws"),
)
def draws(spark, sf):
    return draw_runs(scored_windows(spark, sf), REPEATS)


@registered(
    "bootstrap_window_metrics",
    with_sql(
        [
            TELEMETRY,
            SCORED,
            *draws_sql(),
            "arms AS (SELECT *, 'a' AS arm, autoencoder AS score, 0.6 AS threshold FROM scored UNION ALL SELECT *, 'b', isolation, 0.5 FROM scored)",
            "drawn AS (SELECT d.replicate, d.times, a.* FROM draws d JOIN arms a USING (run_id))",
            """counts AS (SELECT replicate, arm, sum(times) AS n, sum(times) FILTER (WHERE score >= threshold) AS alerts,
  sum(times) FILTER (WHERE score >= threshold AND is_anomaly) AS hits FROM drawn GROUP BY ALL)""",
            "found AS (SELECT replicate, arm, run_id, times, event_id, bool_or(score >= threshold) AS hit FROM drawn WHERE event_id IS NOT NULL GROUP BY ALL)",
            "rate AS (SELECT replicate, arm, sum(times) FILTER (WHERE hit) / sum(times) AS r FROM found GROUP BY ALL)",
            "points AS (SELECT replicate, arm, score, sum(times) AS a, coalesce(sum(times) FILTER (WHERE is_anomaly), 0) AS p FROM drawn GROUP BY ALL)",
            """curve AS (SELECT *, sum(p) OVER w AS pu, sum(a) OVER w AS au, sum(p) OVER (PARTITION BY replicate, arm) AS pt FROM points
  WINDOW w AS (PARTITION BY replicate, arm ORDER BY score DESC))""",
            "ap AS (SELECT replicate, arm, sum(p / pt * (pu / au)) AS v FROM curve GROUP BY ALL)",
            f"""deltas AS (
  SELECT a.replicate, 'precision' AS metric, coalesce(b.hits, 0) / b.alerts - coalesce(a.hits, 0) / a.alerts AS delta FROM counts a JOIN counts b USING (replicate) WHERE a.arm = 'a' AND b.arm = 'b'
  UNION ALL SELECT a.replicate, 'false_positives_per_asset_day', ((b.alerts - b.hits) - (a.alerts - a.hits)) / (a.n * {STEP_SECONDS}::DOUBLE / 86400) FROM counts a JOIN counts b USING (replicate) WHERE a.arm = 'a' AND b.arm = 'b'
  UNION ALL SELECT a.replicate, 'event_detection_rate', b.r - a.r FROM rate a JOIN rate b USING (replicate) WHERE a.arm = 'a' AND b.arm = 'b'
  UNION ALL SELECT a.replicate, 'pr_auc', b.v - a.v FROM ap a JOIN ap b USING (replicate) WHERE a.arm = 'a' AND b.arm = 'b')""",
        ],
        f"""SELECT metric, count(delta) AS replicates, {sql_rounded('quantile_cont(delta, 0.025)')} AS lower, {sql_rounded('quantile_cont(delta, 0.975)')} AS upper FROM deltas GROUP BY ALL""",
    ),
)
def bootstrap_windows(spark, sf):
    w = scored_windows(spark, sf)
    out = window_metric_intervals(w, draw_runs(w, REPEATS), {"autoencoder": 0.6, "isolation": 0.5}, window_seconds=STEP_SECONDS)
    return out.select("metric", "replicates", rounded("lower").alias("lower"), rounded("upper").alias("upper"))


@registered(
    "bootstrap_event_rate",
    with_sql(
        [
            TELEMETRY,
            SCORED,
            INTERVALS,
            *draws_sql(repeats=EVENT_REPEATS),
            f"""outcome AS (SELECT i.run_id, i.event_id, coalesce(bool_or(s.autoencoder >= 0.6), false) AS a, coalesce(bool_or(s.isolation >= 0.5), false) AS b
  FROM intervals i LEFT JOIN scored s ON {OVERLAP} GROUP BY ALL)""",
            "per_run AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b FROM outcome GROUP BY ALL)",
            "sums AS (SELECT replicate, sum(n * times) AS n, sum(a * times) AS a, sum(b * times) AS b FROM draws JOIN per_run USING (run_id) GROUP BY ALL)",
        ],
        f"""SELECT count(*) AS replicates, {sql_rounded('quantile_cont(b / n - a / n, 0.025)')} AS lower, {sql_rounded('quantile_cont(b / n - a / n, 0.975)')} AS upper FROM sums WHERE n > 0""",
    ),
)
def bootstrap_events(spark, sf):
    w = scored_windows(spark, sf)
    arms = details(spark, sf).withColumn("arm", F.lit("baseline")).unionByName(
        details(spark, sf, "isolation", 0.5).withColumn("arm", F.lit("candidate"))
    )
    out = event_rate_interval(arms, draw_runs(w, EVENT_REPEATS), w)
    return out.select("replicates", rounded("lower").alias("lower"), rounded("upper").alias("upper"))


@registered(
    "bootstrap_physical_event_rate",
    with_sql(
        [
            TELEMETRY,
            SCORED,
            INTERVALS,
            *draws_sql(repeats=EVENT_REPEATS),
            f"""outcome AS (SELECT i.run_id, i.event_id, coalesce(bool_or(s.autoencoder >= 0.6), false) AS a, coalesce(bool_or(s.isolation >= 0.5), false) AS b
  FROM intervals i LEFT JOIN scored s ON {OVERLAP} WHERE i.family IN ('cavitation', 'bearing_degradation', 'cooling_degradation', 'mechanical_overload') GROUP BY ALL)""",
            "per_run AS (SELECT run_id, count(*) AS n, count(*) FILTER (WHERE a) AS a, count(*) FILTER (WHERE b) AS b FROM outcome GROUP BY ALL)",
            "sums AS (SELECT replicate, sum(n * times) AS n, sum(a * times) AS a, sum(b * times) AS b FROM draws JOIN per_run USING (run_id) GROUP BY ALL)",
        ],
        f"""SELECT count(*) AS replicates, {sql_rounded('quantile_cont(b / n - a / n, 0.025)')} AS lower, {sql_rounded('quantile_cont(b / n - a / n, 0.975)')} AS upper FROM sums WHERE n > 0""",
    ),
)
def bootstrap_physical(spark, sf):
    """The change in event rate over physical families alone; runs are drawn from all runs either way."""
    w = scored_windows(spark, sf)
    arms = details(spark, sf).withColumn("arm", F.lit("baseline")).unionByName(
        details(spark, sf, "isolation", 0.5).withColumn("arm", F.lit("candidate"))
    )
    out = event_rate_interval(arms, draw_runs(w, EVENT_REPEATS), w, subset=F.col("family").isin(*PHYSICAL_FAMILIES))
    return out.select("replicates", rounded("lower").alias("lower"), rounded("upper").alias("upper"))


@registered(
    "bootstrap_false_alert_change",
    with_sql(
        [
            TELEMETRY,
            SCORED,
            BOUNDED,
            *draws_sql(repeats=EVENT_REPEATS),
            """per_run AS (SELECT run_id, count(*) FILTER (WHERE autoencoder >= 0.6 AND NOT is_anomaly AND retained) - count(*) FILTER (WHERE autoencoder >= 0.6 AND NOT is_anomaly) AS delta
  FROM bounded GROUP BY ALL)""",
            "sums AS (SELECT replicate, sum(delta * times)::DOUBLE AS delta FROM draws JOIN per_run USING (run_id) GROUP BY ALL)",
        ],
        f"SELECT count(*) AS replicates, {sql_rounded('quantile_cont(delta, 0.025)')} AS lower, {sql_rounded('quantile_cont(delta, 0.975)')} AS upper FROM sums",
    ),
)
def bootstrap_change(spark, sf):
    w = with_bounds(scored_windows(spark, sf), telemetry(spark, sf))
    false_alert = (F.col("autoencoder") >= 0.6) & ~F.col("is_anomaly")
    out = count_change_interval(w, draw_runs(w, EVENT_REPEATS), false_alert, false_alert & F.col("retained"))
    return out.select("replicates", rounded("lower").alias("lower"), rounded("upper").alias("upper"))


POINT_METRICS = ("precision", "recall", "f1", "pr_auc")
POINT_COUNTS = ("samples", "positive_samples", "alerts", "false_positive_windows")


@registered(
    "operating_points",
    with_sql(
        [
            TELEMETRY,
            SCORED,
            """mixed AS (SELECT s.*, w AS ae_weight, w * autoencoder + (1.0::DOUBLE - w) * isolation AS score FROM scored s,
  (SELECT unnest([1.0, 0.9, 0.75, 0.5])::DOUBLE AS w))""",
            """ordered AS (SELECT asset_class, ae_weight, score, row_number() OVER (PARTITION BY asset_class, ae_weight ORDER BY score) - 1 AS place,
  count(*) OVER (PARTITION BY asset_class, ae_weight) AS n FROM mixed WHERE NOT is_anomaly)""",
            """cuts AS (SELECT asset_class, ae_weight, q AS quantile, min(score) FILTER (WHERE place = ceil(q * (n - 1))) AS cut FROM ordered,
  (SELECT unnest([0.98, 0.99, 0.995])::DOUBLE AS q) GROUP BY ALL)""",
            "laid AS (SELECT * FROM mixed JOIN cuts USING (asset_class, ae_weight))",
            *metric_sql("laid", "asset_class, ae_weight, quantile", "score", "score > cut", STEP_SECONDS),
        ],
        metric_select("asset_class, ae_weight, quantile", metrics=POINT_METRICS, counts=POINT_COUNTS),
    ),
)
def points(spark, sf):
    w = scored_windows(spark, sf)
    out = operating_points(w, w.filter(~F.col("is_anomaly")), ["asset_class"], window_seconds=STEP_SECONDS)
    return tidy(out, ["asset_class", "ae_weight", "quantile"], POINT_METRICS, POINT_COUNTS)


@registered(
    "ablation_candidates",
    """SELECT 'without-class-' || event_type AS candidate_id, event_type AS excluded_class, NULL::VARCHAR AS disabled_family FROM (SELECT DISTINCT event_type FROM events)
UNION ALL SELECT * FROM (VALUES ('baseline', NULL, NULL), ('without-statistical', NULL, 'statistical'), ('without-slopes', NULL, 'slopes'),
  ('without-quality', NULL, 'quality'), ('without-sampling', NULL, 'sampling'))""",
)
def candidates(spark, sf):
    return ablation_candidates(telemetry(spark, sf))


# Experiment table: suppliers' discounts as candidates, return flags and years as data sets.
EXPERIMENT = """runs_table AS (SELECT CASE WHEN l_suppkey % 10 = 0 THEN 'baseline' ELSE 'candidate-' || (l_suppkey % 10) END AS candidate_id, l_returnflag || '-' || year(l_shipdate) AS dataset_id,
  avg(l_discount) AS pr_auc, avg(l_tax) AS precision, avg(l_quantity / 100) AS recall, avg(CASE WHEN l_linenumber > 2 THEN l_tax END) AS event_detection_rate,
  avg(l_quantity) AS false_positives_per_asset_day, max(l_quantity) AS latency_seconds, CASE WHEN count(*) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status FROM lineitem GROUP BY ALL)"""


def experiment(spark, sf):
    li = table(spark, sf, "lineitem")
    slot = F.col("l_suppkey") % 10
    return li.groupBy(
        F.when(slot == 0, "baseline").otherwise(F.concat(F.lit("candidate-"), slot.cast("string"))).alias("candidate_id"),
        F.concat_ws("-", "l_returnflag", F.year("l_shipdate").cast("string")).alias("dataset_id"),
    ).agg(
        F.avg("l_discount").alias("pr_auc"), F.avg("l_tax").alias("precision"), F.avg(F.col("l_quantity") / 100).alias("recall"),
        F.avg(F.when(F.col("l_linenumber") > 2, F.col("l_tax"))).alias("event_detection_rate"),
        F.avg("l_quantity").alias("false_positives_per_asset_day"), F.max("l_quantity").alias("latency_seconds"),
        F.when(F.count("*") % 7 == 0, "failed").otherwise("completed").alias("status"),
    )


MEANS = """means AS (SELECT candidate_id, count(*) AS repeats_completed, avg(pr_auc) AS pr_auc, avg(precision) AS precision, avg(recall) AS recall,
  avg(event_detection_rate) AS event_detection_rate, avg(false_positives_per_asset_day) AS false_positives_per_asset_day, avg(latency_seconds) AS latency_seconds
  FROM runs_table WHERE status = 'completed' GROUP BY ALL),
ranked AS (SELECT *, (row_number() OVER (ORDER BY pr_auc DESC, candidate_id) + row_number() OVER (ORDER BY event_detection_rate DESC, candidate_id)
  + row_number() OVER (ORDER BY false_positives_per_asset_day, candidate_id)) / 3.0::DOUBLE AS mean_rank FROM means)"""
MEAN_COLUMNS = ("pr_auc", "precision", "recall", "event_detection_rate", "false_positives_per_asset_day", "latency_seconds", "mean_rank")


@registered(
    "candidate_mean_ranks",
    with_sql([EXPERIMENT, MEANS], f"SELECT candidate_id, repeats_completed, {', '.join(f'{sql_rounded(c)} AS {c}' for c in MEAN_COLUMNS)} FROM ranked"),
)
def ranks(spark, sf):
    out = mean_ranks(candidate_means(experiment(spark, sf)))
    return out.select("candidate_id", "repeats_completed", *[rounded(c).alias(c) for c in MEAN_COLUMNS])


@registered(
    "finalists",
    with_sql([EXPERIMENT, MEANS], f"SELECT candidate_id, {sql_rounded('mean_rank')} AS mean_rank FROM ranked ORDER BY mean_rank, coalesce(pr_auc, 0) DESC, candidate_id LIMIT 4"),
)
def best(spark, sf):
    return finalists(mean_ranks(candidate_means(experiment(spark, sf))), 4).select("candidate_id", rounded("mean_rank").alias("mean_rank"))


@registered(
    "metric_dispersion",
    with_sql(
        [EXPERIMENT],
        f"""SELECT candidate_id, count(event_detection_rate) AS n, {sql_rounded('avg(event_detection_rate)')} AS mean,
  {sql_rounded('coalesce(stddev_samp(event_detection_rate), 0.0)')} AS sample_sd, {sql_rounded('min(event_detection_rate)')} AS min, {sql_rounded('max(event_detection_rate)')} AS max
FROM runs_table WHERE event_detection_rate IS NOT NULL GROUP BY ALL""",
    ),
)
def spread(spark, sf):
    out = dispersion(experiment(spark, sf), ["candidate_id"], "event_detection_rate")
    return out.select("candidate_id", "n", *[rounded(c).alias(c) for c in ("mean", "sample_sd", "min", "max")])


@registered(
    "paired_differences",
    with_sql(
        [
            EXPERIMENT,
            "by_flag AS (SELECT candidate_id, split_part(dataset_id, '-', 1) AS dataset_id, avg(pr_auc) AS pr_auc FROM runs_table GROUP BY ALL)",
            "pairs AS (SELECT c.candidate_id, c.pr_auc - b.pr_auc AS d FROM by_flag c JOIN by_flag b USING (dataset_id) WHERE c.candidate_id <> 'baseline' AND b.candidate_id = 'baseline')",
            "found AS (SELECT candidate_id, count(*) AS n, avg(d) AS m, stddev_samp(d) AS sd FROM pairs GROUP BY ALL)",
        ],
        f"""SELECT candidate_id, n, {sql_rounded('m', 7)} AS mean_difference, {sql_rounded('sd', 7)} AS sample_sd, {sql_rounded('m - 4.302652729749462::DOUBLE * sd / sqrt(n)', 7)} AS ci95_low,
  {sql_rounded('m + 4.302652729749462::DOUBLE * sd / sqrt(n)', 7)} AS ci95_high FROM found""",
    ),
)
def pairs(spark, sf):
    by_flag = experiment(spark, sf).groupBy("candidate_id", F.substring_index("dataset_id", "-", 1).alias("dataset_id")).agg(F.avg("pr_auc").alias("pr_auc"))
    out = paired_differences(paired_values(by_flag, "pr_auc"))
    return out.select("candidate_id", "n", *[rounded(c, 7).alias(c) for c in ("mean_difference", "sample_sd", "ci95_low", "ci95_high")])


@registered(
    "eligible_candidates",
    with_sql(
        [
            """rows AS (SELECT CASE WHEN l_partkey % 40 = 0 THEN 'baseline' ELSE 'candidate-' || (l_partkey % 40) END AS candidate_id, count(*) FILTER (WHERE l_discount > 0.05) AS physical_detected,
  count(*) FILTER (WHERE l_tax > 0.04) AS detected_events, count(*) FILTER (WHERE l_quantity > 20) / count(*) AS precision, count(*) FILTER (WHERE l_returnflag = 'N') AS false_positive_windows
  FROM lineitem GROUP BY ALL)""",
        ],
        f"""SELECT r.candidate_id, r.physical_detected, r.detected_events, {sql_rounded('r.precision')} AS precision, r.false_positive_windows
FROM rows r, rows b WHERE b.candidate_id = 'baseline' AND r.candidate_id <> 'baseline' AND r.physical_detected > b.physical_detected
  AND r.detected_events >= b.detected_events AND r.precision >= 0.5 AND r.false_positive_windows <= b.false_positive_windows""",
    ),
)
def gates(spark, sf):
    slot = F.col("l_partkey") % 40
    rows = table(spark, sf, "lineitem").groupBy(
        F.when(slot == 0, "baseline").otherwise(F.concat(F.lit("candidate-"), slot.cast("string"))).alias("candidate_id")
    ).agg(
        F.count_if(F.col("l_discount") > 0.05).alias("physical_detected"), F.count_if(F.col("l_tax") > 0.04).alias("detected_events"),
        (F.count_if(F.col("l_quantity") > 20) / F.count("*")).alias("precision"), F.count_if(F.col("l_returnflag") == "N").alias("false_positive_windows"),
    )
    return eligible_candidates(rows).withColumn("precision", rounded("precision"))


# Hours stand in for minutes: quarter-hour pieces, so that tiles of four occur.
PIECES = """pieces AS (SELECT 'class' AS run_id, asset_class AS asset_id, us // 900000000 * 900000000 AS window_start, us // 900000000 * 900000000 + 900000000 AS window_end,
  max(value) AS score FROM telemetry GROUP BY ALL)"""


def pieces(spark, sf):
    t = telemetry(spark, sf)
    start = F.col("us") - F.pmod("us", F.lit(900000000))
    return t.groupBy(F.lit("class").alias("run_id"), F.col("asset_class").alias("asset_id"), start.alias("window_start")).agg(
        F.max("value").alias("score")
    ).withColumn("window_end", F.col("window_start") + 900000000)


@registered(
    "complete_tiles",
    with_sql(
        [TELEMETRY, PIECES],
        """SELECT run_id, asset_id, window_start // 3600000000 * 3600000000 AS window_start FROM pieces GROUP BY ALL HAVING count(*) = 4""",
    ),
)
def tiles(spark, sf):
    return complete_tiles(pieces(spark, sf), 900, HOUR_US)


@registered(
    "tile_scores",
    with_sql([TELEMETRY, PIECES], "SELECT run_id, asset_id, window_start // 3600000000 * 3600000000 AS window_start, max(score) AS score FROM pieces GROUP BY ALL"),
)
def scores_of_tiles(spark, sf):
    return tile_scores(pieces(spark, sf), tile_us=HOUR_US)


@registered(
    "relation_difference",
    """SELECT asset, kind, (a - b)::BIGINT AS surplus FROM (SELECT user_id AS asset, event_type AS kind, count(*) FILTER (WHERE value > 10) AS a, count(*) FILTER (WHERE value < 60) AS b
FROM events GROUP BY ALL) WHERE a <> b""",
)
def difference(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").alias("asset"), F.col("event_type").alias("kind"), "value")
    return unmatched_rows(e.filter("value > 10"), e.filter("value < 60"), ["asset", "kind"])


@registered(
    "score_summary",
    with_sql(
        [TELEMETRY, SCORED],
        f"""SELECT count(*) AS validation_windows, count(*) FILTER (WHERE NOT is_anomaly) AS calibration_normal_windows, NOT bool_or(is_anomaly) AS validation_normal_only,
  false AS validation_normal_assumed, {sql_rounded('median(autoencoder)')} AS autoencoder_median, {sql_rounded('median(isolation)')} AS isolation_median FROM scored""",
    ),
)
def summary_of_scores(spark, sf):
    out = score_summary(scored_windows(spark, sf), ["autoencoder", "isolation"])
    return out.withColumn("autoencoder_median", rounded("autoencoder_median")).withColumn("isolation_median", rounded("isolation_median"))
