"""Event intervals against observations and windows.

All joins here carry the asset and a coarse time bucket as equality keys, so
the time range is a residual condition inside small buckets and a busy asset
spreads over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.timeline import HOUR_US, floor_div
from millrace.operators.ranks import earlier_blocks
from millrace.session import settle

ASSET = ["run_id", "asset_id"]
EVENT_KEY = ["run_id", "asset_id", "event_id"]
BUCKET_US = HOUR_US


def _buckets(low: Column, high: Column, bucket_us: int) -> Column:
    first, last = floor_div(low, bucket_us), floor_div(high, bucket_us)
    return F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))


def _clipped_buckets(low: Column, high: Column, bucket_us: int) -> Column:
    """Buckets of a range inside an asset's observed time (``_low``, ``_high``).

    An open end would otherwise stand for millions of buckets that nothing is in.
    """
    return _buckets(F.greatest(low, F.col("_low")), F.least(high, F.col("_high")), bucket_us)


def _observed_time(points: DataFrame, time: str) -> DataFrame:
    return points.groupBy(*ASSET).agg(F.min(time).alias("_low"), F.max(time).alias("_high"))


def interval_problems(events: DataFrame) -> DataFrame:
    """Duplicate identities and inverted intervals."""
    return (
        events.groupBy(*EVENT_KEY)
        .agg(F.count("*").alias("copies"), F.count_if(F.col("end_us") < F.col("start_us")).alias("inverted"))
        .filter((F.col("copies") > 1) | (F.col("inverted") > 0))
    )


def refuse_bad_intervals(events: DataFrame) -> DataFrame:
    problem = interval_problems(events).first()
    if problem is not None:
        raise ValueError(f"Duplicate or inverted event interval: {problem.asDict()}")
    return events


def owned_intervals(events: DataFrame, block_us: int = 24 * HOUR_US) -> DataFrame:
    """The part of each closed interval that belongs to it when earlier events keep their time.

    In the order (start, id), an event owns what lies after the latest end of all
    events before it. Owned parts never overlap, so an observation meets at most
    one, and no regrouping of observations is needed.
    """
    blocked = events.withColumn("_block", floor_div("start_us", block_us))
    inside = (
        Window.partitionBy(*ASSET, "_block").orderBy("start_us", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = blocked.withColumn("_reach_in", F.max("end_us").over(inside))
    earlier = earlier_blocks(blocked, ASSET, "_block", {"_reach_before": F.max("end_us")}, F.max)
    reach = F.greatest(F.col("_reach_in"), F.col("_reach_before"))
    owned = local.join(earlier, [*ASSET, "_block"]).withColumn(
        "owned_from", F.greatest(F.col("start_us"), reach + 1)
    )
    return owned.filter(F.col("owned_from") <= F.col("end_us")).select(
        *ASSET, "event_id", "start_us", "end_us", "owned_from"
    )


def observed_events(events: DataFrame, times: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Events with at least one observation time (``run_id, asset_id, us``) in their closed interval."""
    bounded = events.join(_observed_time(times, "us"), ASSET)
    spread = bounded.withColumn("_bucket", F.explode(_clipped_buckets(F.col("start_us"), F.col("end_us"), bucket_us)))
    placed = times.withColumn("_bucket", floor_div("us", bucket_us))
    a, b = spread.alias("a"), placed.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*ASSET, "_bucket")]
    inside = F.col("b.us").between(F.col("a.start_us"), F.col("a.end_us"))
    return a.join(b, [*same, inside], "left_semi").select(*EVENT_KEY).distinct()


def nearest_observations(events: DataFrame, times: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """For events without observations: the asset's time nearest to the interval's midpoint.

    With nothing inside, only the last time before the start and the first after
    the end can be nearest. Each is found in its own bucket, or from a table with
    one row per bucket. Equal distances go to the earlier time.
    """
    unseen = events.join(observed_events(events, times, bucket_us), EVENT_KEY, "left_anti")
    placed = times.withColumn("_bucket", floor_div("us", bucket_us))
    ends = unseen.select(
        *ASSET,
        "event_id",
        "start_us",
        "end_us",
        F.explode(
            F.array(
                F.struct(F.lit(True).alias("before"), floor_div("start_us", bucket_us).alias("_bucket")),
                F.struct(F.lit(False).alias("before"), floor_div("end_us", bucket_us).alias("_bucket")),
            )
        ).alias("_side"),
    ).select(*ASSET, "event_id", "start_us", "end_us", "_side.*")
    summary = placed.groupBy(*ASSET, "_bucket").agg(F.min("us").alias("low"), F.max("us").alias("high"))
    asked = ends.select(*ASSET, "_bucket").distinct().join(placed.select(*ASSET).distinct(), ASSET, "left_semi")
    grid = summary.unionByName(asked, allowMissingColumns=True).groupBy(*ASSET, "_bucket").agg(
        F.min("low").alias("low"), F.max("high").alias("high")
    )
    order = Window.partitionBy(*ASSET).orderBy("_bucket")
    outside = grid.select(
        *ASSET,
        "_bucket",
        F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("earlier"),
        F.min("low").over(order.rowsBetween(1, Window.unboundedFollowing)).alias("later"),
    )
    local = (
        ends.join(placed, [*ASSET, "_bucket"], "left")
        .groupBy(*ASSET, "event_id", "start_us", "end_us", "before", "_bucket")
        .agg(
            F.max(F.when(F.col("us") < F.col("start_us"), F.col("us"))).alias("below"),
            F.min(F.when(F.col("us") > F.col("end_us"), F.col("us"))).alias("above"),
        )
    )
    candidate = F.when(F.col("before"), F.coalesce("below", "earlier")).otherwise(F.coalesce("above", "later"))
    sided = local.join(outside, [*ASSET, "_bucket"]).withColumn("us", candidate).filter(F.col("us").isNotNull())
    total = F.col("start_us") + F.col("end_us")
    distance = F.abs(F.col("us") - floor_div(total, 2))
    best = F.min(F.struct(distance.alias("distance"), F.col("us"))).alias("_best")
    return sided.groupBy(*EVENT_KEY, "start_us").agg(best).select(*EVENT_KEY, "start_us", F.col("_best.us").alias("us"))


def annotate(rows: DataFrame, events: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Label observations by event intervals: ``is_anomaly``, ``event_id``, ``event_start_us``.

    ``rows`` has ``us``. Overlaps go to the event that starts first, then to the
    smaller id. An event without any observation marks the nearest one instead.
    """
    events = settle(events.select(*EVENT_KEY, "start_us", "end_us"), "events")
    # Many tags share a time: reduced before the shuffle, and written once for its three readers.
    times = settle(rows.select(*ASSET, "us").distinct(), "times")
    bounded = owned_intervals(events).join(_observed_time(times, "us"), ASSET)
    owned = bounded.withColumn("_bucket", F.explode(_clipped_buckets(F.col("owned_from"), F.col("end_us"), bucket_us)))
    first = F.min(F.struct(F.col("start_us"), F.col("event_id"))).alias("_point")
    # Written, so that Spark knows its size and need not shuffle the rows to meet a small table.
    points = settle(nearest_observations(events, times, bucket_us).groupBy(*ASSET, "us").agg(first), "points")
    a = rows.withColumn("_bucket", floor_div("us", bucket_us)).alias("a")
    b = owned.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (*ASSET, "_bucket")]
    inside = F.col("a.us").between(F.col("b.owned_from"), F.col("b.end_us"))
    interval = F.when(F.col("b.event_id").isNotNull(), F.struct(F.col("b.start_us"), F.col("b.event_id")))
    met = a.join(b, [*same, inside], "left").select("a.*", interval.alias("_interval")).drop("_bucket")
    both = met.join(points, [*ASSET, "us"], "left").withColumn("_event", F.least("_interval", "_point"))
    keep = [c for c in rows.columns if c not in ("is_anomaly", "event_id", "event_start_us")]
    return both.select(
        *keep,
        F.col("_event").isNotNull().alias("is_anomaly"),
        F.col("_event.event_id").alias("event_id"),
        F.col("_event.start_us").alias("event_start_us"),
    )


def _window_hits(windows: DataFrame, events: DataFrame, bucket_us: int, columns: list[str]) -> tuple[DataFrame, DataFrame, Column]:
    """Windows as points at their start, events as start ranges, and the join condition between them.

    A window overlaps an event when it starts no later than the event ends and ends
    after the event starts; with the widest window W, its start then lies in
    (start - W, end]. Every window sits in one bucket only.
    """
    widest = windows.agg(F.max(F.col("window_end") - F.col("window_start"))).first()[0] or 1
    bounded = events.join(_observed_time(windows, "window_start"), ASSET)
    spread = bounded.withColumn(
        "_bucket", F.explode(_clipped_buckets(F.col("start_us") - F.lit(int(widest)) + 1, F.col("end_us"), bucket_us))
    ).drop("_low", "_high")
    placed = windows.select(*columns).withColumn("_bucket", floor_div("window_start", bucket_us))
    w, e = placed.alias("w"), spread.alias("e")
    condition = (F.col("w.window_start") <= F.col("e.end_us")) & (F.col("w.window_end") > F.col("e.start_us"))
    for c in (*ASSET, "_bucket"):
        condition = condition & (F.col(f"w.{c}") == F.col(f"e.{c}"))
    return w, e, condition


def label_windows(windows: DataFrame, events: DataFrame, bucket_us: int = BUCKET_US) -> DataFrame:
    """Add ``overlaps_event`` to every window."""
    keys = [*ASSET, "window_start", "window_end"]
    w, e, condition = _window_hits(windows, events, bucket_us, keys)
    hits = w.join(e, condition, "left_semi").select(*keys).withColumn("_hit", F.lit(True))
    return windows.join(hits, keys, "left").withColumn("overlaps_event", F.coalesce("_hit", F.lit(False))).drop("_hit")


def event_details(
    events: DataFrame, windows: DataFrame, score: str, threshold: float | str, bucket_us: int = BUCKET_US, strict: bool = False
) -> DataFrame:
    """Every event once: whether any window overlaps it, whether one alerts, and the delay of the first alert.

    Delays run from the event start to the end of the alerting window and may be
    negative. ``strict`` alerts above the threshold only, not at it. ``threshold``
    is a number or the name of a window column.
    """
    level = F.col(threshold) if isinstance(threshold, str) else F.lit(float(threshold))
    alert = F.col(score) > level if strict else F.col(score) >= level
    scored = windows.withColumn("_alert", alert)
    w, e, condition = _window_hits(scored, events, bucket_us, [*ASSET, "window_start", "window_end", "_alert"])
    hits = w.join(e, condition).groupBy(*[F.col(f"e.{c}").alias(c) for c in EVENT_KEY]).agg(
        F.min(F.when(F.col("w._alert"), F.col("w.window_end"))).alias("_end")
    ).withColumn("_seen", F.lit(True))
    return events.join(hits, EVENT_KEY, "left").select(
        *events.columns,
        F.coalesce("_seen", F.lit(False)).alias("observable"),
        F.col("_end").isNotNull().alias("detected"),
        ((F.col("_end") - F.col("start_us")) / F.lit(1e6)).alias("latency_seconds"),
    )


def event_summary(details: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Event counts, rate and mean delay over the details."""
    return details.groupBy(*(by or [])).agg(
        F.count("*").alias("event_count"),
        F.count_if("detected").alias("detected_events"),
        F.count_if(~F.col("observable")).alias("events_without_windows"),
        F.try_divide(F.count_if("detected"), F.count("*")).alias("event_detection_rate"),
        F.avg("latency_seconds").alias("mean_detection_latency_seconds"),
    )


# Event families that describe a physical process.
PHYSICAL_FAMILIES = ("cavitation", "bearing_degradation", "cooling_degradation", "mechanical_overload")


def family_summary(details: DataFrame, physical=PHYSICAL_FAMILIES) -> DataFrame:
    """Events and detections per family, with a subtotal over the physical families."""
    scopes = F.explode(
        F.array_compact(
            F.array(
                F.struct(F.lit("family").alias("scope"), F.col("family").alias("name")),
                F.when(
                    F.col("family").isin(*physical), F.struct(F.lit("subtotal").alias("scope"), F.lit("physical").alias("name"))
                ),
            )
        )
    )
    return (
        details.withColumn("_s", scopes)
        .groupBy(F.col("_s.scope").alias("scope"), F.col("_s.name").alias("family"))
        .agg(F.count("*").alias("events"), F.count_if("detected").alias("detected"))
    )
