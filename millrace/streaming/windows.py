"""Windows of a stream, closed as in the ``complete`` tail policy.

A window closes once the watermark has passed its end, so no admissible
observation can still fall into it, and its asset has been observed at or after
its end. The result has the rows and columns of ``window_features(tail="complete")``.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.timeline import SECOND_US, epoch_us
from millrace.operators.channels import STATISTICS, chosen_statistics, continuous_only, with_channel
from millrace.operators.features import CONTEXTS, usable_value
from millrace.operators.windows import WindowPlan
from millrace.sources.telemetry import OBSERVATION_KEY
from millrace.streaming.silence import enable_state_store

GOOD, UNCERTAIN, BAD, OTHER = range(4)
# Bytes of readings after which a pack of cells ends, and packs of an asset that become one.
PACK_BYTES = 16_000_000
PACKS = 16
ASSET = "low bigint, high bigint, closed bigint, asset_class string, operating_regime string"
# A context that had more than one value so far.
_SEVERAL = "\0several"


def fresh_observations(stream: DataFrame, delay: str) -> DataFrame:
    """Drop observations later than the watermark and repeats of an observation key within it."""
    return stream.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(list(OBSERVATION_KEY))


class Cell:
    """What the state keeps of one pane of one tag: counts by quality, and the usable values with their times.

    Cells merge by addition, whatever the order in which rows come. The values
    are there for the exact median and MAD; they leave with their last window.
    """

    __slots__ = ("counts", "interval", "opened", "readings", "times")

    def __init__(self, counts, opened, interval, times, readings):
        self.counts, self.opened, self.interval, self.times, self.readings = counts, opened, interval, times, readings

    @classmethod
    def of(cls, us: np.ndarray, u: np.ndarray, kind: np.ndarray, interval: np.ndarray) -> Cell:
        """The cell of these rows; NaN where there is no usable value or no interval."""
        first = int(us.argmin())
        usable = ~np.isnan(u)
        return cls(np.bincount(kind, minlength=4), int(us[first]), None if np.isnan(interval[first]) else float(interval[first]), us[usable], u[usable])

    @classmethod
    def stored(cls, value: tuple) -> Cell:
        *counts, opened, interval, times, readings = value
        return cls(np.array(counts), opened, interval, np.frombuffer(times, np.int64), np.frombuffer(readings, np.float64))

    def row(self) -> tuple:
        return (*map(int, self.counts), self.opened, self.interval, self.times.tobytes(), self.readings.tobytes())

    def merged(self, *others: Cell) -> Cell:
        if not others:
            return self
        cells = (self, *others)
        early = min(cells, key=lambda cell: cell.opened)
        return Cell(
            sum(cell.counts for cell in cells), early.opened, early.interval,
            np.concatenate([cell.times for cell in cells]), np.concatenate([cell.readings for cell in cells]),
        )


def silent_statistics(plan: WindowPlan, default_ms: float | None) -> dict[str, float]:
    expected = plan.size_us / (default_ms * 1000.0) if default_ms and default_ms > 0 else 0.0
    return {**dict.fromkeys(STATISTICS, 0.0), "bad_ratio": 1.0, "missing": 1.0, "expected_sample_count": expected}


def middle(ordered: np.ndarray) -> float:
    """The median of sorted values."""
    n = len(ordered)
    return float((ordered[(n - 1) // 2] + ordered[n // 2]) / 2.0)


def channel_statistics(cells: list[tuple[tuple, Cell]], plan: WindowPlan, has_interval: bool, default_ms: float | None) -> dict[str, float]:
    """The statistics of a channel from its cells in a window, each with (signal class, tag) for equal times."""
    counts = sum(cell.counts for _, cell in cells)
    n = float(counts.sum())
    opening = min(cells, key=lambda item: (item[1].opened, *item[0]))[1]
    interval = opening.interval if has_interval else default_ms
    expected = plan.size_us / (interval * 1000.0) if interval and interval > 0 else n
    out = dict.fromkeys(STATISTICS, 0.0)
    out |= {
        "sample_count": n, "expected_sample_count": expected, "coverage_ratio": min(n / expected, 1.0),
        "good_ratio": counts[GOOD] / n, "uncertain_ratio": counts[UNCERTAIN] / n, "bad_ratio": counts[BAD] / n,
    }
    used = [(tag, cell) for tag, cell in cells if len(cell.times)]
    if not used:
        return out
    u = np.concatenate([cell.readings for _, cell in used])
    us = np.concatenate([cell.times for _, cell in used])
    opens = min(used, key=lambda item: (int(item[1].times.min()), *item[0]))[1]
    ends = max(used, key=lambda item: (int(item[1].times.max()), *item[0]))[1]
    first, last = float(opens.readings[opens.times.argmin()]), float(ends.readings[ends.times.argmax()])
    if len(u) == 1:
        return out | dict.fromkeys(("mean", "median", "min", "max", "last"), last)
    ordered = np.sort(u)
    median, mean = middle(ordered), np.add.reduce(u) / len(u)
    apart = u - mean
    out |= {
        "mean": float(mean), "median": median, "min": float(ordered[0]), "max": float(ordered[-1]), "range": float(ordered[-1] - ordered[0]),
        "std": float(np.sqrt(np.add.reduce(apart * apart) / len(u))), "mad": middle(np.sort(np.abs(u - median))), "last": last, "delta": last - first,
    }
    # Times from the earliest one: epoch microseconds would lose digits in the squares.
    t = (us - us.min()) / float(SECOND_US)
    dt = t - np.add.reduce(t) / len(t)
    if t.max() > 0:
        out["slope"] = float(dt @ apart / (dt @ dt))
    return out


class WindowProcessor(StatefulProcessor):
    """State of an asset: its cells of open panes, contexts and labels by pane, and how far its windows are closed."""

    def __init__(self, plan: WindowPlan, channels: Sequence[str], intervals: Mapping[str, float], statistics: Sequence[str], columns: Sequence[str]):
        self.plan, self.channels, self.intervals, self.statistics, self.columns = plan, list(channels), dict(intervals), list(statistics), set(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asset = handle.getValueState("asset", ASSET)
        # Every call on the state is a message, so cells and labels travel in packs: new ones are appended, and merge when read.
        self.packs = handle.getListState("packs", "data binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        low, high, closed, *contexts = self.asset.get() if self.asset.exists() else (None, None, None, None, None)
        stored, labels, packs = self._stored()
        fresh: dict[tuple, Cell] = {}
        added = set()
        for pdf in rows:
            foreign = sorted(set(pdf["channel"]) - set(self.channels))
            if foreign:
                raise ValueError(f"Untrained measurement channels: {foreign}")
            us = pdf["us"].to_numpy(np.int64)
            low = int(us.min()) if low is None else min(low, int(us.min()))
            high = int(us.max()) if high is None else max(high, int(us.max()))
            panes = us // self.plan.pane_us
            u, interval = (pdf[c].to_numpy(np.float64, na_value=np.nan) for c in ("u", "interval_ms"))
            kind = pdf["kind"].to_numpy(np.int64)
            tags = ([None if pd.isna(t) else str(t) for t in pdf[c]] for c in ("channel", "signal_class", "tag_id"))
            places: dict[tuple, list[int]] = {}
            for i, place in enumerate(zip(panes.tolist(), *tags, strict=True)):
                places.setdefault(place, []).append(i)
            for place, at in places.items():
                cell = Cell.of(us[at], u[at], kind[at], interval[at])
                fresh[place] = fresh[place].merged(cell) if place in fresh else cell
            pdf = pdf.assign(pane=panes)
            for i, name in enumerate(CONTEXTS):
                if name in self.columns:
                    for value in pdf[name].dropna().unique():
                        contexts[i] = value if contexts[i] in (None, value) else _SEVERAL
            for name in {*CONTEXTS, "is_anomaly"} & self.columns:
                known = pdf[["pane", name]].dropna().drop_duplicates()
                added |= {(int(pane), name, str(value)) for pane, value in zip(known["pane"], known[name], strict=True)} - labels
        yield from self._close(key, low, high, closed, contexts, timerValues, stored, labels, packs, fresh, added)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        low, high, closed, *contexts = self.asset.get()
        yield from self._close(key, low, high, closed, contexts, timerValues, *self._stored(), {}, set())

    def _stored(self) -> tuple[dict[tuple, Cell], set[tuple], int]:
        """Cells and labels of the asset's open panes, and the packs that hold them."""
        parts: dict[tuple, list[Cell]] = {}
        labels: set[tuple] = set()
        packs = 0
        if self.packs.exists():
            for (data,) in self.packs.get():
                cells, named = pickle.loads(data)
                for place, value in cells:
                    parts.setdefault(place, []).append(Cell.stored(value))
                labels.update(named)
                packs += 1
        return {place: Cell.merged(*cells) for place, cells in parts.items()}, labels, packs

    @staticmethod
    def _packed(cells: Mapping[tuple, Cell], labels: set[tuple]) -> list[tuple]:
        """Packs of about ``PACK_BYTES``, at least one cell each; the labels go with the first."""
        groups, size = [[]], 0
        for place, cell in cells.items():
            if size > PACK_BYTES:
                groups.append([])
                size = 0
            groups[-1].append((place, cell.row()))
            size += 16 * len(cell.times)
        return [(pickle.dumps((group, () if k else tuple(labels)), 5),) for k, group in enumerate(groups)]

    def _windows(self, pane: int) -> range:
        """Starts of the windows that hold a pane."""
        plan = self.plan
        first = -((plan.size_us - (pane + 1) * plan.pane_us) // plan.stride_us)
        return range(first * plan.stride_us, pane * plan.pane_us + 1, plan.stride_us)

    def _close(self, key, low: int, high: int, closed: int | None, contexts: list, timerValues, stored: dict[tuple, Cell], labels: set[tuple], packs: int, fresh: dict[tuple, Cell], added: set[tuple]) -> Iterator[pd.DataFrame]:
        """Give out what is due, then append new cells, or write what stays where some leave."""
        plan = self.plan
        bound = min(high, timerValues.getCurrentWatermarkInMs() * 1000) - plan.size_us
        earliest = low // plan.stride_us * plan.stride_us if closed is None else closed + 1
        for place, cell in fresh.items():
            stored[place] = stored[place].merged(cell) if place in stored else cell
        labels = labels | added
        panes: dict[int, list] = {}
        for place in stored:
            panes.setdefault(place[0], []).append(place)
        # Only starts whose windows hold something, so a long silence costs nothing.
        starts = {s for pane in panes for s in self._windows(pane) if s >= earliest}
        due = sorted(s for s in starts if s <= bound)
        out = [self._row(key, s, panes, stored, labels, contexts) for s in due]
        if bound >= earliest:
            closed = bound if closed is None else max(closed, bound)
        over = {p for p in {place[0] for place in (*stored, *labels)} if closed is not None and (not len(self._windows(p)) or self._windows(p)[-1] <= closed)}
        if over or packs > PACKS:
            staying = {place: cell for place, cell in stored.items() if place[0] not in over}
            named = {label for label in labels if label[0] not in over}
            if staying or named:
                self.packs.put(self._packed(staying, named))
            elif packs:
                self.packs.clear()
        elif fresh or added:
            self.packs.appendList(self._packed(fresh, added))
        self.asset.update((low, high, closed, *contexts))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        waiting = [s for s in starts if bound < s <= high - plan.size_us]
        if waiting:
            self.handle.registerTimer(-(-(min(waiting) + plan.size_us) // 1000))
        yield pd.DataFrame(out, columns=self.output_columns()) if out else pd.DataFrame()

    def output_columns(self) -> list[str]:
        return ["run_id", "asset_id", "window_start", *(c for c in (*CONTEXTS, "is_anomaly") if c in self.columns), "values"]

    def _row(self, key, start: int, panes: dict[int, list], stored: dict[tuple, Cell], labels: set[tuple], contexts: list) -> list:
        plan = self.plan
        low, high = start // plan.pane_us, (start + plan.size_us) // plan.pane_us
        by_channel: dict[str, list] = {}
        for pane in range(low, high) if high - low < len(panes) else [p for p in panes if low <= p < high]:
            for place in panes.get(pane, ()):
                by_channel.setdefault(place[1], []).append(((place[2] or "", place[3] or ""), stored[place]))
        row = [key[0], key[1], start]
        held = [(name, value) for pane, name, value in labels if low <= pane < high]
        for i, name in enumerate(CONTEXTS):
            if name in self.columns:
                values = sorted({v for n, v in held if n == name})
                alone = contexts[i] if contexts[i] not in (None, _SEVERAL) else "unknown"
                row.append(values[0] if len(values) == 1 else "mixed" if values else alone)
        if "is_anomaly" in self.columns:
            row.append(("is_anomaly", "True") in held)
        flat: list[float] = []
        for channel in self.channels:
            default = self.intervals.get(channel)
            cells = by_channel.get(channel)
            found = channel_statistics(cells, plan, "sampling_interval_ms" in self.columns, default) if cells else silent_statistics(plan, default)
            flat += [float(found[s]) for s in self.statistics]
        return [*row, flat]

    def close(self) -> None:
        pass


def closed_windows(
    stream: DataFrame,
    plan: WindowPlan,
    channels: Sequence[str],
    default_intervals: Mapping[str, float] | None = None,
    families: Mapping[str, bool] | None = None,
) -> DataFrame:
    """One row per closed window with ``stats``: channel -> struct of statistics, as in ``window_features``.

    ``stream`` carries a watermark (see ``fresh_observations``). Channels are the
    trained ones: others are refused, and silent ones get their no-data
    statistics. Contexts are those of the window's rows; where it has none, the
    asset's only value so far, else "unknown" (a batch also looks ahead).
    ``is_anomaly`` is carried when present. Of equal times in one tag the row
    that came first counts.

    The state is keyed by asset. It holds the values of panes whose windows are
    open, and an asset that falls silent keeps its last open window's.
    """
    enable_state_store(stream.sparkSession)
    statistics = list(chosen_statistics(dict(families or {})))
    rows = with_channel(continuous_only(stream))
    present = set(rows.columns)
    quality = F.col("quality") if "quality" in present else F.lit("good")
    kind = F.when(quality == "good", GOOD).when(quality.isNull() | (quality == "uncertain"), UNCERTAIN).when(quality == "bad", BAD).otherwise(OTHER)
    interval = F.col("sampling_interval_ms") if "sampling_interval_ms" in present else F.lit(None)
    carried = [c for c in (*CONTEXTS, "is_anomaly") if c in present]
    prepared = rows.select(
        "run_id", "asset_id", "timestamp", epoch_us("timestamp").alias("us"), "channel", "signal_class", "tag_id",
        usable_value(rows).alias("u"), kind.alias("kind"), interval.cast("double").alias("interval_ms"), *carried,
    )
    intervals = {c: float(v) for c, v in (default_intervals or {}).items() if v is not None}
    processor = WindowProcessor(plan, channels, intervals, statistics, [*carried, *({"sampling_interval_ms"} & present)])
    kinds = {"run_id": "string", "asset_id": "string", "window_start": "bigint", "is_anomaly": "boolean", "values": "array<double>"}
    output = ", ".join(f"`{c}` {kinds.get(c, 'string')}" for c in processor.output_columns())
    closed = prepared.groupBy("run_id", "asset_id").transformWithStateInPandas(processor, outputStructType=output, outputMode="append", timeMode="EventTime")
    width = len(statistics)
    names = F.array(*[F.lit(c) for c in channels])
    structs = F.transform(
        F.sequence(F.lit(0), F.lit(len(channels) - 1)),
        lambda c: F.struct(*[F.get("values", c * width + k).alias(s) for k, s in enumerate(statistics)]),
    )
    return closed.select(
        "run_id", "asset_id", "window_start", (F.col("window_start") + plan.size_us).alias("window_end"), *carried,
        F.map_from_arrays(names, structs).alias("stats"),
    )


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything available now into a Parquet directory and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
