"""Per-asset silence: an alert when an asset has sent nothing for a while.

Spark's watermark is global, so one silent asset would never stand out by it.
Each asset keeps its latest observation and an event-time timer.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "run_id string, asset_id string, last_us bigint, silent_from timestamp"


class SilenceProcessor(StatefulProcessor):
    """State: the latest observation in epoch microseconds."""

    def __init__(self, timeout_ms: int) -> None:
        self.timeout_ms = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = max(int(pdf["us"].max()) for pdf in rows)
        if self.last.exists():
            latest = max(latest, self.last.get()[0])
        self.last.update((latest,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(latest // 1000 + self.timeout_ms)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0]
        self.last.clear()
        yield pd.DataFrame(
            {
                "run_id": [key[0]],
                "asset_id": [key[1]],
                "last_us": [last],
                "silent_from": [pd.Timestamp(last + self.timeout_ms * 1000, unit="us")],
            }
        )

    def close(self) -> None:
        pass


def enable_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


def silent_assets(stream: DataFrame, timeout_ms: int, delay: str = "0 seconds") -> DataFrame:
    """One row each time an asset has been silent for ``timeout_ms`` of event time."""
    enable_state_store(stream.sparkSession)
    return (
        stream.withWatermark("timestamp", delay)
        .groupBy("run_id", "asset_id")
        .transformWithStateInPandas(
            SilenceProcessor(timeout_ms), outputStructType=OUTPUT, outputMode="append", timeMode="EventTime"
        )
    )
