"""Scoring micro-batches of windows with stored state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators.bymodel import reused_state
from millrace.operators.context import encode_contexts
from millrace.plans.detector import Model, curves, score_windows
from millrace.session import scratch_scope
from millrace.sources.sinks import write_scored


def score_stream(windows: DataFrame, model: Model, path: str, checkpoint: str) -> None:
    """Score a stream of window rows as they close, such as ``closed_windows`` gives them.

    Each micro-batch is a table, so it goes through the batch scoring job; its
    output directory is named by the batch, which makes a retried batch visible
    instead of appending it twice. Its intermediate tables go when it is written.
    Fitted state is sent to the executors once for all micro-batches and
    released when the stream ends.
    """
    if model.vocabulary and not any(c.startswith("context_") for c in windows.columns):
        windows = encode_contexts(windows, model.vocabulary)

    def handle(batch: DataFrame, number: int) -> None:
        if batch.isEmpty():
            return
        columns = ["autoencoder", "isolation_forest", "irregularity"]
        with scratch_scope(batch.sparkSession):
            write_scored(score_windows(batch, model), f"{path}/batch={number}", columns, mode="overwrite")

    with reused_state():
        # Before the first micro-batch, whose intermediate tables go with it.
        curves(model.tables["references"])
        query = (
            windows.writeStream.foreachBatch(handle)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
