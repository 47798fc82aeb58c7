"""What a running stream reports of itself: progress, state and how far it lags behind its source."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

PROGRESS = (
    "query string, batch_id long, at string, input_rows long, rows_per_second double, state_rows long,"
    " dropped_by_watermark long, watermark string, records_behind long"
)


def progress_row(progress: dict) -> tuple:
    """One micro-batch's report. Sources without a notion of lag, such as files, give none."""
    states = progress.get("stateOperators", [])
    behind = [
        int(float(source["metrics"]["maxOffsetsBehindLatest"]))
        for source in progress.get("sources", [])
        if "maxOffsetsBehindLatest" in (source.get("metrics") or {})
    ]
    return (
        progress.get("name") or progress["id"],
        progress["batchId"],
        progress["timestamp"],
        progress["numInputRows"],
        float(progress.get("processedRowsPerSecond") or 0.0),
        sum(state["numRowsTotal"] for state in states),
        sum(state.get("numRowsDroppedByWatermark", 0) for state in states),
        (progress.get("eventTime") or {}).get("watermark"),
        max(behind, default=None),
    )


def recent_progress(spark: SparkSession, query: StreamingQuery) -> DataFrame:
    """The last reports of a query as a table; Spark keeps a bounded number of them."""
    reports = [json.loads(report.json) for report in query.recentProgress]
    return spark.createDataFrame([progress_row(report) for report in reports], PROGRESS)


class ProgressListener(StreamingQueryListener):
    """Hands each report of every stream to a function, such as one that logs or alerts.

    Add it with ``spark.streams.addListener``. Offsets are Spark's own in the checkpoint; nothing
    is committed to the source.
    """

    def __init__(self, told):
        self.told = told

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.told(dict(zip(_NAMES, progress_row(json.loads(event.progress.json)))))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


_NAMES = [field.split()[0] for field in PROGRESS.split(", ")]
