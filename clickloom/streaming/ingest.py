"""Raw records into good events and rejects: every record ends in exactly one of two places.

Both parts of a micro-batch become visible in one commit, once, also when the batch is run again. A
reject keeps its raw text and the rules it breaks, so it can be mended and sent again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from clickloom.operators.filtering import validate_events
from clickloom.sources.clicks import parse_clicks
from clickloom.streaming.log import VersionedLog

EVENTS, REJECTS = "events", "rejects"


def start_ingest(
    records: DataFrame,
    path: str,
    checkpoint: str,
    value: str = "value",
    trigger_seconds: int = 1,
    available_now: bool = False,
) -> StreamingQuery:
    """Validate a stream of JSON records into the log at ``path``: ``events`` are decoded, ``rejects``
    carry ``broken_rules``; other columns of the records are kept in both."""
    log = VersionedLog(records.sparkSession, path)

    def sink(batch: DataFrame, batch_id: int) -> None:
        if log.committed(batch_id):
            return
        # The rules are worked out once for both parts.
        checked = validate_events(batch, value).persist()
        try:
            valid = F.size("broken_rules") == 0
            log.commit(
                batch_id,
                {
                    EVENTS: parse_clicks(checked.where(valid).drop("broken_rules"), value),
                    REJECTS: checked.where(~valid),
                },
            )
        finally:
            checked.unpersist()

    trigger = {"availableNow": True} if available_now else {"processingTime": f"{trigger_seconds} seconds"}
    return (
        records.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(sink)
        .start()
    )
