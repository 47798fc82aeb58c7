"""A replay-safe folder sink: one folder per micro-batch, replaced when the batch is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def start_log(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    mode: str,
    trigger_seconds: int = 1,
    available_now: bool = False,
) -> StreamingQuery:
    """Write each micro-batch to ``path/batch_id=N``; read the log with ``spark.read.parquet(path)``."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": f"{trigger_seconds} seconds"}
    return (
        rows.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .foreachBatch(sink)
        .start()
    )
