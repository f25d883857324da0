"""The text plan on streams, and running audit counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veilspan.operators.detections import explode_detections
from veilspan.plans.text import sanitize_texts


def sanitize_stream(stream: DataFrame, text: str = "text", **options) -> DataFrame:
    """The batch plan is row-local, so a stream runs through it unchanged."""
    if not stream.isStreaming:
        raise ValueError("expected a streaming DataFrame")
    return sanitize_texts(stream, text, **options)


def windowed_counts(
    detected: DataFrame,
    time: str = "ts",
    window: str = "1 hour",
    lateness: str = "1 hour",
    detections: str = "detections",
) -> DataFrame:
    """Detections per type and event-time window.

    Only a count per (window, type) is kept as state, and the watermark lets
    it be dropped once a window can no longer change.
    """
    rows = explode_detections(
        detected.withWatermark(time, lateness), [time], detections
    )
    return (
        rows.groupBy(F.window(time, window).alias("w"), "detection_type")
        .agg(F.count("*").alias("n"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "detection_type",
            "n",
        )
    )


def write_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to parquet, taking what is available and then stopping."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
