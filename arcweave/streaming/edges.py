"""Streams of edges that grow a network micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def append_edges(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append ``(src, dst[, value])`` of a stream to the edge table at ``path``.

    Each micro-batch is its own folder ``batch=<id>`` and is overwritten when it runs
    again, so edges arrive exactly once.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def degrees_over_time(stream: DataFrame, time_col: str, window: str, late: str) -> DataFrame:
    """Out-degree of each source per time window, with events later than ``late`` left out."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, window).alias("window"), "src").agg(F.count("*").alias("degree"))
