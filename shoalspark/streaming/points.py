"""Point streams: watermarked counts by source, and checks on each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_counts(stream: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count and mean value by event type and window; rows later than the watermark are left out."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Run a table operator on every micro-batch and write its rows; a batch that is run again replaces its own."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
