"""Incremental ingest: the batch operators under Structured Streaming."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each key with the highest version, as an aggregate with partial sums; ties by all columns."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), F.struct(version, *[c for c in df.columns if c != version])).alias("r")).select("r.*")


def stream_documents(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Append transformed batches to sink, one folder a batch; a batch that runs again overwrites its own folder, so nothing doubles."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upserted(spark: SparkSession, sink: str, key: str) -> DataFrame:
    """What a sink holds now: of every key the row of the latest batch."""
    return latest(spark.read.parquet(sink), key, "batch").drop("batch")


def window_counts(events: DataFrame, time: str = "ts", by: str = "event_type", length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; works on streams (with a watermark) and tables alike."""
    timed = events
    if events.isStreaming:  # watermarks want time-zoned time; the session's zone gives it and takes it back
        timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    w = F.window(time, length, slide) if slide else F.window(time, length)
    return timed.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast(events.schema[time].dataType).alias("start"), by, "n", "total")
