"""Incremental processing with Structured Streaming: watermarked dedupe and windows, merges by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def deduplicated(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Each key once, as long as repeats come within ``late``; state older than that goes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, at: str, by: list[str], value: str, width: str, late: str = "1 day") -> DataFrame:
    """Counts and sums by time window; a window is final once the watermark passes it."""
    w = stream.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), *by)
    return w.agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), *by, "n", "total")


def merge_batches(stream: DataFrame, checkpoint: str, merge: Callable[[DataFrame, int], None]):
    """Runs merge(batch, id) for each micro-batch available now and stops; merge must be idempotent in id."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
