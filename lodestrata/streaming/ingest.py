"""New documents as they arrive, each content once, and event counts by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def document_stream(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_seen(stream: DataFrame, time: str = "arrived", late: str = "1 day") -> DataFrame:
    """Each content hash once within the watermark; state older than that is dropped."""
    return stream.withColumn("content_hash", F.sha2(F.col("text").cast("binary"), 256)).withWatermark(time, late).dropDuplicatesWithinWatermark(["content_hash"])


def windowed_counts(stream: DataFrame, time: str = "ts", late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    return stream.withWatermark(time, late).groupBy(F.window(time, width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def append_to(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there now and stop; the checkpoint makes a rerun pick up where this ended."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
