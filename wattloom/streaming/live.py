"""Streaming forms of ingest and sessions: an extension, since batch is the rule here."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def file_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def windowed_sums(stream: DataFrame, ts: str, keys: list[str], value: str, width: str = "15 minutes", late: str = "1 hour") -> DataFrame:
    """Sums by tumbling window; rows later than the watermark are dropped. Naive times count as UTC."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.groupBy(F.window(ts, width), *keys).agg(F.sum(value).alias("total"), F.count(value).alias("n")).select("window.start", "window.end", *keys, "total", "n")


def without_repeats(stream: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return timed.dropDuplicatesWithinWatermark([*keys, ts])


def live_sessions(stream: DataFrame, ts: str, keys: list[str], value: str, least: float, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Sessions of rows at ``least`` or above; one ends when the next interval has no such row."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).filter(F.col(value) >= least)
    return timed.groupBy(F.session_window(ts, f"{minutes * 60 + 1} seconds"), *keys).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_power")).select("session_window.start", *keys, "n", "mean_power")


def drain(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what is there into Parquet, resuming after what an earlier run has committed."""
    stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
