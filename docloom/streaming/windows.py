"""The library's frame functions on streams, with event-time windows (an addition: the dialect has no streams)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of a folder as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed(events: DataFrame, at: str, length: str, slide: str | None = None, late: str = "10 minutes", by: list[str] | None = None, **measures: Column) -> DataFrame:
    """Measures per window and key; rows later than ``late`` behind the newest are left out. Works on tables as well."""
    window = F.window(F.col(at).cast("timestamp"), length, slide) if slide else F.window(F.col(at).cast("timestamp"), length)
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    made = timed.groupBy(window.alias("_w"), *(by or [])).agg(*(c.alias(n) for n, c in measures.items()))
    return made.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *(by or []), *measures)


def sessions(events: DataFrame, at: str, gap: str, by: list[str], late: str = "10 minutes", **measures: Column) -> DataFrame:
    timed = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    made = timed.groupBy(F.session_window(F.col(at), gap).alias("_w"), *by).agg(*(c.alias(n) for n, c in measures.items()))
    return made.select(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), *by, *measures)


def run_available(stream: DataFrame, path: str, checkpoint: str, apply: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
    """What has arrived, through ``apply``, appended to a Parquet table exactly once; returns when it is done."""
    apply(stream).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
