"""Timing counters over a stream of log lines: an extension of the batch operator, with a watermark for late lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators.metrics import counters
from terrasift.sources.readers import TIMING


def log_stream(spark: SparkSession, path: str, files_a_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(TIMING).option("maxFilesPerTrigger", files_a_trigger).json(path)


def windowed_counts(log: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """stage and window with the counters of terrasift.operators.metrics; state is dropped behind the watermark."""
    w = log.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "stage")
    out = w.agg(*counters(F.col("attempt"), F.col("outcome"), F.col("error"), F.col("retry_delay_seconds")))
    return out.select(F.col("w.start").alias("window_start"), "stage", "requests", "attempts", "retries", "timeouts", "failed", "waited")
