"""Incremental runs: facts of changed files as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def changed_sources(spark: SparkSession, folder: str, watermark: str = "1 hour") -> DataFrame:
    """A stream of (path, content, ts) from Parquet drops; rows later than the watermark are left out of aggregates."""
    return spark.readStream.schema("path string, content string, ts timestamp").parquet(folder).withWatermark("ts", watermark)


def issue_rates(sources: DataFrame, window: str = "10 minutes") -> DataFrame:
    """Secrets by type in each window of event time, over a batch or a stream."""
    from corvane.operators.secrets import PATTERNS

    line = sources.select("ts", F.explode(F.split("content", "\n")).alias("t"))
    kinds = F.filter(F.array(*[F.when(F.col("t").rlike(p), k) for k, p in PATTERNS.items()]), lambda x: x.isNotNull())
    return line.select("ts", F.explode(kinds).alias("type")).groupBy(F.window("ts", window), "type").agg(F.count("*").alias("n"))
