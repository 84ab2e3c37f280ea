"""Structured Streaming over log directories (an extension: the batch queries' columns on a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import light_level, normalize_extended, parse_timestamp
from ..functions.timestamps import ANYWHERE


def stream_lines(spark: SparkSession, directory: str) -> DataFrame:
    """raw, ts, level, pattern of lines as files arrive; no merging of continuation lines."""
    lines = spark.readStream.text(directory).select(F.make_valid_utf8("value").alias("raw"))
    stamp = parse_timestamp(F.regexp_extract("raw", ANYWHERE, 1))
    return lines.select("raw", stamp["ts"].cast("timestamp").alias("ts"), light_level(F.col("raw")).alias("level"), normalize_extended(F.col("raw")).alias("pattern"))


def windowed_counts(stream: DataFrame, size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Lines per window and level; rows later than the watermark are dropped."""
    counted = stream.where("ts is not null").withWatermark("ts", late).groupBy(F.window("ts", size), "level").count()
    return counted.select(F.col("window.start").alias("bucket_start"), "level", "count")
