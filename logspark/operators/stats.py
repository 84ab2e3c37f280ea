"""Volume statistics: levels, time histogram, span, top patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import is_error_level, normalize_extended, time_bucket

# The automatic bucket is the first that cuts the span into 10 to 80 pieces.
BUCKETS = {"1s": 1, "10s": 10, "30s": 30, "1m": 60, "5m": 300, "15m": 900, "1h": 3600, "6h": 21600, "1d": 86400}


def auto_bucket(span_seconds: Column) -> Column:
    """Label of the bucket for a span; 1h if none fits."""
    out = F.lit("1h")
    for label, size in reversed(BUCKETS.items()):
        out = F.when((span_seconds / size >= 10) & (span_seconds / size <= 80), label).otherwise(out)
    return out


def bucket_seconds(label: Column) -> Column:
    out = F.lit(3600)
    for name, size in BUCKETS.items():
        out = F.when(label == name, size).otherwise(out)
    return out


def stats_levels(entries: DataFrame) -> DataFrame:
    found = entries.where(F.col("level").isNotNull()).groupBy("level")
    return found.agg(F.count("*").alias("count"), F.min("line_number").alias("first_line")).orderBy("first_line")


def stats_span(entries: DataFrame) -> DataFrame:
    """entries, min_ts, max_ts, span_s, errors, error_pct, span_text, bucket (what "auto" chooses)."""
    got = entries.agg(
        F.count("*").alias("entries"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"),
        F.count(F.when(is_error_level(F.col("level")), 1)).alias("errors"),
    )
    got = got.withColumn("span_s", F.timestamp_diff("MICROSECOND", F.col("min_ts"), F.col("max_ts")) / 1e6)
    text = F.when(F.col("span_s") >= 3600, F.format_string("%.1fh", F.col("span_s") / 3600)).when(F.col("span_s") >= 60, F.format_string("%.0fm", F.col("span_s") / 60))
    text = text.when(F.col("span_s").isNotNull(), F.format_string("%.0fs", F.col("span_s")))
    pct = F.when(F.col("entries") > 0, F.col("errors") / F.col("entries") * 100).otherwise(0.0)
    return got.select("entries", "min_ts", "max_ts", "span_s", "errors", pct.alias("error_pct"), text.alias("span_text"), auto_bucket(F.col("span_s")).alias("bucket"))


def stats_histogram(entries: DataFrame, bucket_size: str = "auto") -> DataFrame:
    """bucket_start, count, first_line: buckets that hold entries, in order of first appearance."""
    stamped = entries.where(F.col("ts").isNotNull())
    if bucket_size == "auto":
        size = stats_span(entries).select(bucket_seconds(F.col("bucket")).alias("_size"))
        stamped = stamped.join(F.broadcast(size))  # a single row
        seconds = F.col("_size")
    else:
        seconds = F.lit(BUCKETS.get(bucket_size, 3600))
    grouped = stamped.groupBy(time_bucket(F.col("ts"), seconds).alias("bucket_start"))
    return grouped.agg(F.count("*").alias("count"), F.min("line_number").alias("first_line")).orderBy("first_line")


def stats_peak(histogram: DataFrame) -> DataFrame:
    """The fullest bucket; of equals the one that appears first."""
    return histogram.orderBy(F.desc("count"), "first_line").limit(1).select("bucket_start", "count")


def stats_patterns(entries: DataFrame, top: int | None = 20) -> DataFrame:
    """pattern, count, first_line: the most frequent messages; of equals the one that appears first."""
    grouped = entries.groupBy(normalize_extended(F.col("message")).alias("pattern"))
    out = grouped.agg(F.count("*").alias("count"), F.min("line_number").alias("first_line")).orderBy(F.desc("count"), "first_line")
    return out if top is None else out.limit(top)
