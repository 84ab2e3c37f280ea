"""Error grouping by fingerprint."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import is_content_error, is_error_level, normalize

TRACE_LINES = 10


def error_candidates(entries: DataFrame) -> DataFrame:
    """Entries of an error level; if there is none at all, those whose message reads like an error (``by_content``)."""
    by_level = is_error_level(F.col("level"))
    some = entries.where(by_level).limit(1).agg((F.count("*") > 0).alias("_some"))
    chosen = entries.join(F.broadcast(some)).where(F.when(F.col("_some"), by_level).otherwise(is_content_error(F.col("message"))))  # a single row
    return chosen.withColumn("by_content", ~F.col("_some")).drop("_some")


def error_groups(candidates: DataFrame, max_unique_errors: int | None = 30, include_stack_traces: bool = True) -> DataFrame:
    """fingerprint, count, first_line, first_ts, last_line, last_ts, stack_trace; most frequent first.

    Kept are the fingerprints that appear first, not the most frequent. A stack trace is the rest of the first entry.
    """
    keyed = candidates.withColumn("fingerprint", normalize(F.col("message")))
    grouped = keyed.groupBy("fingerprint").agg(
        F.count("*").alias("count"), F.min("line_number").alias("first_line"), F.min_by("ts", "line_number").alias("first_ts"),
        F.max("line_number").alias("last_line"), F.max_by("ts", "line_number").alias("last_ts"), F.min_by("raw", "line_number").alias("_raw"),
    )
    if max_unique_errors is not None:
        grouped = grouped.orderBy("first_line").limit(max_unique_errors)
    lines = F.split("_raw", "\n")
    rest = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    more = F.size(rest) - TRACE_LINES
    shown = F.when(more > 0, F.concat(F.slice(rest, 1, TRACE_LINES), F.array(F.format_string("... (%d more lines)", more)))).otherwise(rest)
    trace = F.when(F.size(rest) > 0, F.array_join(shown, "\n")) if include_stack_traces else F.lit(None).cast("string")
    return grouped.withColumn("stack_trace", trace).drop("_raw").orderBy(F.desc("count"), "first_line")


def error_summary(candidates: DataFrame) -> DataFrame:
    """total_errors (dropped groups included), by_content."""
    return candidates.agg(F.count("*").alias("total_errors"), F.coalesce(F.bool_or("by_content"), F.lit(True)).alias("by_content"))


def classified_candidates(scored: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Candidates among scored lines: the text of each is its message, so nothing merges and time stamps stay in fingerprints."""
    look = scored.where(F.col("p_look") >= threshold).withColumn("message", F.col("raw"))
    return error_candidates(look)
