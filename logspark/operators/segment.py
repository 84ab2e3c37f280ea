"""Segment of a log by lines and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import in_time_range
from ..functions.predicates import parse_bound


def segment_entries(entries: DataFrame, start_time: str | None = None, end_time: str | None = None, max_lines: int = 200) -> DataFrame:
    """The first ``max_lines`` entries within the bounds, up to the first one past the end.

    A line range is the business of ``to_entries``, which cuts before lines merge.
    """
    start, end = parse_bound(start_time), parse_bound(end_time)
    utc = F.col("ts_utc") if "ts_utc" in entries.columns else F.col("ts")
    if end is not None:
        past = entries.where(F.col("ts").isNotNull() & ~in_time_range(F.col("ts"), utc, None, end)).agg(F.min("line_number").alias("_stop"))
        entries = entries.join(F.broadcast(past)).where(F.col("_stop").isNull() | (F.col("line_number") < F.col("_stop"))).drop("_stop")  # a single row
    if start or end:
        entries = entries.where(in_time_range(F.col("ts"), utc, start, end))
    return entries.orderBy("line_number").limit(max_lines)
