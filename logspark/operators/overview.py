"""Overview: counts, first and last time stamp in file order, levels, first and last lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overview_summary(lines: DataFrame, entries: DataFrame) -> DataFrame:
    """lines, first_ts, last_ts (of the first and last entry that has one, which need not be the least and greatest)."""
    counted = lines.agg(F.count("*").alias("lines"))
    stamped = F.when(F.col("ts").isNotNull(), F.col("line_number"))
    return counted.join(entries.agg(F.min_by("ts", stamped).alias("first_ts"), F.max_by("ts", stamped).alias("last_ts")))


def overview_levels(entries: DataFrame) -> DataFrame:
    """level, count, first_line, in order of first appearance."""
    found = entries.where(F.col("level").isNotNull()).groupBy("level")
    return found.agg(F.count("*").alias("count"), F.min("line_number").alias("first_line")).orderBy("first_line")


def overview_ends(lines: DataFrame, n: int = 10) -> DataFrame:
    """part (head or tail), line_number, raw: the first and last n lines, by arithmetic on line numbers."""
    total = lines.agg(F.max("line_number").alias("_total"))
    head = lines.where(F.col("line_number") <= n).select(F.lit("head").alias("part"), "line_number", "raw")
    tail = lines.join(F.broadcast(total)).where(F.col("line_number") > F.col("_total") - n)  # a single row
    return head.unionByName(tail.select(F.lit("tail").alias("part"), "line_number", "raw"))
