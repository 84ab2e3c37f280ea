"""Search by pattern, level and time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fold_level, in_time_range
from ..functions.predicates import matches, parse_bound


def search_entries(entries: DataFrame, pattern: str | None = None, log_level: str | None = None, start_time: str | None = None, end_time: str | None = None, max_results: int = 50) -> DataFrame:
    """The first ``max_results`` matching entries in file order (one at least)."""
    if pattern:
        entries = entries.where(matches(F.col("raw"), pattern))
    if log_level:
        entries = entries.where(fold_level(F.col("level")) == ("WARN" if log_level.upper().strip() == "WARNING" else log_level.upper().strip()))
    start, end = parse_bound(start_time), parse_bound(end_time)
    if start or end:
        utc = F.col("ts_utc") if "ts_utc" in entries.columns else F.col("ts")
        entries = entries.where(in_time_range(F.col("ts"), utc, start, end))
    return entries.orderBy("line_number").limit(max(1, max_results))


def scanned(entries: DataFrame, found: DataFrame, max_results: int) -> DataFrame:
    """matches, truncated, scanned: entries read up to the last match if truncated, else all."""
    hit = found.agg(F.count("*").alias("matches"), F.max("line_number").alias("_last"))
    cut = F.col("matches") >= max(1, max_results)
    all_ = entries.join(F.broadcast(hit)).groupBy("matches").agg(  # a single row
        F.count(F.when(cut & (F.col("line_number") <= F.col("_last")) | ~cut, 1)).alias("scanned")
    )
    return hit.join(F.broadcast(all_.drop("matches")), how="left").select("matches", cut.alias("truncated"), F.coalesce("scanned", F.lit(0)).alias("scanned"))
