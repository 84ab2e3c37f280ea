"""Comparison of several logs by message pattern: one aggregation for all files, no joins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import normalize


def compare_patterns(entries: DataFrame, labels: Sequence[str], score: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """pattern, counts and levels (maps by file label), n_files, total, low, high, p_look.

    ``score`` adds p_look to distinct patterns, given a column ``scored_text``; without it p_look is 0.
    """
    prefix = F.when(F.col("prefix").isNotNull(), F.concat(normalize(F.col("prefix")), F.lit(" | "))).otherwise("")
    keyed = entries.where(F.col("file_path").isin(*labels)).withColumn("pattern", F.concat(prefix, normalize(F.col("message"))))
    per_file = keyed.groupBy("pattern", "file_path").agg(F.count("*").alias("n"), F.min_by("level", "line_number").alias("level"))
    both = F.array_sort(F.collect_list(F.struct("file_path", "n", "level")))
    out = per_file.groupBy("pattern").agg(both.alias("f"), F.sum("n").alias("total"), F.min("n").alias("low"), F.max("n").alias("high"), F.count("*").alias("n_files"))
    first_level = F.get(F.filter("f", lambda x: x["level"].isNotNull()), F.lit(0))["level"]
    out = out.select(
        "pattern", F.map_from_arrays("f.file_path", "f.n").alias("counts"), F.map_from_arrays("f.file_path", "f.level").alias("levels"), "total", "low", "high", "n_files",
        F.concat(F.when(first_level.isNotNull(), F.concat(F.lit("["), first_level, F.lit("] "))).otherwise(""), "pattern").alias("scored_text"),
    )
    return score(out) if score else out.withColumn("p_look", F.lit(0.0))


def compare_unique(patterns: DataFrame, limit: int | None = 50) -> DataFrame:
    """file_label, pattern, level, count, p_look: patterns of one file only, the most telling of each."""
    alone = patterns.where("n_files = 1").select(F.map_keys("counts")[0].alias("file_label"), "pattern", F.map_values("levels")[0].alias("level"), F.col("total").alias("count"), "p_look")
    if limit is None:
        return alone
    order = W.partitionBy("file_label").orderBy(F.desc("p_look"), F.desc("count"), "pattern")
    return alone.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= limit).drop("_r")


def compare_shared(patterns: DataFrame, labels: Sequence[str], limit: int | None = 20) -> DataFrame:
    """pattern, level (the first file's), count_<label>, total, p_look: patterns of all files."""
    shared = patterns.where(F.col("n_files") == len(labels))
    if limit is not None:
        shared = shared.orderBy(F.desc("p_look"), F.desc("total"), "pattern").limit(limit)
    return shared.select("pattern", F.try_element_at("levels", F.lit(labels[0])).alias("level"), *[F.try_element_at("counts", F.lit(x)).alias(f"count_{x}") for x in labels], "total", "p_look")


def compare_outliers(patterns: DataFrame, labels: Sequence[str], threshold: float = 2.0) -> DataFrame:
    """Shared patterns whose largest count is at least ``threshold`` times the smallest; ratio to one decimal."""
    ratio = F.col("high") / F.col("low")
    found = patterns.where((F.col("n_files") == len(labels)) & (ratio >= threshold))
    return found.select("pattern", F.try_element_at("levels", F.lit(labels[0])).alias("level"), F.bround(ratio, 1).alias("ratio"), "low", "high", "p_look").orderBy(F.desc("p_look"), F.desc("ratio"), "pattern")


def compare_summary(patterns: DataFrame, labels: Sequence[str]) -> DataFrame:
    """patterns, shared, and unique_<label>."""
    unique = [F.count(F.when((F.col("n_files") == 1) & F.map_contains_key("counts", F.lit(x)), 1)).alias(f"unique_{x}") for x in labels]
    return patterns.agg(F.count("*").alias("patterns"), F.count(F.when(F.col("n_files") == len(labels), 1)).alias("shared"), *unique)
