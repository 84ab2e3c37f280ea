"""Line classification: LOOK or SKIP by probability."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import ERROR_WORDS, WARN_WORDS

CASCADE = 0.6


def label_lines(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("label", F.when(F.col("p_look") >= threshold, "LOOK").otherwise("SKIP"))


def classify_lines(scored: DataFrame, threshold: float = 0.5, max_lines: int = 0, max_look_lines: int = 200, rescore: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """line_number, p_look, raw of the first LOOK lines in file order.

    With ``rescore`` (a costlier model that replaces p_look) the first model passes what reaches a lower threshold,
    and only that is scored again.
    """
    if max_lines:
        scored = scored.where(F.col("line_number") <= max_lines)
    look = scored.where(F.col("p_look") >= (CASCADE * threshold if rescore else threshold))
    look = look.orderBy("line_number").limit(max_look_lines or 999_999)
    if rescore:
        look = rescore(look).where(F.col("p_look") >= threshold)
    return look.select("line_number", "p_look", "raw")


def classify_counts(scored: DataFrame, threshold: float = 0.5, error_words: str = ERROR_WORDS, exclusive: bool = True) -> DataFrame:
    """total, look, skip, and how many lines with error and warning words there are and are found."""
    look = F.col("p_look") >= threshold
    error = F.col("raw").rlike("(?iU)" + error_words)
    warn = F.col("raw").rlike("(?iU)" + WARN_WORDS)
    warn = warn & ~error if exclusive else warn
    return scored.agg(
        F.count("*").alias("total"), F.count_if(look).alias("look"), F.count_if(~look).alias("skip"),
        F.count_if(error).alias("error_total"), F.count_if(error & look).alias("error_captured"),
        F.count_if(warn).alias("warn_total"), F.count_if(warn & look).alias("warn_captured"),
    )


def confidence(captured: DataFrame) -> DataFrame:
    """high (0.9 and more), medium (0.7 and more), low, among captured lines."""
    p = F.col("p_look")
    return captured.agg(F.count_if(p >= 0.9).alias("high"), F.count_if((p >= 0.7) & (p < 0.9)).alias("medium"), F.count_if(p < 0.7).alias("low"))
