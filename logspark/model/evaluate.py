"""Evaluation against labels and against keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import WARN_WORDS, WIDE_ERROR_WORDS


def capture_rate(captured: Column, total: Column) -> Column:
    """Per cent; 100 where there is nothing to capture."""
    return F.when(total > 0, captured / total * 100).otherwise(100.0)


def keyword_capture(scored: DataFrame, by: str, threshold: float = 0.5, grand_total: bool = True) -> DataFrame:
    """Per group (and, as null, over all): lines, look, error and warning lines, captured ones, capture rates."""
    look = F.col("p_look") >= threshold
    error, warn = F.col("raw").rlike("(?iU)" + WIDE_ERROR_WORDS), F.col("raw").rlike("(?iU)" + WARN_WORDS)
    grouped = scored.rollup(by) if grand_total else scored.groupBy(by)
    out = grouped.agg(
        F.count("*").alias("lines"), F.count_if(look).alias("look"), F.count_if(error).alias("errors"), F.count_if(error & look).alias("errors_captured"),
        F.count_if(warn).alias("warns"), F.count_if(warn & look).alias("warns_captured"),
    )
    return out.withColumn("error_rate", capture_rate(F.col("errors_captured"), F.col("errors"))).withColumn("warn_rate", capture_rate(F.col("warns_captured"), F.col("warns")))


def confusion(judged: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, accuracy, precision, recall, f1 of boolean truth and predicted; undefined ratios are 0."""
    t, p = F.col("truth"), F.col("predicted")
    got = judged.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return got.select(
        "tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
        ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    )
