"""Windows of lines for labelling, and labels back to lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

WINDOW = 50


def label_windows(lines: DataFrame, size: int = WINDOW) -> DataFrame:
    """custom_id ({dataset}_{start}), dataset, start_line, n_lines, request (JSON of the numbered lines)."""
    start = (F.floor((F.col("line_number") - 1) / size) * size + 1).cast("bigint")
    grouped = lines.groupBy(F.col("file_path").alias("dataset"), start.alias("start_line"))
    out = grouped.agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct((F.col("line_number") - start + 1).alias("line"), "raw"))).alias("lines"))
    return out.select(F.concat_ws("_", "dataset", F.col("start_line").cast("string")).alias("custom_id"), "dataset", "start_line", "n_lines", F.to_json(F.struct("lines")).alias("request"))


def parse_custom_id(c) -> tuple:
    """(dataset, start line) of a window's id."""
    return F.regexp_extract(c, r"^(.+)_(\d+)$", 1), F.regexp_extract(c, r"^(.+)_(\d+)$", 2).try_cast("bigint")


def strip_fence(c):
    """An answer without the code fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```\w*\n?", ""), r"\n?```$", "")


def remap_labels(labels: DataFrame, lines: DataFrame) -> DataFrame:
    """Labels (custom_id, window_line, label, reason) on the lines they are about; a missing line is empty."""
    dataset, start = parse_custom_id(F.col("custom_id"))
    placed = labels.select(dataset.alias("system"), (start + F.col("window_line") - 1).alias("line_number"), "label", "reason")
    raw = lines.select(F.col("file_path").alias("system"), "line_number", F.col("raw").alias("raw_line"))
    return placed.join(raw, ["system", "line_number"], "left").select("system", "line_number", F.coalesce("raw_line", F.lit("")).alias("raw_line"), "label", "reason")


def new_datasets(lines: DataFrame, labelled: DataFrame) -> DataFrame:
    """Datasets without labels."""
    return lines.select(F.col("file_path").alias("dataset")).distinct().join(labelled.select(F.col("system").alias("dataset")).distinct(), "dataset", "left_anti")


def split_bgl(raw) -> tuple:
    """(label, rest) of a line that a label begins: "-" means SKIP, anything else LOOK."""
    parts = F.split(raw, " ", 2)
    return F.when(F.get(parts, F.lit(0)) == "-", "SKIP").otherwise("LOOK"), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def validate_labels(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """The confusion of labels with the truth (both line_number, label) about the lines that both know; LOOK is positive."""
    from .evaluate import confusion

    both = labels.select("line_number", (F.col("label") == "LOOK").alias("predicted")).join(truth.select("line_number", (F.col("label") == "LOOK").alias("truth")), "line_number")
    return confusion(both)


def with_previous(now: DataFrame, before: DataFrame, *measures: str, key: str = "file_path") -> DataFrame:
    """A run's rows by ``key`` beside those of an earlier run, and the differences; what only one run has stays, with nulls."""
    old = before.select(F.col(key).alias("_key"), *[F.col(m).alias(f"previous_{m}") for m in measures])
    joined = now.select(key, *measures).join(old, F.col(key).eqNullSafe(F.col("_key")), "full")
    return joined.select(F.coalesce(key, "_key").alias(key), *[c for m in measures for c in (F.col(m), F.col(f"previous_{m}"), (F.col(m) - F.col(f"previous_{m}")).alias(f"{m}_change"))])


def sample_evenly(scored: DataFrame, threshold: float = 0.5, n: int = 8) -> DataFrame:
    """n LOOK lines of each file at even distances in file order, the first and the last among them; all if there are no more."""
    look = scored.where(F.col("p_look") >= threshold)
    total = look.groupBy("file_path").agg(F.count("*").alias("_all"))
    ranked = look.withColumn("_r", F.row_number().over(W.partitionBy("file_path").orderBy("line_number")) - 1).join(total, "file_path")
    # The row taken for the i-th of n is floor(i * (all - 1) / (n - 1)): the rows at which that quotient takes a new value.
    taken = F.exists(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * (F.col("_all") - 1) / max(1, n - 1)) == F.col("_r"))
    return ranked.where((F.col("_all") <= n) | taken).drop("_r", "_all")


def sample_unmarked(scored: DataFrame, threshold: float = 0.5, n: int = 20, seed: int = 1) -> DataFrame:
    """Up to n LOOK lines of each file without error or warning words, drawn by seeded hash."""
    from ..functions.predicates import WARN_WORDS, WIDE_ERROR_WORDS

    plain = scored.where((F.col("p_look") >= threshold) & ~F.col("raw").rlike("(?iU)" + WIDE_ERROR_WORDS + "|" + WARN_WORDS))
    order = W.partitionBy("file_path").orderBy(F.xxhash64("line_number", "raw", F.lit(seed)), "line_number")
    return plain.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r")
