"""The seven queries on files: each gives its result tables, and a report on demand."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as O
from . import render
from .functions.predicates import LogQueryError, java_pattern, uses_classifier
from .model.scoring import LineModel, score_lines
from .operators.errors import classified_candidates, error_candidates
from .operators.search import scanned
from .plans import to_entries
from .sources import file_sizes, read_lines


@dataclass
class Report:
    """Named DataFrames; ``render()`` collects them (all are bounded by the query's limits) into text."""

    tables: dict[str, DataFrame]
    text: Callable[[dict[str, list]], str] = field(repr=False)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def render(self) -> str:
        return self.text({k: v.collect() for k, v in self.tables.items()})


class LogEngine:
    """Queries on log files. ``prefilter`` lets a model narrow searches and error grouping to lines it marks; off by default."""

    def __init__(self, spark: SparkSession, model: LineModel | None = None, rescore: Callable[[DataFrame], DataFrame] | None = None, recursive: bool = False):
        self.spark, self.model, self.rescore, self.recursive = spark, model, rescore, recursive

    def lines(self, path: str | Sequence[str]) -> DataFrame:
        """Of a file, several, or (``recursive``) all *.log files below directories; lines are numbered file by file."""
        return read_lines(self.spark, path, self.recursive)

    def entries(self, path: str, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
        return to_entries(self.lines(path), None, start_line, end_line)

    def scored(self, path: str) -> DataFrame:
        if self.model is None:
            raise LogQueryError("No classifier model is loaded")
        return score_lines(self.lines(path), self.model)

    def overview(self, path: str, sample_lines: int = 10) -> Report:
        lines, entries = self.lines(path), self.entries(path)
        tables = {"summary": O.overview_summary(lines, entries), "levels": O.overview_levels(entries), "ends": O.overview_ends(lines, sample_lines).orderBy("line_number"), "size": file_sizes(self.spark, [path] if isinstance(path, str) else path, self.recursive).agg(F.sum("bytes").alias("bytes"))}
        return Report(tables, lambda t: render.overview(path, t["size"][0]["bytes"] or 0, t["summary"][0], t["levels"], t["ends"]))

    def search(self, path: str, pattern: str | None = None, log_level: str | None = None, start_time: str | None = None, end_time: str | None = None, max_results: int = 50, prefilter: bool = False) -> Report:
        if pattern:
            java_pattern(pattern)
        if prefilter and self.model is not None and uses_classifier(pattern, log_level):
            from .functions import light_level, parse_timestamp
            from .functions.timestamps import ISO

            look = self.scored(path).where(F.col("p_look") >= 0.3)
            found = parse_timestamp(F.regexp_extract("raw", f"({ISO})", 1), strict=True)
            entries = look.select("file_path", "line_number", "raw", found["ts"].alias("ts"), light_level(F.col("raw")).alias("level"), F.col("raw").alias("message"))
        else:
            entries = self.entries(path)
        got = O.search_entries(entries, pattern, log_level, start_time, end_time, max_results)
        return Report({"matches": got, "counts": scanned(entries, got, max_results)}, lambda t: render.matches(t["matches"], t["counts"][0]))

    def segment(self, path: str, start_line: int | None = None, end_line: int | None = None, start_time: str | None = None, end_time: str | None = None, max_lines: int = 200) -> Report:
        got = O.segment_entries(self.entries(path, start_line, end_line), start_time, end_time, max_lines)
        tables = {"entries": got, "total": self.lines(path).agg(F.count("*").alias("n"))}
        return Report(tables, lambda t: render.segment(t["entries"], t["total"][0]["n"], max_lines))

    def errors(self, path: str, include_stack_traces: bool = True, max_unique_errors: int = 30, prefilter: bool = False) -> Report:
        if prefilter and self.model is not None:
            from .functions import light_level, parse_timestamp
            from .functions.timestamps import ISO

            found = parse_timestamp(F.regexp_extract("raw", f"({ISO})", 1), strict=True)
            candidates = classified_candidates(self.scored(path).withColumn("level", light_level(F.col("raw"))).withColumn("ts", found["ts"]))
        else:
            candidates = error_candidates(self.entries(path))
        tables = {"groups": O.error_groups(candidates, max_unique_errors, include_stack_traces), "summary": O.error_summary(candidates)}
        return Report(tables, lambda t: render.errors(t["groups"], t["summary"][0]))

    def stats(self, path: str, bucket_size: str = "auto", top_patterns: int = 20) -> Report:
        entries = self.entries(path)
        histogram = O.stats_histogram(entries, bucket_size)
        tables = {"span": O.stats_span(entries), "levels": O.stats_levels(entries), "histogram": histogram, "patterns": O.stats_patterns(entries, top_patterns), "peak": O.stats_peak(histogram)}
        return Report(tables, lambda t: render.stats(t["span"][0], t["levels"], t["histogram"], t["span"][0]["bucket"] or "1h" if bucket_size == "auto" else bucket_size, t["patterns"], t["peak"][0] if t["peak"] else None))

    def compare(self, paths: Sequence[str], max_unique_per_file: int = 50, max_shared_patterns: int = 20, frequency_ratio_threshold: float = 2.0) -> Report:
        if not 2 <= len(paths) <= 26:
            raise LogQueryError("Two to 26 files are needed")
        labels = [chr(65 + i) for i in range(len(paths))]
        every = None
        for label, path in zip(labels, paths, strict=True):
            one = self.entries(path).withColumn("file_path", F.lit(label))
            every = one if every is None else every.unionByName(one)
        score = (lambda df: score_lines(df, self.model, "scored_text")) if self.model else None
        p = O.compare_patterns(every, labels, score)
        tables = {
            "summary": O.compare_summary(p, labels), "unique": O.compare_unique(p, max_unique_per_file).orderBy("file_label", F.desc("p_look"), F.desc("count"), "pattern"),
            "shared": O.compare_shared(p, labels, max_shared_patterns).orderBy(F.desc("p_look"), F.desc("total"), "pattern"), "outliers": O.compare_outliers(p, labels, frequency_ratio_threshold),
        }
        files = dict(zip(labels, paths, strict=True))
        return Report(tables, lambda t: render.compare(files, t["summary"][0], t["unique"], t["shared"], t["outliers"], frequency_ratio_threshold, self.model is not None))

    def classify(self, path: str, threshold: float = 0.5, max_lines: int = 0, max_look_lines: int = 200, output: str = "summary") -> Report:
        if output not in ("summary", "look_only"):
            raise LogQueryError(f"Unknown output format '{output}'. Use 'summary' or 'look_only'.")
        scored = self.scored(path)
        if max_lines:
            scored = scored.where(F.col("line_number") <= max_lines)
        began = time.time()
        captured = O.classify_lines(scored, threshold, 0, max_look_lines, self.rescore)
        tables = {"counts": O.classify_counts(scored, threshold), "captured": captured.orderBy("line_number"), "confidence": O.confidence(captured)}
        return Report(tables, lambda t: render.classification(path, t["counts"][0], t["captured"], threshold, output, time.time() - began))
