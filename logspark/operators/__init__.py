"""The query operators, each a function of lines or entries that returns DataFrames."""

from .classify import classify_counts, classify_lines, confidence
from .compare import compare_outliers, compare_patterns, compare_shared, compare_summary, compare_unique
from .errors import error_groups, error_summary
from .overview import overview_ends, overview_levels, overview_summary
from .search import search_entries
from .segment import segment_entries
from .stats import auto_bucket, stats_histogram, stats_levels, stats_patterns, stats_peak, stats_span

__all__ = [
    "auto_bucket", "classify_counts", "classify_lines", "compare_outliers", "compare_patterns", "compare_shared", "compare_summary", "compare_unique",
    "confidence", "error_groups", "error_summary", "overview_ends", "overview_levels", "overview_summary", "search_entries", "segment_entries",
    "stats_histogram", "stats_levels", "stats_patterns", "stats_peak", "stats_span",
]
