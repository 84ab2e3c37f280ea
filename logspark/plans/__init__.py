"""From lines to logical entries: layout detection, parsing, merging."""

from .formats import detect_formats
from .parse import merge_entries, parse_lines, to_entries

__all__ = ["detect_formats", "merge_entries", "parse_lines", "to_entries"]
