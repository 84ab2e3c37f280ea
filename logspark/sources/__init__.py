"""Log sources, sinks and adapters."""

from .adapters import conv_lines, doc_lines, events_entries, events_json, events_raw, page_lines
from .files import count_lines, file_sizes, format_size, read_csv_truth, read_jsonl, read_lines, validate_paths, write_json, write_jsonl, write_text
from .synthetic import synthetic_server_log

__all__ = [
    "conv_lines", "count_lines", "doc_lines", "events_entries", "events_json", "events_raw", "file_sizes", "format_size", "page_lines",
    "read_csv_truth", "read_jsonl", "read_lines", "synthetic_server_log", "validate_paths", "write_json", "write_jsonl", "write_text",
]
