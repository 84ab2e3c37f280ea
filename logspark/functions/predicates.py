"""Filters of the query operators."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ERROR_LEVELS = ("ERROR", "FATAL", "CRITICAL")
CONTENT_ERROR = (
    r"##\[error\]"
    r"|(?:^|\s)error[:\s]"
    r"|(?:^|\s)fatal[:\s]"
    r"|\bfailed\b"
    r"|\bPermission denied\b"
    r"|\bcommand not found\b"
    r"|\bNo such file or directory\b"
    r"|\bunable to\b"
    r"|\bExited with code [1-9]"
    r"|\bsegmentation fault\b"
    r"|\bcannot find\b"
    r"|\bCould not\b"
    r"|\bnot found\b"
)
ROUTED_LEVELS = ("ERROR", "FATAL", "CRITICAL", "WARN", "WARNING")
ROUTED_WORDS = r"error|fatal|fail|exception|crash|timeout|panic|denied"
ERROR_WORDS = r"\bERROR\b|\bFATAL\b|\bCRITICAL\b|\bSEVERE\b|\bFAILURE\b|\bFAILED\b|\bException\b|\berror\b"
WARN_WORDS = r"\bWARN\b|\bWARNING\b"
WIDE_ERROR_WORDS = r"\b(ERROR|FATAL|CRITICAL|PANIC|FAIL(?:ED|URE)?|EXCEPTION|SEVERE|EMERG(?:ENCY)?)\b"
DATE_LAYOUTS = ("%Y-%m-%dT%H:%M:%S.%f%z", "%Y-%m-%dT%H:%M:%S%z", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%d %H:%M:%S.%f", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d")


class LogQueryError(ValueError):
    """A query that cannot run; its text starts with "Error: " as reports show it."""

    def __init__(self, message: str):
        super().__init__(f"Error: {message}")


def is_error_level(level: Column) -> Column:
    return F.coalesce(level.isin(*ERROR_LEVELS), F.lit(False))


def is_content_error(message: Column) -> Column:
    return message.rlike("(?iU)" + CONTENT_ERROR)


def java_pattern(pattern: str) -> str:
    """A user's pattern, checked, with named groups as Java writes them."""
    try:
        re.compile(pattern)
    except re.error as e:
        raise LogQueryError(f"Invalid regex pattern: {e}") from e
    return re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", re.sub(r"\(\?P<", "(?<", pattern))


def matches(c: Column, pattern: str) -> Column:
    return c.rlike("(?iU)" + java_pattern(pattern))


def parse_bound(value: str | None) -> datetime | None:
    """A user's time bound; one that cannot be parsed counts as not given."""
    for layout in DATE_LAYOUTS if value else ():
        try:
            return datetime.strptime(value, layout)
        except ValueError:
            continue
    return None


def in_time_range(ts: Column, ts_utc: Column, start: datetime | None, end: datetime | None) -> Column:
    """Within both bounds, inclusive; rows without time stamp pass. Naive bounds compare with the wall clock."""
    ok = F.lit(True)
    for bound, compare in ((start, Column.__ge__), (end, Column.__le__)):
        if bound is not None:
            at = ts if bound.tzinfo is None else ts_utc
            plain = bound.replace(tzinfo=None) - (bound.utcoffset() if bound.tzinfo else bound - bound)
            ok = ok & compare(at, F.lit(plain.isoformat(" ")).cast("timestamp_ntz"))
    return ts.isNull() | ok


def uses_classifier(pattern: str | None, level: str | None) -> bool:
    """Whether a search asks for what the line classifier finds."""
    return bool(level and level.upper() in ROUTED_LEVELS or pattern and re.search(ROUTED_WORDS, pattern, re.IGNORECASE))
