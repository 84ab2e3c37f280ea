"""Message normalisation: variable parts become placeholders, so like messages group together."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern, placeholder, ignore case; in the order in which they apply.
UUID = (r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>", True)
LONG_HEX = (r"\b[0-9a-f]{12,}\b", "<HEX>", True)
PREFIXED_HEX = (r"0x[0-9a-fA-F]+", "<HEX>", False)
IP = (r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>", False)
IDENTIFIER = (r"\b[a-z]+_(?=[a-z]*\d)[a-z0-9]{4,}\b", "<ID>", True)
NUMBER = (r"\b\d+", "<N>", False)
DOUBLE_QUOTED = (r'"[^"]*"', '"<STR>"', False)
SINGLE_QUOTED = (r"'[^']*'", "'<STR>'", False)

BASE = (UUID, LONG_HEX, PREFIXED_HEX, IDENTIFIER, NUMBER)
EXTENDED = (UUID, LONG_HEX, PREFIXED_HEX, IP, IDENTIFIER, NUMBER, DOUBLE_QUOTED, SINGLE_QUOTED)


def strip(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def substitute(c: Column, rules) -> Column:
    for pattern, placeholder, ignore_case in rules:
        c = F.regexp_replace(c, ("(?iU)" if ignore_case else "(?U)") + pattern, placeholder)
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def normalize(c: Column) -> Column:
    return substitute(c, BASE)


def normalize_extended(c: Column) -> Column:
    return substitute(c, EXTENDED)
