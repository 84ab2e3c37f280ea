"""Log levels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
KNOWN = ("TRACE", "DEBUG", "INFO", "WARN", "WARNING", "ERROR", "FATAL", "CRITICAL", "CRIT", "ALERT", "EMERG", "NOTICE")
ALIASES = {"CRIT": "CRITICAL", "EMERG": "FATAL", "ALERT": "FATAL"}
ANYWHERE = r"(?i)\b(EMERGENCY|FATAL|CRITICAL|ERROR|WARN(?:ING)?|INFO|DEBUG|TRACE|NOTICE)\b"


def fold_level(c: Column) -> Column:
    """Upper case, WARNING as WARN: the form in which levels are compared."""
    up = F.upper(F.trim(c))
    return F.when(up == "WARNING", "WARN").otherwise(up)


def canonical_level(c: Column) -> Column:
    """Aliases of syslog severities resolved."""
    for alias, level in ALIASES.items():
        c = F.when(c == alias, level).otherwise(c)
    return c


def light_level(c: Column) -> Column:
    """The first level word anywhere in a line; null if there is none."""
    return fold_level(F.nullif(F.regexp_extract(c, ANYWHERE, 1), F.lit("")))
