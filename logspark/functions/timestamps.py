"""Time stamps of many layouts, as wall clock plus offset."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:[.,]\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
SLASHED = r"\d{2}/\d{2}/\d{2} \d{2}:\d{2}:\d{2}"
COMMON_LOG = r"\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}(?:\s[+-]\d{4})?"
SYSLOG = r"[A-Z][a-z]{2}\s+\d{1,2}\s+\d{2}:\d{2}:\d{2}"
ANYWHERE = f"({ISO}|{SLASHED}|{COMMON_LOG})"
MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"

_ISO_PARTS = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:[.,](\d+))?(Z|[+-]\d{2}:?\d{2})?$"
_STRICT_ISO_PARTS = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}:\d{2}:\d{2})(?:\.(\d{1,6}))?(Z|[+-]\d{2}:?\d{2})?$"


def _ntz(text: Column) -> Column:
    return text.try_cast("timestamp_ntz")


def _offset(text: Column) -> Column:
    """Seconds of a Z or ±hh:mm or ±hhmm suffix; null without one."""
    digits = F.regexp_replace(text, ":", "")
    sign = F.when(F.substring(digits, 1, 1) == "-", -1).otherwise(1)
    seconds = sign * (F.substring(digits, 2, 2).try_cast("int") * 3600 + F.substring(digits, 4, 2).try_cast("int") * 60)
    return F.when(text == "Z", F.lit(0)).when(text == "", F.lit(None).cast("int")).otherwise(seconds)


def _month_number(name: Column) -> Column:
    at = F.instr(F.lit(MONTHS), name)
    return F.when((at > 0) & (F.pmod(at, F.lit(3)) == 1), F.lpad(F.floor((at + 2) / 3).cast("string"), 2, "0"))


FORMS = ("iso", "slashed", "common", "syslog")


def parse_timestamp(text: Column, strict: bool = False, forms: Collection[str] = FORMS) -> Column:
    """STRUCT<ts TIMESTAMP_NTZ, tz_offset_s INT> of a time stamp in any known layout, null fields if it is none.

    Layouts without a year get 1900, two-digit years pivot at 69. Fractions are cut to microseconds, and may follow a
    comma; ``strict`` takes ISO layouts only, with at most six digits after a point; ``forms`` are those that can occur.
    """
    pattern = _STRICT_ISO_PARTS if strict else _ISO_PARTS
    part = lambda i: F.regexp_extract(text, pattern, i)
    fraction = F.when(part(3) != "", F.concat(F.lit("."), F.substring(part(3), 1, 6))).otherwise("")
    iso = text.rlike(pattern)
    ts = F.when(iso, _ntz(F.concat(part(1), F.lit(" "), part(2), fraction)))
    offset = F.when(iso, _offset(part(4)))
    if strict:
        forms = ("iso",)
    if "slashed" in forms:
        slash = r"^(\d{2})/(\d{2})/(\d{2}) (\d{2}:\d{2}:\d{2})$"
        s = lambda i: F.regexp_extract(text, slash, i)
        century = F.when(s(1).try_cast("int") >= 69, "19").otherwise("20")
        ts = ts.when(text.rlike(slash), _ntz(F.concat(century, s(1), F.lit("-"), s(2), F.lit("-"), s(3), F.lit(" "), s(4))))
    if "common" in forms:
        common = r"^(\d{2})/([A-Z][a-z]{2})/(\d{4}):(\d{2}:\d{2}:\d{2})(?:\s([+-]\d{4}))?$"
        c = lambda i: F.regexp_extract(text, common, i)
        ts = ts.when(text.rlike(common), _ntz(F.concat(c(3), F.lit("-"), _month_number(c(2)), F.lit("-"), c(1), F.lit(" "), c(4))))
        offset = offset.when(text.rlike(common), _offset(c(5)))
    if "syslog" in forms:
        syslog = r"^([A-Z][a-z]{2})\s+(\d{1,2})\s+(\d{2}:\d{2}:\d{2})$"
        y = lambda i: F.regexp_extract(text, syslog, i)
        ts = ts.when(text.rlike(syslog), _ntz(F.concat(F.lit("1900-"), _month_number(y(1)), F.lit("-"), F.lpad(y(2), 2, "0"), F.lit(" "), y(3))))
    return F.struct(ts.alias("ts"), F.when(ts.isNotNull(), offset).alias("tz_offset_s"))


def to_utc(ts: Column, offset: Column) -> Column:
    """Wall clock in UTC; a time stamp without offset counts as UTC."""
    return ts - F.make_interval(secs=F.coalesce(offset, F.lit(0)))


def time_bucket(ts: Column, seconds: Column) -> Column:
    """Start of the bucket of so many seconds, aligned to the epoch."""
    epoch = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.date_trunc("SECOND", ts).cast("timestamp_ntz"))
    floored = F.floor(epoch / seconds) * seconds
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_interval(secs=floored)
