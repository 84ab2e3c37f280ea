"""The 17 hand-made features of a line."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
LEVEL = r"ERROR|FATAL|CRITICAL|WARN|EXCEPTION|FAIL"
STACK = r'Traceback|^\s+at\s|Caused by:|^\s+File\s"'
NEGATIVE = (
    r"\b(?:unable|cannot|couldn't|can't|not found|no such|denied|refused"
    r"|rejected|timeout|timed out|unreachable|unavailable|unknown|invalid"
    r"|illegal|unexpected|unsupported|mismatch|overflow|underflow"
    r"|corrupt|missing|lost|kill|abort|panic|segfault|oom|no answer"
    r"|not responding|sleeping for)\b"
)
PATH = r"/[\w./-]{3,}"
HEX = r"\b(?:0x[0-9a-fA-F]+|[0-9a-f]{8,})\b"
REPEATED = r"(.)\1{2,}"
KEY_VALUE = r"\b\w+=\S+"

NAMES = (
    "length", "uppercase_ratio", "has_level", "digit_ratio", "has_stack", "struct_punct", "has_negative", "n_negative", "word_count",
    "n_allcaps", "leading_ws", "has_path", "n_hex", "has_repeated_punct", "n_kv", "unique_ratio", "n_emphasis",
)


def alternatives(pattern: str) -> list[str]:
    """The lower-cased literals of a pattern that is an alternation of them."""
    return re.sub(r"\\b|\(\?:|\)", "", pattern).lower().split("|")


def line_features(raw: Column) -> list[Column]:
    """DOUBLE columns named as in ``NAMES``."""
    length = F.char_length(raw)
    denominator = F.greatest(length, F.lit(1))
    count = lambda p: F.regexp_count(raw, F.lit(p))
    has = lambda p: raw.rlike(p).cast("int")
    folded = F.lower(raw)
    # Plain substring search rules most lines out before a pattern of many alternatives is tried.
    holds = lambda pattern: reduce(Column.__or__, [F.contains(folded, F.lit(x)) for x in alternatives(pattern)])
    negative = F.when(holds(NEGATIVE), F.regexp_count(folded, F.lit("(?U)" + NEGATIVE))).otherwise(0)
    split = lambda c: F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")
    words = split(raw)
    n_words = F.size(words)
    columns = [
        length, count(r"\p{Lu}") / denominator, holds(LEVEL).cast("int"), count(r"\p{Nd}") / denominator, folded.rlike("(?U)" + STACK.lower()).cast("int"),
        count(r"[:;=()\[\]{}]") / denominator, (negative > 0).cast("int"), negative, n_words,
        F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}{3,}$"))), F.char_length(F.regexp_extract(raw, r"(?U)^\s*", 0)),
        has("(?U)" + PATH), count("(?U)" + HEX), has("(?d)" + REPEATED), count("(?U)" + KEY_VALUE),
        F.size(F.array_distinct(split(folded))) / F.greatest(n_words, F.lit(1)), count("[!?]"),
    ]
    return [c.cast("double").alias(n) for c, n in zip(columns, NAMES, strict=True)]
