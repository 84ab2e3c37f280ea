"""Layout detection from the first lines of each file."""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import levels
from ..functions import timestamps as T
from ..session import ship

SAMPLE = 20
#: Text layouts in the order in which they are tried; groups: ts, level (where there is one), message.
LAYOUTS = (
    rf"^(?<ts>{T.ISO})\s+(?<level>[A-Z]+)\s+(?<message>.*)$",
    rf"^\[(?<ts>{T.ISO})\]\s+\[?(?<level>[A-Z]+)\]?\s+(?<message>.*)$",
    rf"^(?<level>[A-Z]+)\s+(?<ts>{T.ISO})\s+(?<message>.*)$",
    rf"^(?<ts>{T.SYSLOG})\s+\S+\s+\S+:\s+(?<message>.*)$",
    rf"^(?<ts>{T.ISO})\s+(?<message>.*)$",
)
DELIMITERS = ("\t", "|")
SCHEMA = "file_path string, fmt string, delimiter string, ts_column int, level_after_ts boolean, first_layout int"
#: Rows of a table with a row for each file that go to the driver, and from there to every task; larger ones are joined.
FILES = 50_000


# The layouts and delimiters above are fixed values.


def python_layout(i: int) -> str:
    return LAYOUTS[i].replace("(?<", "(?P<")


def is_object(line: str) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def has_level(text: str) -> bool:
    word = text.split(None, 1)[:1]
    return bool(word) and word[0].strip("[]").upper() in levels.KNOWN


def _adaptive(lines: Sequence[str]) -> tuple[str, str | None, int, bool] | None:
    """('delim' or 'offset', delimiter, column, level flag) if half of the lines have a time stamp in one place."""
    anywhere = re.compile(T.ANYWHERE)
    for delimiter in DELIMITERS:
        columns: Counter[int] = Counter()
        for line in lines:
            parts = line.lstrip("﻿").split(delimiter)
            at = next((i for i, p in enumerate(parts) if anywhere.search(p)), None) if len(parts) > 1 else None
            if at is not None:
                columns[at] += 1
        if columns:
            column, n = columns.most_common(1)[0]
            if 2 * n >= len(lines):
                rests = []
                for line in lines:
                    parts = line.split(delimiter)
                    hit = anywhere.search(parts[column]) if column < len(parts) else None
                    if hit:
                        rests.append((parts[column][hit.end() :].strip() + " " + delimiter.join(parts[column + 1 :])).strip())
                return "delim", delimiter, column, _flag(rests)
    hits = [(m, line) for line in lines if (m := anywhere.search(line))]
    if hits:
        offset, n = Counter(m.start() for m, _ in hits).most_common(1)[0]
        if 2 * n >= len(lines):
            return "offset", None, offset, _flag([line[m.end() :].strip() for m, line in hits])
    return None


def _flag(rests: Sequence[str]) -> bool:
    return bool(rests) and 10 * sum(map(has_level, rests)) >= 3 * len(rests)


def detect_sample(lines: Sequence[str]) -> tuple[str, str | None, int | None, bool]:
    """Layout of a file out of its first lines: json, text, delim or offset; text if nothing fits."""
    full = [x for x in lines if x.strip()]
    if full:
        if 2 * sum(map(is_object, full)) >= len(full):
            return "json", None, None, False
        locked = next((i for x in full for i in range(len(LAYOUTS)) if re.match(python_layout(i), x)), None)
        if locked is not None and 2 * sum(bool(re.match(python_layout(locked), x)) for x in full) >= len(full):
            return "text", None, None, False
        if (found := _adaptive(full)) is not None:
            return found
    return "text", None, None, False


def first_layout(lines: Sequence[str]) -> int | None:
    """The first layout that the first line with any matches."""
    return next((i for x in lines for i in range(len(LAYOUTS)) if re.match(python_layout(i), x)), None)


def detect_formats(lines: DataFrame) -> DataFrame:
    """One row per file, see ``SCHEMA``; only the first lines of a file leave the scan."""
    ship(lines.sparkSession)

    def detect(pdf: pd.DataFrame) -> pd.DataFrame:
        sample = pdf.sort_values("line_number")["raw"].tolist()
        fmt, delimiter, column, flag = detect_sample(sample)
        row = pd.DataFrame([[pdf["file_path"].iloc[0], fmt, delimiter, column, flag, first_layout(sample)]], columns=["file_path", "fmt", "delimiter", "ts_column", "level_after_ts", "first_layout"])
        return row.astype({"ts_column": "Int32", "first_layout": "Int32"})

    return lines.where(F.col("line_number") <= SAMPLE).groupBy("file_path").applyInPandas(detect, SCHEMA)


def held(table: DataFrame) -> tuple[DataFrame, list | None]:
    """A table with a row for each file, computed once and made a broadcast side if it has at most ``FILES`` rows, and those rows."""
    rows = table.limit(FILES + 1).collect()
    if len(rows) > FILES:
        return table, None
    return F.broadcast(table.sparkSession.createDataFrame(rows, table.schema)), rows
