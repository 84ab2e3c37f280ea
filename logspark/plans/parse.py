"""Lines to entries: one projection per layout, then continuation lines fold into the entry before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import levels
from ..functions import timestamps as T
from ..functions.normalize import strip
from .formats import LAYOUTS, detect_formats, held

# Keys of JSON lines, in the order in which they are looked for.
TS_KEYS = ("timestamp", "time", "ts", "@timestamp", "datetime", "date")
LEVEL_KEYS = ("level", "severity", "log_level", "loglevel", "lvl")
MESSAGE_KEYS = ("message", "msg", "text", "log")
#: Lines of a file whose running counts one task adds up at a time.
CHUNK = 100_000


def entry(stamp: Column, level: Column, message: Column, prefix: Column | None = None, extra: Column | None = None, epoch: Column | None = None) -> Column:
    """What a line says, its time stamp still as text: that is parsed once, whatever the layout, when entries have merged."""
    none = F.lit(None).cast("string")
    return F.struct(
        stamp.alias("stamp"), (F.lit(None).cast("timestamp_ntz") if epoch is None else epoch).alias("epoch"), level.alias("level"), message.alias("message"),
        (none if prefix is None else prefix).alias("prefix"), (F.lit(None).cast("map<string,string>") if extra is None else extra).alias("extra"),
    )


def nothing() -> Column:
    """No entry, with the type of one."""
    none = F.lit(None).cast("string")
    return F.when(F.lit(False), entry(none, none, none))


def text_entry(raw: Column, i: int) -> Column:
    """Entry of a line in layout ``i``; null if the line has another. A word in level position that is no level is lost."""
    pattern = "(?dU)" + LAYOUTS[i]
    names = [n for _, n in sorted((LAYOUTS[i].index(f"(?<{n}>"), n) for n in ("ts", "level", "message") if f"(?<{n}>" in LAYOUTS[i])]
    part = {n: F.regexp_extract(raw, pattern, k) for k, n in enumerate(names, 1)}
    level = F.when(part["level"].isin(*levels.KNOWN), part["level"]) if "level" in part else F.lit(None).cast("string")
    return F.when(raw.rlike(pattern), entry(part["ts"], level, part["message"]))


def _get(fields: Column, keys: tuple[str, ...]) -> Column:
    exact = [F.try_element_at(fields, F.lit(k)) for k in keys]
    entries = F.map_entries(fields)

    def folded(key: str) -> Column:
        return F.get(F.filter(entries, lambda e: F.lower(e["key"]) == key), F.lit(0))["value"]

    return F.coalesce(*exact, *map(folded, keys))


def json_fields(raw: Column) -> Column:
    return F.when(strip(raw).startswith("{"), F.from_json(strip(raw), "map<string,variant>"))


def json_entry(fields: Column) -> Column:
    """Entry of a JSON object on a line; null for anything else. Numbers as time stamps are epoch seconds, or milliseconds above 1e12."""
    as_text = lambda v: F.try_variant_get(v, "$", "string")
    stamp, level = _get(fields, TS_KEYS), as_text(_get(fields, LEVEL_KEYS))
    number = F.when(~F.schema_of_variant(stamp).isin("STRING", "BOOLEAN", "VOID"), F.try_variant_get(stamp, "$", "double"))
    seconds = F.when(number > 1e12, number / 1000).otherwise(number)
    epoch = F.timestamp_micros((seconds * 1_000_000).cast("bigint")).cast("timestamp_ntz")
    known = [*TS_KEYS, *LEVEL_KEYS, *MESSAGE_KEYS]
    rest = F.transform_values(F.map_filter(fields, lambda k, v: ~F.lower(k).isin(*known)), lambda k, v: as_text(v))
    message = F.coalesce(as_text(_get(fields, MESSAGE_KEYS)), F.lit(""))
    return F.when(fields.isNotNull(), entry(as_text(stamp), F.upper(level), message, extra=F.when(F.size(rest) > 0, rest), epoch=epoch))


def _after(rest: Column, flag: Column) -> tuple[Column, Column]:
    """(level, message) of what follows a time stamp."""
    word = F.upper(F.regexp_replace(F.regexp_extract(rest, r"(?U)^(\S+)", 1), r"^[\[\]]+|[\[\]]+$", ""))
    has = flag & word.isin(*levels.KNOWN)
    return F.when(has, levels.canonical_level(word)), F.when(has, F.regexp_replace(rest, r"(?sU)^\S+\s*", "")).otherwise(rest)


def delimited_columns(typed: DataFrame) -> DataFrame:
    """With _parts, _cell, _stamp and _rest: each is named in several places, and a plan would else repeat all of it there."""
    delimiter, column = F.col("delimiter"), F.col("ts_column")
    typed = typed.withColumn("_parts", F.split("raw", F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")), -1))
    typed = typed.withColumn("_cell", F.regexp_replace(strip(F.get("_parts", column)), "^\ufeff", ""))
    typed = typed.withColumn("_stamp", F.regexp_extract("_cell", T.ANYWHERE, 1))
    tail = strip(F.substr("_cell", F.instr("_cell", F.col("_stamp")) + F.char_length("_stamp"), F.char_length("_cell")))
    others = strip(F.call_function("array_join", F.slice("_parts", column + 2, F.greatest(F.size("_parts") - column - 1, F.lit(0))), delimiter))
    typed = typed.withColumn("_tail", tail).withColumn("_others", others)
    return typed.withColumn("_rest", strip(F.concat_ws(" ", F.when(F.col("_tail") != "", F.col("_tail")), F.when(F.col("_others") != "", F.col("_others")))))


def delimited_entry() -> Column:
    """Of the columns of :func:`delimited_columns`."""
    column = F.col("ts_column")
    level, message = _after(F.col("_rest"), F.col("level_after_ts"))
    prefix = F.when(column > 0, F.call_function("array_join", F.slice("_parts", F.lit(1), F.greatest(column, F.lit(0))), F.col("delimiter")))
    return F.when(F.col("_stamp") != "", entry(F.col("_stamp"), level, message, prefix))


def offset_columns(typed: DataFrame) -> DataFrame:
    """With _found, _at and _behind, see :func:`delimited_columns`."""
    typed = typed.withColumn("_found", F.regexp_extract("raw", T.ANYWHERE, 1)).withColumn("_at", F.instr("raw", F.col("_found")))
    return typed.withColumn("_behind", strip(F.substr("raw", F.col("_at") + F.char_length("_found"), F.char_length("raw"))))


def offset_entry() -> Column:
    """Of the columns of :func:`offset_columns`."""
    level, message = _after(F.col("_behind"), F.col("level_after_ts"))
    before = strip(F.substr("raw", F.lit(1), F.col("_at") - 1))
    return F.when(F.col("_found") != "", entry(F.col("_found"), level, message, F.when(before != "", before)))


def layout_of(raw: Column) -> Column:
    """The first layout that a line matches; null if none does."""
    out = F.lit(None).cast("int")
    for i in reversed(range(len(LAYOUTS))):
        out = F.when(raw.rlike("(?dU)" + LAYOUTS[i]), F.lit(i)).otherwise(out)
    return out


def parse_lines(lines: DataFrame, formats: DataFrame, whole: bool = True) -> DataFrame:
    """``lines`` with ``e``, the entry that begins there or null; a text file keeps to the layout of its first match.

    That match is among the sampled lines as a rule (``whole``: if they belong to the range); only files without one
    there are searched for it.
    """
    formats, known = held(formats)
    kinds = None if known is None else {(r["fmt"], r["first_layout"] if r["fmt"] == "text" and whole else None) for r in known}
    typed = lines.join(formats, "file_path").withColumn("layout", F.col("first_layout") if whole else F.lit(None).cast("int"))
    if kinds is None or ("text", None) in kinds:
        unlocked = typed.where((F.col("fmt") == "text") & F.col("layout").isNull()).withColumn("layout", layout_of(F.col("raw")))
        locks, found = held(unlocked.where("layout is not null").groupBy("file_path").agg(F.min_by("layout", "line_number").alias("_lock")))
        typed = typed.join(locks, "file_path", "left").withColumn("layout", F.coalesce("layout", "_lock"))
        kinds = None if kinds is None or found is None else kinds | {("text", r["_lock"]) for r in found}
    # Only what can occur is in the plan: a branch for every layout would cost more to plan than many logs to parse.
    occurs = lambda fmt, layout=None: kinds is None or (fmt, layout) in kinds
    raw = F.col("raw")
    e = F.when(strip(raw) == "", nothing())
    if occurs("json"):
        typed = typed.withColumn("_fields", F.when(F.col("fmt") == "json", json_fields(raw)))
        e = e.when(F.col("fmt") == "json", json_entry(F.col("_fields")))
    for i in range(len(LAYOUTS)):
        if occurs("text", i):
            e = e.when((F.col("fmt") == "text") & (F.col("layout") == i), text_entry(raw, i))
    if occurs("delim"):
        typed = delimited_columns(typed)
        e = e.when(F.col("fmt") == "delim", delimited_entry())
    if occurs("offset"):
        typed = offset_columns(typed)
        e = e.when(F.col("fmt") == "offset", offset_entry())
    parsed = typed.select("file_path", "line_number", "raw", "fmt", e.alias("e"))
    parsed._logspark_kinds = kinds
    return parsed


def island_numbers(lines: DataFrame, starts: Column) -> DataFrame:
    """``lines`` with ``entry_id``: how many entries begin up to there. Counted per chunk, then over the chunks' sums."""
    marked = lines.withColumn("_start", starts.cast("int")).withColumn("_chunk", F.floor(F.col("line_number") / CHUNK))
    sums = marked.groupBy("file_path", "_chunk").agg(F.sum("_start").alias("n"))
    before = F.sum("n").over(W.partitionBy("file_path").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1))
    sums = sums.select("file_path", "_chunk", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_start").over(W.partitionBy("file_path", "_chunk").orderBy("line_number"))
    return marked.withColumn("_within", within).join(sums, ["file_path", "_chunk"]).withColumn("entry_id", F.col("_before") + F.col("_within")).drop("_before", "_within", "_chunk", "_start")


def stamp_of(kinds: set | None) -> Column:
    """The time stamp of an entry of those (format, layout) kinds, or of any."""
    strict = T.parse_timestamp(F.col("e.stamp"), strict=True)
    others = None if kinds is None else {k for k in kinds if k[0] != "json"}
    if others is not None and not others:
        return strict
    forms = T.FORMS
    if others is not None and all(fmt == "text" for fmt, _ in others):
        forms = [f for f in T.FORMS if f == ("syslog" if others <= {("text", 3), ("text", None)} else "iso") or (f == "syslog" and ("text", 3) in others)]
    loose = T.parse_timestamp(F.col("e.stamp"), forms=forms)
    return loose if kinds is not None and others == kinds else F.when(F.col("fmt") == "json", strict).otherwise(loose)


def merge_entries(parsed: DataFrame) -> DataFrame:
    """Entries out of :func:`parse_lines`; lines before a file's first entry are dropped."""
    numbered = island_numbers(parsed, F.col("e").isNotNull()).where("entry_id > 0")
    grouped = numbered.groupBy("file_path", "entry_id").agg(
        F.min("line_number").alias("line_number"), F.max("line_number").alias("end_line"), F.first("fmt").alias("fmt"),
        F.array_sort(F.collect_list(F.struct("line_number", "raw"))).alias("all"),
        F.first("e", ignorenulls=True).alias("e"),
    )
    first = F.get("all", F.lit(0))["raw"]
    rest = F.transform(F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0))), lambda x: x["raw"])
    tail = F.when(F.size(rest) > 0, F.concat(F.lit("\n"), F.array_join(rest, "\n"))).otherwise("")
    raw = F.when(F.col("fmt") == "json", strip(first)).otherwise(first)
    stamped = grouped.select("*", stamp_of(getattr(parsed, "_logspark_kinds", None)).alias("t"), F.concat(raw, tail).alias("raw"), F.concat(F.col("e.message"), tail).alias("message"))
    ts, offset = F.coalesce("e.epoch", "t.ts"), F.when(F.col("e.epoch").isNull(), F.col("t.tz_offset_s"))
    return stamped.select(
        "file_path", "line_number", "end_line", "raw", ts.alias("ts"), offset.alias("tz_offset_s"), T.to_utc(ts, offset).alias("ts_utc"),
        F.col("e.level").alias("level"), "message", F.col("e.prefix").alias("prefix"), F.col("e.extra").alias("extra"), "fmt",
    )


def to_entries(lines: DataFrame, formats: DataFrame | None = None, start_line: int | None = None, end_line: int | None = None) -> DataFrame:
    """Entries of ``lines``; a line range cuts physical lines before they merge."""
    formats = detect_formats(lines) if formats is None else formats
    if start_line:
        lines = lines.where(F.col("line_number") >= start_line)
    if end_line is not None:
        lines = lines.where(F.col("line_number") <= end_line)
    return merge_entries(parse_lines(lines, formats, not start_line or start_line == 1))
