"""The registered queries of the log engine and their DuckDB equivalents, over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import operators as O
from .functions import features, normalize, normalize_extended
from .functions.levels import light_level
from .functions.predicates import CONTENT_ERROR, ERROR_WORDS, WARN_WORDS, WIDE_ERROR_WORDS, matches
from .model import LineModel, confusion, keyword_capture, label_windows, new_datasets, remap_labels, sample_evenly, score_lines, split_bgl, validate_labels, with_previous
from .model.counting import char_document_frequencies, word_counts, word_document_frequencies
from .model.labeling import WINDOW
from .operators.errors import error_candidates
from .operators.search import scanned
from .plans import detect_formats, to_entries
from .plans.parse import entry, merge_entries
from .sources import adapters as A
from .sources.files import read_csv_truth, read_jsonl, read_lines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
LABELS = ("A", "B", "C")
#: Lines of a written log's parts, and of each of the logs that labels are about (whole windows): a label moved by as many lies beyond its log.
LOG_LINES = 1_000_000
#: DuckDB's word boundaries know ASCII letters only: an underscore on both sides makes other characters part of a word.
MARKED = "regexp_replace({}, '([^\\x00-\\x7F])', '_\\1_', 'g')"
WORD_SQL = r"[\p{L}\p{M}\p{N}_]"

# --- Relations in SQL -------------------------------------------------------------------------------------------
EVENTS = """e AS (
  SELECT CASE user_id % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS file_path, event_id + 1 AS line_number, ts,
    CASE WHEN event_type = 'error' THEN 'ERROR' WHEN event_type IN ('purchase', 'signup') THEN 'INFO' ELSE 'DEBUG' END AS level,
    CASE event_id % 7 WHEN 0 THEN 'auth' WHEN 1 THEN 'billing' WHEN 2 THEN 'cache' WHEN 3 THEN 'gateway' WHEN 4 THEN 'ingest' WHEN 5 THEN 'search' ELSE 'worker' END
      || ' user=' || user_id || ' type=' || event_type || ' props=' || props AS message
  FROM events)"""
LINES = """s AS (SELECT doc_id, source, string_split(text, chr(10)) AS parts FROM documents),
u AS (SELECT doc_id, source, unnest(parts) AS raw, unnest(range(1, len(parts) + 1)) AS line_number FROM s),
l AS (SELECT CAST(doc_id AS VARCHAR) AS file_path, source, line_number, raw FROM u)"""
#: The identifier rule without look-ahead: a digit among the leading letters' successors, spelled out.
ID_SQL = r"\b[a-z]+_(?:\d[a-z0-9]{3,}|[a-z]\d[a-z0-9]{2,}|[a-z]{2}\d[a-z0-9]+|[a-z]{3,}\d[a-z0-9]*)\b"


def norm_sql(c: str, extended: bool = False) -> str:
    rules = [(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "<UUID>", "gi"), (r"\b[0-9a-f]{12,}\b", "<HEX>", "gi"), ("0x[0-9a-fA-F]+", "<HEX>", "g")]
    if extended:
        rules.append((r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", "<IP>", "g"))
    rules += [(ID_SQL, "<ID>", "gi"), (r"\b\d+", "<N>", "g")]
    if extended:
        rules += [('"[^"]*"', '"<STR>"', "g"), ("''[^'']*''", "''<STR>''", "g")]
    c = MARKED.format(c)
    for pattern, to, flags in [*rules, (r"\s+", " ", "g"), (r"_([^\x00-\x7F])_", r"\1", "g")]:
        c = f"regexp_replace({c}, '{pattern}', '{to}', '{flags}')"
    return f"trim({c})"


def register(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _bigints(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("bigint") for c in columns})


# --- Overview ---------------------------------------------------------------------------------------------------
@register("overview_summary", f"WITH {EVENTS} SELECT count(*) AS lines, arg_min(ts, line_number) AS first_ts, arg_max(ts, line_number) AS last_ts FROM e")
def overview_summary(spark, sf):
    e = A.events_entries(spark, sf)
    return O.overview_summary(e, e)


@register("overview_levels", f"WITH {EVENTS} SELECT level, count(*) AS count, min(line_number) AS first_line FROM e GROUP BY level")
def overview_levels(spark, sf):
    return O.overview_levels(A.events_entries(spark, sf))


@register("overview_head_tail", f"WITH {EVENTS}, t AS (SELECT max(line_number) AS n FROM e) SELECT 'head' AS part, line_number, message AS raw FROM e WHERE line_number <= 10 UNION ALL SELECT 'tail', line_number, message FROM e, t WHERE line_number > n - 10")
def overview_head_tail(spark, sf):
    return O.overview_ends(A.events_entries(spark, sf), 10)


@register("source_line_count", f"WITH {LINES} SELECT file_path, count(*) AS lines FROM l GROUP BY file_path")
def source_line_count(spark, sf):
    from .sources import count_lines

    return count_lines(A.doc_lines(spark, sf))


# --- Search -----------------------------------------------------------------------------------------------------
_SHOW = "line_number, ts, level, message"


@register("search_regex", f"WITH {EVENTS} SELECT {_SHOW} FROM e WHERE regexp_matches(message, '(?i)CACHE user=1\\d* type=(click|view)') ORDER BY line_number LIMIT 50")
def search_regex(spark, sf):
    return O.search_entries(A.events_entries(spark, sf), r"CACHE user=1\d* type=(?P<kind>click|view)").selectExpr(*_SHOW.split(", "))


@register("search_level", f"WITH {EVENTS} SELECT {_SHOW} FROM e WHERE level = 'ERROR' ORDER BY line_number LIMIT 50")
def search_level(spark, sf):
    return O.search_entries(A.events_entries(spark, sf), log_level="error").selectExpr(*_SHOW.split(", "))


@register("search_time", f"WITH {EVENTS} SELECT {_SHOW} FROM e WHERE ts BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-06 12:00:00' ORDER BY line_number LIMIT 1000")
def search_time(spark, sf):
    return O.search_entries(A.events_entries(spark, sf), start_time="2024-01-05", end_time="2024-01-06 12:00:00", max_results=1000).selectExpr(*_SHOW.split(", "))


@register("search_combined_limit", f"WITH {EVENTS} SELECT {_SHOW} FROM e WHERE level = 'ERROR' AND ts >= TIMESTAMP '2024-01-10 00:00:00' AND regexp_matches(message, '(?i)gateway') ORDER BY line_number LIMIT 7")
def search_combined_limit(spark, sf):
    return O.search_entries(A.events_entries(spark, sf), "gateway", "ERROR", "2024-01-10T00:00:00", None, 7).selectExpr(*_SHOW.split(", "))


@register("search_scanned", f"WITH {EVENTS}, m AS (SELECT line_number FROM e WHERE level = 'ERROR' ORDER BY line_number LIMIT 50), h AS (SELECT count(*) AS matches, max(line_number) AS last FROM m) SELECT matches, matches >= 50 AS truncated, (SELECT count(*) FROM e, h WHERE matches < 50 OR line_number <= last) AS scanned FROM h")
def search_scanned(spark, sf):
    e = A.events_entries(spark, sf)
    return scanned(e, O.search_entries(e, log_level="ERROR"), 50)


@register("search_doc_lines", f"WITH {LINES} SELECT file_path, line_number, raw FROM l WHERE regexp_matches(raw, '(?i)licen[sc]e')")
def search_doc_lines(spark, sf):
    return A.doc_lines(spark, sf).where(matches(F.col("raw"), "licen[sc]e"))


# --- Segment ----------------------------------------------------------------------------------------------------
@register("segment_lines", f"WITH {EVENTS} SELECT {_SHOW} FROM e WHERE line_number BETWEEN 100 AND 320 ORDER BY line_number LIMIT 200")
def segment_lines(spark, sf):
    e = A.events_entries(spark, sf).where("line_number between 100 and 320")
    return O.segment_entries(e).selectExpr(*_SHOW.split(", "))


@register("segment_time", f"WITH {EVENTS}, p AS (SELECT min(line_number) AS stop FROM e WHERE ts > TIMESTAMP '2024-01-20 00:00:00') SELECT {_SHOW} FROM e, p WHERE (stop IS NULL OR line_number < stop) AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' ORDER BY line_number LIMIT 200")
def segment_time(spark, sf):
    return O.segment_entries(A.events_entries(spark, sf), "2024-01-02", "2024-01-20").selectExpr(*_SHOW.split(", "))


# --- Normalisers ------------------------------------------------------------------------------------------------
def _normalised(lines: DataFrame, f) -> DataFrame:
    return lines.select("file_path", "line_number", f(F.col("raw")).alias("pattern"))


PAGES = "s AS (SELECT page_id, string_split(html, chr(10)) AS parts FROM pages), l AS (SELECT CAST(page_id AS VARCHAR) AS file_path, unnest(range(1, len(parts) + 1)) AS line_number, unnest(parts) AS raw FROM s)"
for _name, _rel, _lines in (("docs", LINES, A.doc_lines), ("pages", PAGES, A.page_lines)):
    for _kind, _f in (("base", normalize), ("ext", normalize_extended)):
        register(f"normalize_{_kind}_{_name}", f"WITH {_rel} SELECT file_path, line_number, {norm_sql('raw', _kind == 'ext')} AS pattern FROM l")(lambda spark, sf, f=_f, lines=_lines: _normalised(lines(spark, sf), f))


# --- Errors -----------------------------------------------------------------------------------------------------
_GROUPS = "fingerprint, count(*) AS count, min(line_number) AS first_line, arg_min(ts, line_number) AS first_ts, max(line_number) AS last_line, arg_max(ts, line_number) AS last_ts"


def _groups(spark, sf, cap):
    return O.error_groups(error_candidates(A.events_entries(spark, sf)), cap).drop("stack_trace")


@register("errors_level_groups", f"WITH {EVENTS} SELECT {_GROUPS} FROM (SELECT *, {norm_sql('message')} AS fingerprint FROM e WHERE level = 'ERROR') GROUP BY fingerprint")
def errors_level_groups(spark, sf):
    return _groups(spark, sf, None)


@register("errors_first_n_cap", f"WITH {EVENTS} SELECT {_GROUPS} FROM (SELECT *, {norm_sql('message')} AS fingerprint FROM e WHERE level = 'ERROR') GROUP BY fingerprint ORDER BY first_line LIMIT 3")
def errors_first_n_cap(spark, sf):
    return _groups(spark, sf, 3)


@register("errors_summary", f"WITH {EVENTS} SELECT count(*) AS total_errors, false AS by_content FROM e WHERE level = 'ERROR'")
def errors_summary(spark, sf):
    return O.error_summary(error_candidates(A.events_entries(spark, sf)))


_CONTENT_SQL = "(?i)" + CONTENT_ERROR


def _content_entries(spark, sf):
    """Events without levels; errors read as failures."""
    e = A.events_entries(spark, sf)
    message = F.when(F.col("level") == "ERROR", F.concat(F.lit("step failed: "), "message")).otherwise(F.col("message"))
    return e.withColumns({"message": message, "raw": message, "level": F.lit(None).cast("string")})


@register("errors_content_groups", f"WITH {EVENTS}, c AS (SELECT line_number, ts, CASE WHEN level = 'ERROR' THEN 'step failed: ' || message ELSE message END AS message FROM e) SELECT {_GROUPS} FROM (SELECT *, {norm_sql('message')} AS fingerprint FROM c WHERE regexp_matches(message, '{_CONTENT_SQL}')) GROUP BY fingerprint")
def errors_content_groups(spark, sf):
    return O.error_groups(error_candidates(_content_entries(spark, sf)), None).drop("stack_trace")


def _doc_entries(spark, sf):
    """Lines of documents merged to entries that begin at capital letters."""
    raw = F.col("raw")
    none = F.lit(None).cast("string")
    parsed = A.doc_lines(spark, sf).withColumns({"fmt": F.lit("text"), "e": F.when(raw.rlike("^[A-M]"), entry(none, F.lit("ERROR"), raw))})
    return merge_entries(parsed)


_BLOCKS = f"{LINES}, b AS (SELECT *, sum(CASE WHEN regexp_matches(raw, '^[A-M]') THEN 1 ELSE 0 END) OVER (PARTITION BY file_path ORDER BY line_number) AS entry_id FROM l)"


@register("multiline_merge", f"WITH {_BLOCKS} SELECT file_path, min(line_number) AS line_number, max(line_number) AS end_line, string_agg(raw, chr(10) ORDER BY line_number) AS raw FROM b WHERE entry_id > 0 GROUP BY file_path, entry_id")
def multiline_merge(spark, sf):
    return _doc_entries(spark, sf).select("file_path", "line_number", "end_line", "raw")


_MERGED = f"{_BLOCKS}, m AS (SELECT min(line_number) + CAST(file_path AS BIGINT) * 1000000 AS first, string_agg(raw, chr(10) ORDER BY line_number) AS raw FROM b WHERE entry_id > 0 GROUP BY file_path, entry_id)"


@register("errors_stack_trace", f"WITH {_MERGED}, g AS (SELECT {norm_sql('raw')} AS fingerprint, count(*) AS count, min(first) AS first_line, max(first) AS last_line, string_split(arg_min(raw, first), chr(10))[2:] AS r FROM m GROUP BY 1) SELECT fingerprint, count, first_line, last_line, CASE WHEN len(r) > 10 THEN array_to_string(r[1:10], chr(10)) || chr(10) || '... (' || (len(r) - 10) || ' more lines)' WHEN len(r) > 0 THEN array_to_string(r, chr(10)) END AS stack_trace FROM g")
def errors_stack_trace(spark, sf):
    """All documents as one log, so that first entries are definite."""
    entries = _doc_entries(spark, sf).withColumn("line_number", F.col("line_number") + F.col("file_path").cast("bigint") * 1_000_000)
    return O.error_groups(error_candidates(entries), None).select("fingerprint", "count", "first_line", "last_line", "stack_trace")


# --- Statistics -------------------------------------------------------------------------------------------------
@register("stats_levels", f"WITH {EVENTS} SELECT level, count(*) AS count, min(line_number) AS first_line FROM e GROUP BY level")
def stats_levels(spark, sf):
    return O.stats_levels(A.events_entries(spark, sf))


def _hist_sql(seconds: str) -> str:
    bucket = f"make_timestamp(CAST(floor(epoch(ts) / {seconds}) * {seconds} * 1000000 AS BIGINT))"
    return f"SELECT {bucket} AS bucket_start, count(*) AS count, min(line_number) AS first_line FROM e GROUP BY 1"


for _label, _seconds in (("1h", 3600), ("6h", 21600), ("1d", 86400)):
    register(f"stats_hist_{_label}", f"WITH {EVENTS} {_hist_sql(str(_seconds))}")(lambda spark, sf, label=_label: O.stats_histogram(A.events_entries(spark, sf), label))


@register("stats_auto_bucket", f"WITH {EVENTS} {_hist_sql('43200')}".replace("43200", "86400"))
def stats_auto_bucket(spark, sf):
    return O.stats_histogram(A.events_entries(spark, sf), "auto")


@register("stats_peak", f"WITH {EVENTS}, h AS ({_hist_sql('3600')}) SELECT bucket_start, count FROM h ORDER BY count DESC, first_line LIMIT 1")
def stats_peak(spark, sf):
    return O.stats_peak(O.stats_histogram(A.events_entries(spark, sf), "1h"))


@register("stats_top_patterns", f"WITH {EVENTS} SELECT {norm_sql('message', True)} AS pattern, count(*) AS count, min(line_number) AS first_line FROM e GROUP BY 1 ORDER BY count DESC, first_line LIMIT 20")
def stats_top_patterns(spark, sf):
    return O.stats_patterns(A.events_entries(spark, sf), 20)


@register("stats_span_error_pct", f"WITH {EVENTS}, s AS (SELECT count(*) AS entries, min(ts) AS min_ts, max(ts) AS max_ts, count(*) FILTER (WHERE level = 'ERROR') AS errors FROM e) SELECT entries, min_ts, max_ts, CAST(round(epoch(max_ts) - epoch(min_ts), 3) AS DOUBLE) AS span_s, errors, CAST(round(errors * 100.0 / entries, 6) AS DOUBLE) AS error_pct FROM s")
def stats_span_error_pct(spark, sf):
    s = O.stats_span(A.events_entries(spark, sf))
    return s.select("entries", "min_ts", "max_ts", F.round("span_s", 3).alias("span_s"), "errors", F.round("error_pct", 6).alias("error_pct"))


@register("stats_distinct_patterns", f"WITH {EVENTS} SELECT count(DISTINCT {norm_sql('message')}) AS patterns FROM e")
def stats_distinct_patterns(spark, sf):
    return A.events_entries(spark, sf).agg(F.count_distinct(normalize(F.col("message"))).alias("patterns"))


# --- Comparison -------------------------------------------------------------------------------------------------
_PATTERNS = f"""{EVENTS}, f AS (SELECT *, {norm_sql('message')} AS pattern FROM e),
k AS (SELECT pattern, count(*) AS total, count(DISTINCT file_path) AS n_files, min(file_path) AS one_file, arg_min(level, line_number) AS any_level,
  count(*) FILTER (WHERE file_path = 'A') AS a, count(*) FILTER (WHERE file_path = 'B') AS b, count(*) FILTER (WHERE file_path = 'C') AS c,
  arg_min(level, line_number) FILTER (WHERE file_path = 'A') AS level_a FROM f GROUP BY pattern)"""


def _patterns(spark, sf):
    return O.compare_patterns(A.events_entries(spark, sf), LABELS)


def _uneven(spark, sf):
    """Files that differ: B without billing, and A alone with auth errors."""
    e = A.events_entries(spark, sf)
    return e.where(~((F.col("file_path") == "B") & F.col("message").startswith("billing")) & ~((F.col("file_path") != "A") & F.col("message").startswith("auth") & (F.col("level") == "ERROR")))


_UNEVEN = _PATTERNS.replace("AS pattern FROM e)", "AS pattern FROM e WHERE NOT (file_path = 'B' AND message LIKE 'billing%') AND NOT (file_path <> 'A' AND message LIKE 'auth%' AND level = 'ERROR'))")


@register("compare_unique", f"WITH {_UNEVEN} SELECT one_file AS file_label, pattern, any_level AS level, total AS count, CAST(0 AS DOUBLE) AS p_look FROM k WHERE n_files = 1")
def compare_unique(spark, sf):
    return O.compare_unique(O.compare_patterns(_uneven(spark, sf), LABELS), None)


@register("compare_shared", f"WITH {_UNEVEN} SELECT pattern, level_a AS level, a AS \"count_A\", b AS \"count_B\", c AS \"count_C\", total, CAST(0 AS DOUBLE) AS p_look FROM k WHERE n_files = 3 ORDER BY total DESC, pattern LIMIT 20")
def compare_shared(spark, sf):
    return O.compare_shared(O.compare_patterns(_uneven(spark, sf), LABELS), LABELS, 20)


@register("compare_outliers", f"WITH {_PATTERNS} SELECT pattern, level_a AS level, round_even(CAST(greatest(a, b, c) AS DOUBLE) / least(a, b, c), 1) AS ratio, least(a, b, c) AS low, greatest(a, b, c) AS high, CAST(0 AS DOUBLE) AS p_look FROM k WHERE n_files = 3 AND CAST(greatest(a, b, c) AS DOUBLE) / least(a, b, c) >= 1.1")
def compare_outliers(spark, sf):
    return O.compare_outliers(_patterns(spark, sf), LABELS, 1.1)


@register("compare_summary", f"WITH {_UNEVEN} SELECT count(*) AS patterns, count(*) FILTER (WHERE n_files = 3) AS shared, count(*) FILTER (WHERE n_files = 1 AND one_file = 'A') AS \"unique_A\", count(*) FILTER (WHERE n_files = 1 AND one_file = 'B') AS \"unique_B\", count(*) FILTER (WHERE n_files = 1 AND one_file = 'C') AS \"unique_C\" FROM k")
def compare_summary(spark, sf):
    return O.compare_summary(O.compare_patterns(_uneven(spark, sf), LABELS), LABELS)


# --- Parsing (round trips) --------------------------------------------------------------------------------------
def _parsed(lines: DataFrame) -> DataFrame:
    return to_entries(lines).select("line_number", "ts", "level", "message")


for _i in (0, 1, 2):
    register(f"parse_text_layout{_i}", f"WITH {EVENTS} SELECT line_number, ts, level, message FROM e")(lambda spark, sf, i=_i: _parsed(A.events_raw(spark, sf, i)))
register("parse_text_layout3", f"WITH {EVENTS} SELECT line_number, make_timestamp(1900, month(ts), day(ts), hour(ts), minute(ts), floor(second(ts))) AS ts, CAST(NULL AS VARCHAR) AS level, message FROM e")(lambda spark, sf: _parsed(A.events_raw(spark, sf, 3)))
register("parse_text_layout4", f"WITH {EVENTS} SELECT line_number, ts, CAST(NULL AS VARCHAR) AS level, message FROM e")(lambda spark, sf: _parsed(A.events_raw(spark, sf, 4)))
register("parse_delimited", f"WITH {EVENTS} SELECT line_number, ts, level, message, 'svc' AS prefix FROM e")(lambda spark, sf: to_entries(A.events_raw(spark, sf, "delim")).select("line_number", "ts", "level", "message", "prefix"))
register("parse_offset", f"WITH {EVENTS} SELECT line_number, date_trunc('second', ts) AS ts, level, message FROM e")(lambda spark, sf: _parsed(A.events_raw(spark, sf, "offset")))
register("parse_json", f"WITH {EVENTS} SELECT line_number, ts, level, message, file_path AS origin FROM e")(lambda spark, sf: to_entries(A.events_json(spark, sf)).select("line_number", "ts", "level", "message", F.col("extra")["origin"].alias("origin")))


@register("detect_format", "SELECT * FROM (VALUES ('0', 'text'), ('3', 'text'), ('delim', 'delim'), ('json', 'json'), ('offset', 'offset')) t(layout, fmt)")
def detect_format(spark, sf):
    every = None
    for layout in (0, 3, "delim", "offset", "json"):
        lines = (A.events_json(spark, sf) if layout == "json" else A.events_raw(spark, sf, layout)).withColumn("file_path", F.lit(str(layout)))
        every = lines if every is None else every.unionByName(lines)
    return detect_formats(every).select(F.col("file_path").alias("layout"), "fmt")


@register("light_levels", f"WITH {EVENTS} SELECT line_number, CASE WHEN line_number % 5 = 0 THEN 'WARN' ELSE level END AS level FROM e")
def light_levels(spark, sf):
    raw = F.when(F.col("line_number") % 5 == 0, F.concat(F.lit("Warning: "), "raw")).otherwise(F.col("raw"))
    return A.events_raw(spark, sf).select("line_number", light_level(raw).alias("level"))


# --- Features, n-grams, classifier ------------------------------------------------------------------------------
_NEG = features.NEGATIVE.replace("'", "''")
_COUNT = "CAST(len(regexp_extract_all({}, '{}')) AS DOUBLE)"
_W = "list_filter(regexp_split_to_array(raw, '\\s+'), lambda x: x <> '')"
_FEATURES_SQL = f"""WITH {LINES}, a AS (SELECT *, {_W} AS w, {MARKED.format('raw')} AS m, string_split(raw, '') AS c FROM l)
SELECT file_path, line_number, CAST(length(raw) AS DOUBLE) AS length, {_COUNT.format('raw', '\\p{Lu}')} / greatest(length(raw), 1) AS uppercase_ratio,
  CAST(regexp_matches(raw, '(?i){features.LEVEL}') AS DOUBLE) AS has_level, {_COUNT.format('raw', '\\p{Nd}')} / greatest(length(raw), 1) AS digit_ratio,
  CAST(regexp_matches(raw, '(?i){features.STACK}') AS DOUBLE) AS has_stack, {_COUNT.format('raw', '[:;=()\\[\\]{}]')} / greatest(length(raw), 1) AS struct_punct,
  CAST(regexp_matches(m, '(?i){_NEG}') AS DOUBLE) AS has_negative, {_COUNT.format('m', '(?i)' + _NEG)} AS n_negative, CAST(len(w) AS DOUBLE) AS word_count,
  CAST(len(list_filter(w, lambda x: regexp_matches(x, '^\\p{{Lu}}{{3,}}$'))) AS DOUBLE) AS n_allcaps, CAST(length(regexp_extract(raw, '^\\s*')) AS DOUBLE) AS leading_ws,
  CAST(regexp_matches(raw, '/[\\p{{L}}\\p{{M}}\\p{{N}}_./-]{{3,}}') AS DOUBLE) AS has_path, {_COUNT.format('m', features.HEX)} AS n_hex,
  CAST(len(list_filter(range(1, len(c) - 1), lambda i: c[i] = c[i + 1] AND c[i] = c[i + 2])) > 0 AS DOUBLE) AS has_repeated_punct, {_COUNT.format('m', features.KEY_VALUE)} AS n_kv,
  CAST(len(list_distinct(list_transform(w, lambda x: lower(x)))) AS DOUBLE) / greatest(len(w), 1) AS unique_ratio, {_COUNT.format('raw', '[!?]')} AS n_emphasis FROM a"""


@register("features_17", _FEATURES_SQL)
def features_17(spark, sf):
    return A.doc_lines(spark, sf).select("file_path", "line_number", *features.line_features(F.col("raw")))


_WORDS = f"w AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD_SQL}{{2,}}') AS w FROM documents)"


@register("word_ngrams_df", f"WITH {_WORDS}, g AS (SELECT doc_id, unnest(w) AS gram FROM w UNION SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w UNION SELECT doc_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w) SELECT gram, count(*) AS df FROM g GROUP BY gram HAVING count(*) >= 10")
def word_ngrams_df(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return word_document_frequencies(docs, F.col("text"), 10)


_CHARWB = " UNION ".join(f"SELECT file_path, line_number, unnest(list_transform(range(1, length(p) - {n - 2}), lambda i: substr(p, i, {n}))) AS gram FROM a" for n in (3, 4, 5, 6))


@register("charwb_ngrams_df", f"WITH {LINES}, a AS (SELECT DISTINCT file_path, line_number, ' ' || x || ' ' AS p FROM (SELECT file_path, line_number, unnest({_W.replace('raw', 'lower(raw)')}) AS x FROM l)), g AS ({_CHARWB}) SELECT gram, count(*) AS df FROM g GROUP BY gram")
def charwb_ngrams_df(spark, sf):
    return char_document_frequencies(A.doc_lines(spark, sf), F.col("raw"))


@register("tfidf_weights", f"WITH {_WORDS}, u AS (SELECT doc_id, unnest(w) AS gram FROM w), c AS (SELECT doc_id, gram, count(*) AS n FROM u GROUP BY ALL), f AS (SELECT gram, count(*) AS df FROM c GROUP BY gram), t AS (SELECT count(*) AS n_docs FROM documents) SELECT doc_id, gram, round((1 + ln(n)) * (ln((1.0 + n_docs) / (1 + df)) + 1), 6) AS weight FROM c JOIN f USING (gram), t WHERE df >= 20")
def tfidf_weights(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counted, df = word_counts(docs, "doc_id", F.col("text"), 20)
    total = docs.agg(F.count("*").alias("t"))
    joined = counted.join(df, "gram").join(F.broadcast(total))  # a single row
    weight = (1 + F.ln("n")) * (F.ln((1.0 + F.col("t")) / (1 + F.col("df"))) + 1)
    return joined.select("doc_id", "gram", F.round(weight, 6).alias("weight"))


#: A fixed model of hand-made features only, for queries that SQL can check.
WEIGHTS = dict.fromkeys(features.NAMES, 0.0) | {"length": 0.001, "uppercase_ratio": -4.0, "has_level": -2.0, "digit_ratio": -1.0, "has_negative": -3.0, "n_allcaps": -0.5, "n_emphasis": -0.25}
INTERCEPT = 0.75
SMALL_MODEL = LineModel({
    "word_tfidf": {"vocab": {}, "idf": [], "ngram_range": [1, 3], "sublinear_tf": True}, "char_tfidf": {"vocab": {}, "idf": [], "ngram_range": [3, 6]}, "normalize_patterns": [], "handcrafted": {},
    "classifier": {"coef": list(WEIGHTS.values()), "intercept": INTERCEPT, "classes": ["LOOK", "SKIP"], "n_word_features": 0, "n_char_features": 0, "n_handcrafted_features": 17},
})
_SCORE = f"1 / (1 + exp({INTERCEPT} + " + " + ".join(f"{w} * {n}" for n, w in WEIGHTS.items() if w) + "))"
_SCORED = _FEATURES_SQL.removeprefix("WITH ").replace(")\nSELECT file_path, line_number,", "),\nx AS (SELECT file_path, source, raw, m, line_number,", 1) + f"), p AS (SELECT *, {_SCORE} AS p_look FROM x)"


def _scored(spark, sf, by_source: bool = False):
    if by_source:
        docs = spark.read.parquet(f"{sf}/documents.parquet").select("source", F.col("doc_id").cast("string").alias("doc"), F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
        lines = docs.select(F.col("source").alias("file_path"), "doc", (F.col("pos") + 1).cast("bigint").alias("line_number"), "raw")
    else:
        lines = A.doc_lines(spark, sf)
    return score_lines(lines, SMALL_MODEL)


@register("classify_scores", f"WITH {_SCORED} SELECT file_path, line_number, round(p_look, 6) AS p_look, CASE WHEN p_look >= 0.5 THEN 'LOOK' ELSE 'SKIP' END AS label FROM p")
def classify_scores(spark, sf):
    from .operators.classify import label_lines

    return label_lines(_scored(spark, sf)).select("file_path", "line_number", F.round("p_look", 6).alias("p_look"), "label")


_ERR, _WARN = "(?i)" + ERROR_WORDS, "(?i)" + WARN_WORDS


@register("classify_counts", f"WITH {_SCORED}, q AS (SELECT p_look >= 0.5 AS look, regexp_matches(m, '{_ERR}') AS e, regexp_matches(m, '{_WARN}') AND NOT regexp_matches(m, '{_ERR}') AS w FROM p) SELECT count(*) AS total, count(*) FILTER (WHERE look) AS look, count(*) FILTER (WHERE NOT look) AS skip, count(*) FILTER (WHERE e) AS error_total, count(*) FILTER (WHERE e AND look) AS error_captured, count(*) FILTER (WHERE w) AS warn_total, count(*) FILTER (WHERE w AND look) AS warn_captured FROM q")
def classify_counts(spark, sf):
    return O.classify_counts(_scored(spark, sf))


@register("confidence_buckets", f"WITH {_SCORED} SELECT count(*) FILTER (WHERE p_look >= 0.9) AS high, count(*) FILTER (WHERE p_look >= 0.7 AND p_look < 0.9) AS medium, count(*) FILTER (WHERE p_look < 0.7) AS low FROM p WHERE p_look >= 0.5")
def confidence_buckets(spark, sf):
    return O.confidence(_scored(spark, sf).where("p_look >= 0.5"))


_WIDE = "(?i)" + WIDE_ERROR_WORDS
_CAPTURE = f"count(*) AS lines, count(*) FILTER (WHERE p_look >= 0.5) AS look, count(*) FILTER (WHERE regexp_matches(m, '{_WIDE}')) AS errors, count(*) FILTER (WHERE regexp_matches(m, '{_WIDE}') AND p_look >= 0.5) AS errors_captured, count(*) FILTER (WHERE regexp_matches(m, '{_WARN}')) AS warns, count(*) FILTER (WHERE regexp_matches(m, '{_WARN}') AND p_look >= 0.5) AS warns_captured"
_RATES = "CASE WHEN errors > 0 THEN CAST(errors_captured AS DOUBLE) / errors * 100 ELSE 100 END AS error_rate, CASE WHEN warns > 0 THEN CAST(warns_captured AS DOUBLE) / warns * 100 ELSE 100 END AS warn_rate"


@register("keyword_capture", f"WITH {_SCORED}, c AS (SELECT source AS file_path, {_CAPTURE} FROM p GROUP BY source) SELECT *, {_RATES} FROM c")
def keyword_capture_query(spark, sf):
    return keyword_capture(_scored(spark, sf, True), "file_path", grand_total=False)


@register("keyword_capture_rollup", f"WITH {_SCORED}, c AS (SELECT source AS file_path, {_CAPTURE} FROM p GROUP BY ROLLUP (source)) SELECT *, {_RATES} FROM c")
def keyword_capture_rollup(spark, sf):
    return keyword_capture(_scored(spark, sf, True), "file_path")


@register("confusion_matrix", "WITH j AS (SELECT toxic = 1 OR quality = 0 AS t, regexp_matches(text, '[!#*%$|]') AS p FROM labels JOIN documents USING (doc_id)), c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM j) SELECT *, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 9) AS \"precision\", round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1 FROM c")
def confusion_matrix(spark, sf):
    labels, docs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "documents"))
    got = confusion(labels.join(docs, "doc_id").select(((F.col("toxic") == 1) | (F.col("quality") == 0)).alias("truth"), F.col("text").rlike("[!#*%$|]").alias("predicted")))
    return got.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@register("label_validation", f"WITH {EVENTS}, j AS (SELECT level = 'ERROR' AS t, level = 'ERROR' AND line_number % 4 > 0 OR line_number % 50 = 0 AS p FROM e WHERE line_number % 3 > 0), c AS (SELECT count(*) FILTER (WHERE t AND p) AS tp, count(*) FILTER (WHERE NOT t AND p) AS fp, count(*) FILTER (WHERE t AND NOT p) AS fn, count(*) FILTER (WHERE NOT t AND NOT p) AS tn FROM j) SELECT *, round((tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE), 9) AS accuracy, round(tp / CAST(tp + fp AS DOUBLE), 9) AS \"precision\", round(tp / CAST(tp + fn AS DOUBLE), 9) AS recall, round(2 * tp / CAST(2 * tp + fp + fn AS DOUBLE), 9) AS f1 FROM c")
def label_validation(spark, sf):
    """Labels with errors, of two lines in three, against the levels."""
    e = A.events_entries(spark, sf)
    label = lambda c: F.when(c, "LOOK").otherwise("SKIP").alias("label")
    error, n = F.col("level") == "ERROR", F.col("line_number")
    got = validate_labels(e.where(n % 3 > 0).select("line_number", label((error & (n % 4 > 0)) | (n % 50 == 0))), e.select("line_number", label(error)))
    return got.withColumns({c: F.round(c, 9) for c in ("accuracy", "precision", "recall", "f1")})


@register("evenly_spaced_sample", f"WITH {EVENTS}, r AS (SELECT file_path, line_number, row_number() OVER (PARTITION BY file_path ORDER BY line_number) - 1 AS k, count(*) OVER (PARTITION BY file_path) AS n FROM e WHERE level = 'ERROR') SELECT file_path, line_number FROM r WHERE n <= 8 OR k IN (SELECT CAST(floor(i * (n - 1) / 7.0) AS BIGINT) FROM range(8) t(i))")
def evenly_spaced_sample(spark, sf):
    e = A.events_entries(spark, sf)
    return sample_evenly(e.withColumn("p_look", F.when(F.col("level") == "ERROR", 1.0).otherwise(0.0))).select("file_path", "line_number")


@register("bgl_label_split", f"WITH {EVENTS} SELECT line_number, CASE WHEN level = 'DEBUG' THEN 'SKIP' ELSE 'LOOK' END AS label, message AS rest FROM e")
def bgl_label_split(spark, sf):
    e = A.events_entries(spark, sf)
    label, rest = split_bgl(F.concat(F.when(F.col("level") == "DEBUG", "-").otherwise(F.col("level")), F.lit(" "), "message"))
    return e.select("line_number", label.alias("label"), rest.alias("rest"))


@register("previous_run", f"WITH {EVENTS}, a AS (SELECT file_path, count(*) AS look FROM e WHERE level = 'ERROR' AND file_path < 'C' GROUP BY 1), b AS (SELECT file_path, count(*) AS look FROM e WHERE level <> 'DEBUG' AND file_path > 'A' GROUP BY 1) SELECT coalesce(a.file_path, b.file_path) AS file_path, a.look AS look, b.look AS previous_look, a.look - b.look AS look_change FROM a FULL JOIN b ON a.file_path = b.file_path")
def previous_run(spark, sf):
    e = A.events_entries(spark, sf)
    runs = [e.where(c).groupBy("file_path").agg(F.count("*").alias("look")) for c in ("level = 'ERROR' and file_path < 'C'", "level <> 'DEBUG' and file_path > 'A'")]
    return with_previous(runs[0], runs[1], "look")


# --- Files --------------------------------------------------------------------------------------------------------
def _in_order(df: DataFrame) -> DataFrame:
    """``df`` by line_number, in parts of some LOG_LINES rows, so that no task sorts or writes the whole of it."""
    return df.repartitionByRange(max(1, -(-df.count() // LOG_LINES)), "line_number").sortWithinPartitions("line_number")


def _written(spark, df: DataFrame, name: str, kind: str, **options) -> str:
    """A folder with a file for each part of ``df``, in the shared folder if the session names one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    path = f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).format(kind).save(path)
    return path


_FILE_SQL = f"WITH {EVENTS} SELECT line_number, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || level || ' ' || message AS raw FROM e"
for _name, _options in (("text", {}), ("gzip", {"compression": "gzip"})):
    register(f"source_{_name}_file", _FILE_SQL)(lambda spark, sf, name=_name, options=_options: read_lines(spark, _written(spark, _in_order(A.events_raw(spark, sf)).select("raw"), name, "text", **options), parts=True).select("line_number", "raw"))


@register("source_file_entries", f"WITH {EVENTS} SELECT line_number, ts, level, message FROM e")
def source_file_entries(spark, sf):
    """A log, written in parts, read, numbered, detected, parsed and merged."""
    path = _written(spark, _in_order(A.events_raw(spark, sf)).select("raw"), "entries", "text")
    return to_entries(read_lines(spark, path, parts=True)).select("line_number", "ts", "level", "message")


@register("source_csv_truth", f"WITH {EVENTS} SELECT line_number, CASE WHEN level = 'DEBUG' THEN 'SKIP' ELSE 'LOOK' END AS label FROM e")
def source_csv_truth(spark, sf):
    rows = _in_order(A.events_entries(spark, sf)).select(F.when(F.col("level") == "DEBUG", "-").otherwise(F.col("level")).alias("Label"), "message")
    return read_csv_truth(spark, _written(spark, rows, "truth", "csv", header="true"))


@register("source_jsonl", f"WITH {EVENTS} SELECT 'events' AS system, line_number, message AS raw_line, level AS label FROM e")
def source_jsonl(spark, sf):
    rows = A.events_entries(spark, sf).select(F.lit("events").alias("system"), "line_number", F.col("message").alias("raw_line"), F.col("level").alias("label"), F.lit("").alias("reason"))
    return read_jsonl(spark, _written(spark, rows, "labels", "json")).drop("reason")


# --- Labelling --------------------------------------------------------------------------------------------------
@register("label_windows_50", f"WITH {LINES} SELECT file_path || '_' || start_line AS custom_id, file_path AS dataset, start_line, count(*) AS n_lines FROM (SELECT *, CAST(floor((line_number - 1) / 50.0) * 50 + 1 AS BIGINT) AS start_line FROM l) GROUP BY file_path, start_line")
def label_windows_50(spark, sf):
    return label_windows(A.doc_lines(spark, sf)).drop("request")


def _log_of(line_number):
    """Name of the log that holds a line of the events: they are cut to logs, whatever their number, and keep their line numbers."""
    return F.concat(F.lit("events/"), F.floor((line_number - 1) / LOG_LINES).cast("string"))


def _labels(spark, sf):
    """Labels of windows, one for each event that is an error or a sign-up, with some that point beyond their log."""
    e = A.events_entries(spark, sf).where("level <> 'DEBUG'")
    start = F.floor((F.col("line_number") - 1) / WINDOW) * WINDOW + 1
    return e.select(
        F.concat_ws("_", _log_of(F.col("line_number")), start.cast("string")).alias("custom_id"), (F.col("line_number") - start + 1 + F.when(F.col("line_number") % 10 == 0, LOG_LINES).otherwise(0)).alias("window_line"),
        F.when(F.col("level") == "ERROR", "LOOK").otherwise("SKIP").alias("label"), F.lit("").alias("reason"),
    )


@register("label_remap", f"WITH {EVENTS} SELECT 'events' AS system, line_number + CASE WHEN line_number % 10 = 0 THEN 1000000 ELSE 0 END AS line_number, CASE WHEN line_number % 10 = 0 THEN '' ELSE message END AS raw_line, CASE WHEN level = 'ERROR' THEN 'LOOK' ELSE 'SKIP' END AS label, '' AS reason FROM e WHERE level <> 'DEBUG'")
def label_remap(spark, sf):
    remapped = remap_labels(_labels(spark, sf), A.events_entries(spark, sf).withColumn("file_path", _log_of(F.col("line_number"))))
    return remapped.withColumn("system", F.regexp_extract("system", "^[^/]+", 0))


@register("new_datasets_anti", "SELECT CAST(doc_id AS VARCHAR) AS dataset FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def new_datasets_anti(spark, sf):
    return new_datasets(A.doc_lines(spark, sf), spark.read.parquet(f"{sf}/labels.parquet").select(F.col("doc_id").cast("string").alias("system")))
