import random
import re

from pyspark.sql import functions as F

from logspark.functions import normalize, normalize_extended, parse_timestamp, python_forms, register
from logspark.functions.features import HEX, KEY_VALUE, NAMES, NEGATIVE, REPEATED, line_features
from logspark.functions.predicates import CONTENT_ERROR, is_content_error, java_pattern, parse_bound, uses_classifier

PIECES = ["id=550e8400-e29b-41d4-a716-446655440000", "a" * 40, "abc123def456", "abc123def45", "0x1a2b3c", "port 8080", "container_abc123", "10.0.0.1", 'k="some value"', "k='v w'", "foo_bar_1234", "é12", "\t", "  ", "x_y", "task_ab1", "dead beef", "ERROR", "/var/log/x.log", "!!!", "a=b", "unable to", "Traceback"]


def _lines(n=400):
    r = random.Random(5)
    return [" ".join(r.choices(PIECES, k=r.randint(0, 7))) for _ in range(n)]


def test_normalisers_equal_python(spark):
    lines = _lines()
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    for column, python in ((normalize, python_forms.normalize), (normalize_extended, python_forms.normalize_extended)):
        got = {r["i"]: r["y"] for r in df.select("i", column(F.col("x")).alias("y")).collect()}
        assert [got[i] for i in range(len(lines))] == [python(x) for x in lines]


def test_normaliser_examples():
    n = python_forms.normalize
    assert n("commit " + "a" * 40) == "commit <HEX>"
    assert n("id abc123def456 done") == "id <HEX> done" and "<HEX>" not in n("id abc123def45 done")
    assert n("port 8080 pid 1234") == "port <N> pid <N>"
    assert n("a  b   c") == "a b c"
    assert python_forms.normalize_extended("task task_abc123 completed") == "task <ID> completed"


def test_timestamps(spark):
    cases = {
        "2024-01-15 10:30:45": ("2024-01-15 10:30:45", None), "2024-01-15T10:30:45,1234567Z": ("2024-01-15 10:30:45.123456", 0), "2024-01-15T10:30:45+02:00": ("2024-01-15 10:30:45", 7200),
        "17/06/08 13:33:49": ("2017-06-08 13:33:49", None), "70/06/08 13:33:49": ("1970-06-08 13:33:49", None), "27/Feb/2026:10:00:00 +0000": ("2026-02-27 10:00:00", 0),
        "Jan 15 10:30:45": ("1900-01-15 10:30:45", None), "Feb 29 10:30:45": (None, None), "2024-13-15 10:30:45": (None, None), "nonsense": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    for r in df.select("x", parse_timestamp(F.col("x")).alias("t")).collect():
        ts, offset = cases[r["x"]]
        assert (str(r["t"]["ts"]) if r["t"]["ts"] else None, r["t"]["tz_offset_s"]) == (ts, offset), r
    strict = df.where("x like '%1234567Z'").select(parse_timestamp(F.col("x"), strict=True)["ts"]).first()[0]
    assert strict is None


def test_content_errors(spark):
    lines = ["##[error]Process failed", "fatal: x", "Build failed", "bash: foo: command not found", "Exited with code 1", "could not open", "error: x", "Exited with code 0", "Starting up"]
    df = spark.createDataFrame([(x,) for x in lines], "x string")
    got = {r["x"] for r in df.where(is_content_error(F.col("x"))).collect()}
    assert got == {x for x in lines if re.search(CONTENT_ERROR, x, re.I)} == set(lines[:7])


def test_features_equal_python(spark):
    lines = _lines(200) + ["", "  at foo.bar(x)", "café CAFÉ ABC", "a==b  === x"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, x string")
    got = {r["i"]: r for r in df.select("i", *line_features(F.col("x"))).collect()}
    for i, x in enumerate(lines):
        r, words = got[i], x.split()
        assert r["length"] == len(x) and r["word_count"] == len(words)
        assert r["n_negative"] == len(re.findall(NEGATIVE, x, re.I)) and r["n_hex"] == len(re.findall(HEX, x)) and r["n_kv"] == len(re.findall(KEY_VALUE, x))
        assert r["has_repeated_punct"] == bool(re.search(REPEATED, x))
        assert r["n_allcaps"] == sum(len(w) >= 3 and w.isupper() and w.isalpha() for w in words)
        assert r["leading_ws"] == len(x) - len(x.lstrip())
        assert abs(r["unique_ratio"] - len({w.lower() for w in words}) / max(1, len(words))) < 1e-12
    assert len(NAMES) == 17


def test_patterns_and_bounds():
    assert java_pattern("(?P<a>x)(?P=a)") == r"(?<a>x)\k<a>"
    try:
        java_pattern("(")
        raise AssertionError
    except ValueError as e:
        assert str(e).startswith("Error: Invalid regex pattern")
    assert parse_bound("2024-01-05").day == 5 and parse_bound("soon") is None
    assert uses_classifier(None, "warn") and uses_classifier("timeout", None) and not uses_classifier("started", "INFO")


def test_registered_in_sql(spark):
    register(spark)
    assert spark.sql("select log_normalize('port 80'), log_level(' warning ')").first()[:] == ("port <N>", "WARN")
