import gzip

import pytest
from pyspark.sql import functions as F

from logspark.engine import LogEngine
from logspark.functions.predicates import LogQueryError
from logspark.plans import detect_formats, to_entries
from logspark.queries import SMALL_MODEL
from logspark.sources import read_lines, synthetic_server_log

PLAIN = """leading noise
2024-01-15 10:30:45 INFO started job 1
2024-01-15 10:30:50 ERROR timeout after 30s
  at foo.bar(x)
  at foo.baz(y)

2024-01-15 10:31:00.123 ERROR timeout after 45s
2024-01-15 10:31:10 GET /x
2024-01-15 11:31:20 WARNING disk low
"""


def _entries(spark, path, **k):
    return to_entries(read_lines(spark, path), **k).orderBy("line_number").collect()


def test_text_entries(spark, log):
    got = _entries(spark, log(PLAIN))
    assert [r["line_number"] for r in got] == [2, 3, 7, 8, 9]
    assert got[1]["message"] == "timeout after 30s\n  at foo.bar(x)\n  at foo.baz(y)\n" and got[1]["end_line"] == 6
    assert got[3]["level"] is None and got[3]["message"] == "/x"
    assert [r["level"] for r in got] == ["INFO", "ERROR", "ERROR", None, "WARNING"]


def test_line_numbers_over_blocks(spark, log):
    text = "".join(f"line {i}\n" for i in range(5000))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8000")
    try:
        rows = read_lines(spark, log(text)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["line_number"], r["raw"]) for r in rows) == [(i + 1, f"line {i}") for i in range(5000)]


@pytest.mark.parametrize(
    "text, fmt, level, message, prefix",
    [
        ('{"TS": 1705314645000, "Severity": "warn", "msg": "x", "k": 1}\n' * 2, "json", "WARN", "x", None),
        ("17/06/08 13:33:49 INFO executor.Backend: Registered\n" * 3, "offset", "INFO", "executor.Backend: Registered", None),
        ("test\tUNKNOWN STEP\t2026-02-24T18:21:48.867Z\tStarting runner\n" * 2, "delim", None, "Starting runner", "test\tUNKNOWN STEP"),
        ("svc|2024-01-15 10:00:00|ERROR boom\n" * 2, "delim", "ERROR", "boom", "svc"),
        ("2026/02/27 10:00:00 [crit] 1#0: x\n" * 4, "offset", "CRITICAL", "1#0: x", "20"),
        ("[2024-01-15 10:30:45] ERROR something\n", "text", "ERROR", "something", None),
        ("ERROR 2024-01-15 10:30:45 msg\n", "text", "ERROR", "msg", None),
        ("Jan 15 10:30:45 host proc[1]: msg\n", "text", None, "msg", None),
    ],
)
def test_layouts(spark, log, text, fmt, level, message, prefix):
    path = log(text)
    assert detect_formats(read_lines(spark, path)).first()["fmt"] == fmt
    r = _entries(spark, path)[0]
    assert (r["level"], r["message"], r["prefix"]) == (level, message, prefix) and r["ts"] is not None


def test_json_extra_and_epoch(spark, log):
    r = _entries(spark, log('{"TS": 1705314645000, "Severity": "warn", "msg": "x", "k": 1}\n'))[0]
    assert str(r["ts"]) == "2024-01-15 10:30:45" and r["extra"] == {"k": "1"}


def test_no_layout_no_entries(spark, log):
    assert _entries(spark, log("plain words\n" * 20)) == []


def test_gzip_and_ranges(spark, log):
    path = log(gzip.compress(PLAIN.encode()), "test.log.gz")
    assert len(_entries(spark, path)) == 5
    assert [r["line_number"] for r in _entries(spark, path, start_line=3, end_line=4)] == [3]


def test_reports(spark, log):
    engine, path = LogEngine(spark, SMALL_MODEL), log(PLAIN)
    text = engine.overview(path, 2).render()
    assert "Lines: 9" in text and "Levels: INFO=1 ERROR=2 WARNING=1" in text and "--- Tail ---" in text
    text = engine.search(path, pattern="TIMEOUT", max_results=1).render()
    assert text.startswith("Matches: 1 (scanned 2) [truncated]") and "L3 [2024-01-15T10:30:50] ERROR timeout after 30s" in text
    assert engine.search(path, log_level="warn").render().startswith("Matches: 1 (scanned 5)")
    assert engine.segment(path, start_line=7).render().startswith("Segment: 3 entries (9 total)")
    text = engine.errors(path).render()
    assert "2 errors in 2 groups." in text and "Stack trace:\n    at foo.bar(x)" in text
    text = engine.stats(path).render()
    assert "5 entries over 1.0h." in text and "40.0% errors." in text and "Top patterns:" in text
    assert engine.classify(path).render().startswith(f"File: {path}\nLines: 9 total")
    with pytest.raises(LogQueryError):
        engine.classify(path, output="odd")
    with pytest.raises(LogQueryError):
        engine.overview("/nowhere/x.log")


def test_errors_by_content(spark, log):
    text = "job\t2026-02-24T18:21:48Z\tall well\njob\t2026-02-24T18:21:49Z\tBuild failed\n" * 2
    groups = LogEngine(spark).errors(log(text))
    assert groups["summary"].first()[:] == (2, True) and groups["groups"].first()["count"] == 2


def test_compare_synthetic(spark, tmp_path):
    paths = []
    for server in ("a", "b"):
        lines = [r["raw"] for r in synthetic_server_log(spark, server, 300).orderBy("line_number").collect()]
        (tmp_path / f"{server}.log").write_text("\n".join(lines) + "\n")
        paths.append(str(tmp_path / f"{server}.log"))
    report = LogEngine(spark).compare(paths)
    s = report["summary"].first()
    assert s["shared"] == 5 and s["unique_A"] == 2 and s["unique_B"] == 2 and s["patterns"] == 9
    assert "=== Shared (5) ===" in report.render()


def test_counts_survive_repartition(spark, log):
    lines = read_lines(spark, log(PLAIN * 50))
    formats = detect_formats(lines)
    one = to_entries(lines, formats).groupBy("level").count().collect()
    two = to_entries(lines.repartition(7, F.rand(1)), formats).groupBy("level").count().collect()
    assert sorted(map(tuple, one), key=str) == sorted(map(tuple, two), key=str)
