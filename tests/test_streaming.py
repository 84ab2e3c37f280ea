from logspark.streaming import stream_lines, windowed_counts


def test_windowed_counts(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("2024-01-15 10:00:01 ERROR x 1\n2024-01-15 10:00:02 ERROR x 2\n2024-01-15 10:06:00 INFO y\n")
    counted = windowed_counts(stream_lines(spark, str(tmp_path / "in")))
    q = counted.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    try:
        q.processAllAvailable()
        got = {(str(r["bucket_start"]), r["level"]): r["count"] for r in spark.table("counts").collect()}
    finally:
        q.stop()
    assert got == {("2024-01-15 10:00:00", "ERROR"): 2, ("2024-01-15 10:05:00", "INFO"): 1}
