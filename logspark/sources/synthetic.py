"""Deterministic synthetic server logs for tests and demonstrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# (level, message; %d is a varying number), shared by all servers.
SHARED = (
    ("INFO", "request %d served"), ("DEBUG", "pool holds %d connections"), ("WARN", "slow query took %d ms"), ("ERROR", "upstream timed out after %d s"), ("INFO", "heartbeat %d"),
)
OWN = {"a": (("ERROR", "cache shard %d lost"), ("WARN", "eviction of %d keys")), "b": (("ERROR", "payment %d declined"), ("INFO", "webhook %d delivered"))}


def synthetic_server_log(spark: SparkSession, server: str, rows: int, seed: int = 42) -> DataFrame:
    """file_path, line_number, raw: time stamp, level, message; each error is followed by a two-line trace."""
    templates = SHARED + OWN.get(server, ())
    table = F.array(*[F.struct(F.lit(level).alias("level"), F.lit(text).alias("text")) for level, text in templates])
    pick = F.pmod(F.xxhash64("id", F.lit(server), F.lit(seed)), F.lit(len(templates))).cast("int")
    base = spark.range(rows).select("id", F.element_at(table, pick + 1).alias("t"), F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(9000)).alias("n"))
    stamp = F.date_format(F.lit("2024-01-15 10:00:00").cast("timestamp_ntz") + F.make_interval(secs=F.col("id") * 7), "yyyy-MM-dd HH:mm:ss")
    first = F.concat_ws(" ", stamp, "t.level", F.regexp_replace("t.text", "%d", F.col("n").cast("string")))
    trace = F.array(F.lit("  at service.handle(service.py:10)"), F.lit("  at service.run(service.py:20)"))
    lines = base.select("id", F.posexplode(F.when(F.col("t.level") == "ERROR", F.concat(F.array(first), trace)).otherwise(F.array(first))).alias("pos", "raw"))
    from pyspark.sql import Window as W

    return lines.select(F.lit(server).alias("file_path"), F.row_number().over(W.orderBy("id", "pos")).cast("bigint").alias("line_number"), "raw")
