"""Log relations out of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMPONENTS = ("auth", "billing", "cache", "gateway", "ingest", "search", "worker")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path (A, B, C by user), line_number, ts, level, message of the event log."""
    kind = F.col("event_type")
    level = F.when(kind == "error", "ERROR").when(kind.isin("purchase", "signup"), "INFO").otherwise("DEBUG")
    component = F.element_at(F.array(*map(F.lit, COMPONENTS)), (F.col("event_id") % 7 + 1).cast("int"))
    message = F.concat(component, F.lit(" user="), F.col("user_id"), F.lit(" type="), kind, F.lit(" props="), F.col("props"))
    label = F.element_at(F.array(F.lit("A"), F.lit("B"), F.lit("C")), (F.col("user_id") % 3 + 1).cast("int"))
    return _table(spark, sf_dir, "events").select(
        label.alias("file_path"), (F.col("event_id") + 1).alias("line_number"), F.col("ts").cast("timestamp_ntz").alias("ts"),
        level.alias("level"), message.alias("message"), message.alias("raw"), F.lit(None).cast("string").alias("prefix"),
    )


def events_raw(spark: SparkSession, sf_dir: str, layout: int | str = 0) -> DataFrame:
    """The event log written out as lines of one file, in the layout asked for."""
    e = events_entries(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    line = {
        0: F.concat(stamp, F.lit(" "), "level", F.lit(" "), "message"),
        1: F.concat(F.lit("["), stamp, F.lit("] ["), "level", F.lit("] "), "message"),
        2: F.concat("level", F.lit(" "), stamp, F.lit(" "), "message"),
        3: F.concat(F.date_format("ts", "MMM d HH:mm:ss"), F.lit(" host app[1]: "), "message"),
        4: F.concat(stamp, F.lit(" "), "message"),
        "delim": F.concat(F.lit("svc|"), stamp, F.lit("|"), "level", F.lit(" "), "message"),
        "offset": F.concat(F.date_format("ts", "yy/MM/dd HH:mm:ss"), F.lit(" "), "level", F.lit(" "), "message"),
    }[layout]
    return e.select(F.lit("events").alias("file_path"), "line_number", line.alias("raw"))


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as JSON lines."""
    e = events_entries(spark, sf_dir)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select(F.lit("events").alias("file_path"), "line_number", F.to_json(F.struct(stamp.alias("timestamp"), "level", "message", F.col("file_path").alias("origin"))).alias("raw"))


def _split(df: DataFrame, file_path, text: str) -> DataFrame:
    return df.select(file_path.alias("file_path"), F.posexplode(F.split(text, "\n")).alias("pos", "raw")).select("file_path", (F.col("pos") + 1).cast("bigint").alias("line_number"), "raw")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """file_path = doc_id; the lines of the documents."""
    return _split(_table(spark, sf_dir, "documents"), F.col("doc_id").cast("string"), "text")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(_table(spark, sf_dir, "pages"), F.col("page_id").cast("string"), "html")


def conv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's turns as the lines of a file."""
    return _table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("file_path"), (F.col("turn") + 1).alias("line_number"), F.col("text").alias("raw"))
