"""Reading and writing files. Every path goes through Spark's own file systems; .gz is read transparently."""

from __future__ import annotations

from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.predicates import LogQueryError
from ..plans.formats import held

LABEL_SCHEMA = "system string, line_number bigint, raw_line string, label string, reason string"


def validate_paths(spark: SparkSession, paths: Sequence[str]) -> None:
    """Raises LogQueryError for a path that is missing or may not be read."""
    read = spark._jvm.org.apache.hadoop.fs.permission.FsAction.READ
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = p.getFileSystem(spark._jsc.hadoopConfiguration())
        if not files.exists(p):
            raise LogQueryError(f"File not found: {path}")
        try:
            files.access(p, read)
        except Py4JJavaError as e:
            raise LogQueryError(f"File not readable: {path}") from e


def _place() -> list[Column]:
    """Where a row of a scan of files stands: file, block, and an id that grows within the block."""
    file = F.regexp_replace("_metadata.file_path", "^file:(//)?", "")
    return [file.alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id")]


def _numbered(scan: DataFrame, log: Column) -> DataFrame:
    """``scan`` with ``line_number``, the row's place in its ``log``: that of a block's first row, and the row's place in its block.

    It has the columns of :func:`_place`. No file comes to one task: each block counts its rows, and the
    counts of the blocks before it, files by name, are added. A scan gives the same rows the same ids each time, so both uses
    of it agree. Blocks are counted here and now, so that a log of many uses is counted once and is not shuffled to meet its counts.
    """
    blocks = scan.groupBy(log.alias("_log"), "file", "block").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(W.partitionBy("_log").orderBy("file", "block").rowsBetween(W.unboundedPreceding, -1))
    blocks, _ = held(blocks.select("file", "block", (F.coalesce(before, F.lit(0)) - F.col("first") + 1).alias("_shift")))
    return scan.join(blocks, ["file", "block"]).withColumn("line_number", F.col("id") + F.col("_shift"))


def read_lines(spark: SparkSession, paths: str | Sequence[str], recursive: bool = False, parts: bool = False) -> DataFrame:
    """file_path, line_number (from 1), raw; with ``recursive`` all *.log files below directories.

    With ``parts`` the files of a folder are one log, in the order of their names, and file_path is the folder.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    validate_paths(spark, paths)
    reader = spark.read
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log")
    scan = reader.text(paths).select(*_place(), F.make_valid_utf8("value").alias("raw"))
    log = F.regexp_replace("file", "/[^/]*$", "") if parts else F.col("file")
    return _numbered(scan, log).select(log.alias("file_path"), "line_number", "raw")


def count_lines(lines: DataFrame) -> DataFrame:
    return lines.groupBy("file_path").agg(F.count("*").alias("lines"))


def file_sizes(spark: SparkSession, paths: Sequence[str], recursive: bool = False) -> DataFrame:
    """file_path, bytes."""
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log")
    files = reader.load(list(paths))
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("file_path"), F.col("length").alias("bytes"))


def format_size(n: Column) -> Column:
    """B without, KB to TB with one decimal."""
    out = F.format_string("%d B", n)
    for i, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**i, F.format_string(f"%.1f {unit}", n / float(1024**i))).otherwise(out)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str = LABEL_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_csv_truth(spark: SparkSession, path: str) -> DataFrame:
    """line_number and label of a structured CSV whose column Label holds "-" for lines to skip."""
    rows = spark.read.option("header", "true").csv(path)
    if "LineId" in rows.columns:
        rows = rows.withColumn("_number", F.col("LineId").try_cast("bigint"))
    else:  # the row's place in the file, or in all files by name
        rows = _numbered(rows.select("Label", *_place()), F.lit("")).withColumnRenamed("line_number", "_number")
    return rows.select(F.col("_number").alias("line_number"), F.when(F.col("Label") == "-", "SKIP").otherwise("LOOK").alias("label"))


def write_jsonl(df: DataFrame, path: str, by: str | None = None, append: bool = False) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_text(text: str, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").write.mode("overwrite").text(path)
