"""Shared plumbing of the training-data operators.

Tables go to the shared folder named by ``spark.checkpoint.dir``, so a lost
executor never takes the only copy of an intermediate result with it. Without
that setting a folder of this machine serves a local session, where driver and
executor are one process; on a cluster its absence is an error.
"""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"{tempfile.gettempdir()}/logspark-shared"
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage durably."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._logspark_path = path
    return out


def drop_saved(df: DataFrame) -> None:
    """Remove a table of :func:`save` that nothing reads any more."""
    path = getattr(df, "_logspark_path", None)
    if path:
        spark = df.sparkSession
        jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows (texts can be long, and a worker holds a batch whole), by workers that know this package."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def hash128(c: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes of a string column (the second salted by a prefix)."""
    return F.xxhash64(c), F.xxhash64(F.concat(F.lit("\u0001"), c))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array without copying; nulls are empty."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each slice holds about ``limit`` text bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            to = min(max(to, at + 1), batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column out of concatenated values and the rows' sizes."""
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def with_defaults(docs: DataFrame, **kinds: str) -> DataFrame:
    """Exactly the named columns; one that is missing is null."""
    return docs.select(
        *[(docs[f"`{c}`"] if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]
    )


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps soon rather than at some later collection.

    A plan is reachable until the references to it have been queued, which takes a collection of its own. Only the disk
    that shuffle files take meanwhile depends on this.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
