"""What the training-data operators share: tables, shared storage, Arrow helpers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch while a table is written: whole texts are in it, in the JVM's buffers and in the worker's.
ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir; where it is unset, a local one in local mode, else an error."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "docquarry-checkpoints")
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def sweep() -> None:
    """Deletes all that write_shared() has written; for long sessions, once results that read it are stored.  Runs at exit."""
    for spark, path in list(_WRITTEN):
        remove_shared(spark, path)


def remove_shared(spark: SparkSession, path: str) -> None:
    """Deletes what write_shared() wrote; a session that has ended is no error."""
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the gateway may be gone at exit
        pass
    _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Cuts lineage: writes Parquet to the shared folder and reads it back.  Lost executors cost nothing of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(sweep)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, min(int(before), ROWS) if int(before) > 0 else ROWS)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size; sizes partitions and buckets, never what is computed."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def pieces(batch: pa.RecordBatch, column: str, most_bytes: int):
    """Slices of a batch whose string column holds about most_bytes each (one row at least)."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, base = 0, 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start, base = stop, int(size[stop - 1])


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A string column as Python strings, null as empty."""
    return pc.fill_null(batch.column(column), "").to_pylist()


def fold(doc_id, parts: int = 5):
    """crc32(doc_id as text) mod parts as a column; a null id has the fold of the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def fold_of(ids: pa.Array, parts: int = 5) -> np.ndarray:
    """The same as fold() over an Arrow column."""
    return np.array([zlib.crc32(str(x).encode() if x is not None else b"") % parts for x in ids.to_pylist()], dtype=np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 (in a new array)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x
