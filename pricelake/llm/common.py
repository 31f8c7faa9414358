"""Shared plumbing of the training-data operators: where intermediate tables go, how columns are guarded."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no shared folder (tests, notebooks).
FALLBACK_DIR = "/tmp/checkpoints"
#: Bytes of a batch to a Python worker at most (a longer row is a batch by itself).
BATCH_BYTES = 8 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a fallback serves a local
    session; a cluster is refused, as its machines don't see each other's folders."""
    given = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not given and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (given or FALLBACK_DIR).rstrip("/")


def materialise(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, and a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession)}/pricelake/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    written = df.sparkSession.read.schema(df.schema).parquet(path)
    written._pricelake_path = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete tables of :func:`materialise` that nothing reads any more."""
    for df in written:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._pricelake_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder; batches to Python workers are bounded by bytes, as texts may be long."""
    spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def trim() -> None:
    """Gives memory that a task no longer needs back to the system: an executor may keep several idle workers."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


#: What workers remember between tasks of one operator: dictionaries that :func:`forget` empties.
MEMORIES: list[dict] = []


def forget() -> None:
    """A worker that turns to another operator drops what the last one remembered."""
    for memory in MEMORIES:
        memory.clear()


def trimmed(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A batch function that forgets other operators' memories when its task begins, and trims when it ends."""

    @wraps(run)
    def wrapper(batches: Iterable) -> Iterator:
        forget()
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapper


#: Bytes of input for a bucket of a packed exchange, about.
BUCKET_BYTES = 16 << 20


def buckets_for(spark: SparkSession, df: DataFrame) -> int:
    """Buckets of a packed exchange, each of which is one group of one task: by the bytes that ``df`` reads, and as many as
    the session's shuffle partitions at least (also where Spark can't tell the bytes)."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES) if size < 1 << 60 else 0)


def require(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}; the table has {df.columns}")


def text_hash(col: str = "text"):
    """crc32(doc_id as text), the fold of the contracts."""
    return F.crc32(F.col(col).cast("string").cast("binary"))
