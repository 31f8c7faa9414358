"""Ingestion as a stream: new files or rows since the last run, in micro-batches, exactly once per batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.versions import fold


def once(source: DataFrame, checkpoint: str, batch: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``batch`` over all that is new, then stops. The checkpoint remembers what was done, so a second run adds
    nothing."""
    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_new(store: str, key: str, order: str) -> Callable[[DataFrame, int], None]:
    """A batch function: rows whose key isn't stored are appended, the first of each key in the batch. Batches are
    numbered, so a batch that is run again replaces itself."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        first = rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), order).alias("r")).select(key, "r.*")
        try:
            stored = spark.read.parquet(store).where(F.col("batch") != number).select(key)
            first = first.join(stored, key, "left_anti")
        except Exception as e:  # noqa: BLE001  no batch was stored yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        first.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return batch


def current(spark: SparkSession, store: str, by: list[str], order: list[str]) -> DataFrame:
    """The versioned view of all batches: late rows of earlier dates are kept, as inactive history."""
    return fold(spark.read.parquet(store), by, order)


def deduplicated(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Keys seen within the delay are dropped; the state is bounded by the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, delay: str, width: str, *by: str) -> DataFrame:
    """Counts per window and group of a stream with late rows."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"))
