"""Structured Streaming jobs: incremental ingest, running popularity, and popularity under corrections."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ingest(spark: SparkSession, source: str, schema: T.StructType, target: str, checkpoint: str, max_files: int | None = None) -> None:
    """Append what is new under ``source`` to the Parquet table ``target`` and stop.

    The checkpoint knows the files that are done, so a job that failed goes on
    where it was, and a second run without new files changes nothing.
    """
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    reader.parquet(source).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def running_popularity(events: DataFrame, window: str = "1 day", late: str = "1 day", item_col: str = "item_id", ts_col: str = "ts") -> DataFrame:
    """window_start, item, events: counts per time window; on a stream, windows older than the watermark are final."""
    counted = events.withWatermark(ts_col, late) if events.isStreaming else events
    out = counted.groupBy(F.window(ts_col, window).alias("w"), F.col(item_col).alias("item")).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("w.start").alias("window_start"), "item", "events")


def run_popularity(stream: DataFrame, target: str, checkpoint: str, **options: str) -> None:
    """Run ``running_popularity`` over what is there; each batch's changed counts are written under its number."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    counts = running_popularity(stream, **options)
    counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_popularity(spark: SparkSession, target: str) -> DataFrame:
    """The newest count of each window and item from what ``run_popularity`` wrote."""
    rows = spark.read.parquet(target)
    return rows.groupBy("window_start", "item").agg(F.max_by("events", "batch").alias("events"))


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """State on disk for the streams that start within the block."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def latest_signs(events: DataFrame, threshold: float = 3.0) -> DataFrame:
    """user_id, item_id, positive of (user_id, item_id, rating, ts, ord): whether the latest event of a user and item has at least the threshold.

    Latest is by (ts, ord, rating), nulls first, so events may come in any order and
    repeatedly. On a stream the state is one small row for each (user, item), kept by
    Spark's own aggregation; it never expires, and lies on disk.
    """
    event = F.struct(F.col("ts").cast("long").alias("ts"), F.col("ord").cast("long").alias("ord"), F.col("rating").cast("double").alias("rating"))
    latest = events.groupBy("user_id", "item_id").agg(F.max(event).alias("latest"))
    return latest.select("user_id", "item_id", F.coalesce(F.col("latest.rating") >= threshold, F.lit(False)).alias("positive"))


def run_corrected_popularity(stream: DataFrame, target: str, checkpoint: str, threshold: float = 3.0) -> None:
    """Run ``latest_signs`` over what is there; each batch's users and items are written under its number, so a repeated batch replaces itself."""

    def put(batch: DataFrame, number: int) -> None:
        batch.where("item_id > 0").write.mode("overwrite").parquet(f"{target}/batch={number}")

    with rocksdb(stream.sparkSession):
        signs = latest_signs(stream, threshold)
        signs.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def corrected_popularity(spark: SparkSession, target: str) -> DataFrame:
    """item_id, popularity from what ``run_corrected_popularity`` wrote: users whose newest sign is positive; items without any are out, and so are null and non-positive ids."""
    newest = spark.read.parquet(target).groupBy("user_id", "item_id").agg(F.max(F.struct("batch", "positive")).alias("newest"))
    return newest.where("newest.positive").groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity"))
