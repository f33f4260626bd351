"""Exact de-duplication of a stream of texts with disk-backed keyed state.

The stream of (digest, id, locator) is grouped by the SHA-256 digest of the text
in a stateful streaming aggregation whose state lives in RocksDB and never
expires. Per digest the state retains the largest id, the content locator (file
and row) of the row that has it, and the number of rows seen. When the input is
used up, the state is read as a table and joined back to the rows. Every hit's
full bytes are compared with those of the row it points at; rows that merely
share a digest are grouped by their text instead.

Everything is a DataFrame expression; no Python runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm._bitmap import Bitmap
from recengine.llm._scratch import materialize, scratch_path

_ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "300",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
}


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def _keyed(rows: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return rows.select(
        F.col(id_col).alias("id"),
        text.alias("body"),
        digest(text).alias("digest"),
        F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("at"),
    )


def _as_pattern(path: str) -> str:
    """The path as a pattern that matches itself: a file stream takes a single file only as a pattern."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def stream_state(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    max_bytes_per_trigger: int = 64 << 30,
) -> DataFrame:
    """Run the stream over all files at ``path`` that ``checkpoint`` hasn't seen, and return its state.

    A later call with the same checkpoint goes on from the retained state, so new
    files are matched against everything seen before. One row per digest:
    digest, keep (struct of id and at), n.
    """
    schema = spark.read.parquet(path).schema
    before = {k: spark.conf.get(k, None) for k in _ROCKSDB}
    for k, v in _ROCKSDB.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", max_bytes_per_trigger).parquet(_as_pattern(path))
        kept = (
            _keyed(stream, id_col, text_col, digest)
            .groupBy("digest")
            .agg(F.max(F.struct("id", "at")).alias("keep"), F.count(F.lit(1)).alias("n"))
        )
        kept.writeStream.format("noop").outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
        state = spark.read.format("statestore").load(checkpoint)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # the state holds the aggregation's buffers under its own column names
    value = state.schema["value"].dataType.fieldNames()
    return state.select(
        F.col("key.digest").alias("digest"),
        F.col("value").getField(value[0]).alias("keep"),
        F.col("value").getField(value[1]).alias("n"),
    )


def exact_dedup(
    spark: SparkSession,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_hex,
    checkpoint: str | None = None,
    max_bytes_per_trigger: int = 64 << 30,
) -> DataFrame:
    """One row per input row: id_col, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays; null ids are the smallest.
    Rows with the same id and text are told apart by where they are stored, so
    exactly one row of each group is kept. Null texts count as empty ones. Other
    columns of the table aren't read. An empty table gives no rows.
    """
    if not spark.read.parquet(path).select(F.lit(1)).take(1):
        rows = spark.read.parquet(path)
        return rows.select(
            F.col(id_col),
            F.col(id_col).alias("keep_id"),
            F.lit(0).cast("long").alias("group_size"),
            F.lit(True).alias("kept"),
            F.lit("").alias("text_sha256"),
        ).limit(0)
    state = stream_state(spark, path, checkpoint or scratch_path(spark, "exact-dedup-state"), id_col, text_col, digest, max_bytes_per_trigger)
    groups = materialize(state, "exact-dedup-groups")
    rows = _keyed(spark.read.parquet(path), id_col, text_col, digest)

    # rows of groups with several rows, with their bytes: only these can be hits, and only their texts are shuffled
    several = materialize(groups.where("n > 1").select("digest", "keep"), "exact-dedup-several")
    likely = Bitmap(several, "digest", "exact-dedup-bitmap").near(rows, F.col("digest"))
    hits = materialize(likely.join(several, "digest").select("digest", "id", "at", "body", "keep"), "exact-dedup-hits")
    keepers = hits.where(F.col("at") == F.col("keep.at")).select("digest", F.col("body").alias("kept_body"))
    differ = hits.join(keepers, "digest").where(F.col("body") != F.col("kept_body")).select("digest", "id", "at", "body")
    differ = materialize(differ, "exact-dedup-differ")

    plain = rows.select("digest", "id", "at", sha256_hex(F.col("body")).alias("sha"))
    found = plain.join(groups, "digest")
    if differ.take(1):
        # one digest, several texts: take those rows out of the digest's group and group them by their bytes
        lost = differ.groupBy("digest").agg(F.count(F.lit(1)).alias("lost"))
        apart = differ.groupBy("digest", "body").agg(F.max(F.struct("id", "at")).alias("own_keep"), F.count(F.lit(1)).alias("own_n"))
        own = differ.join(apart, ["digest", "body"]).select("digest", "at", "own_keep", "own_n")
        found = (
            found.join(lost, "digest", "left")
            .join(own, ["digest", "at"], "left")
            .withColumn("n", F.coalesce("own_n", F.col("n") - F.coalesce("lost", F.lit(0))))
            .withColumn("keep", F.coalesce("own_keep", "keep"))
        )
    return found.select(
        F.col("id").alias(id_col),
        F.col("keep.id").alias("keep_id"),
        F.col("n").cast("long").alias("group_size"),
        (F.col("at") == F.col("keep.at")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )
