"""Sources and sinks: raw CSV files, catalogs, interactions, compaction, incremental ingest, fingerprints and manifests."""

from __future__ import annotations

import json
import re
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.schemas import RAW, ContractError, assert_columns


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, through the cluster's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, through the cluster's file system."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def read_raw_csv(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The four raw files as text columns named as in their headers; a missing file or column is an error.

    Values stay text: ``schemas.to_integer`` decides what is malformed.
    """
    out = {}
    for name, schema in RAW.items():
        path = f"{folder}/{name}.csv"
        if not exists(spark, path):
            raise FileNotFoundError(path)
        header = spark.read.option("header", True).csv(path)
        out[name] = assert_columns(header, schema).select(*schema.names)
    return out


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """The enriched catalog; it must have movie_id and tmdb_id."""
    return assert_columns(spark.read.parquet(path), ["movie_id", "tmdb_id"])


def read_interactions(spark: SparkSession, path: str, columns: tuple[str, ...] = ("user_id", "item_id", "rating")) -> DataFrame:
    """A scan of these columns only; an empty table is an error."""
    df = assert_columns(spark.read.parquet(path), list(columns)).select(*columns)
    if not df.take(1):
        raise ContractError(f"{path} has no interactions")
    return df


def write_table(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet with zstd level 3. The job's commit makes it visible at once; an existing table is never overwritten by default."""
    df.write.mode(mode).option("compression", "zstd").option("parquet.compression.codec.zstd.level", "3").parquet(path)


def write_by_user(df: DataFrame, path: str, parts: int, mode: str = "errorifexists", order: tuple[str, ...] = ()) -> None:
    """All rows of a user in one file and in a row there, by ``order``: so the columns compress well. Users are dealt out over ``parts`` files by hash."""
    write_table(df.repartition(parts, "user_id").sortWithinPartitions("user_id", *order), path, mode)


def write_bucketed(df: DataFrame, path: str, by: str, buckets: int, order: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as a table of ``buckets`` buckets by a hash of ``by``, each sorted by it and ``order``; the table is read back.

    Windows, aggregates and joins on ``by`` of tables with equally many buckets need no
    shuffle any more: the one that writes the buckets is the last. The table is known to
    this session under a name made from the path, which ``drop_bucketed`` forgets.
    """
    name = bucketed_name(path)
    df.repartition(buckets, by).write.format("parquet").bucketBy(buckets, by).sortBy(by, *order).option("path", path).mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def bucketed_name(path: str) -> str:
    return "bucketed_" + re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1])


def drop_bucketed(spark: SparkSession, path: str) -> None:
    """Forget a bucketed table and delete its files."""
    spark.sql(f"DROP TABLE IF EXISTS {bucketed_name(path)}")
    remove(spark, path)


def compact(spark: SparkSession, pattern: str, path: str, files: int = 1) -> int:
    """Rewrite the part files of ``pattern`` as ``files`` files; the row count. No part or no row is an error."""
    df = spark.read.parquet(pattern)
    n = df.count()
    if not n:
        raise ContractError(f"{pattern} has no rows to compact")
    write_table(df.coalesce(files), path)
    return n


def merge_batches(spark: SparkSession, pattern: str, schema: T.StructType | None = None) -> DataFrame:
    """All batch files of ``pattern`` as one table, repeated rows included.

    With a schema every file must have exactly its columns (the footers are read one
    by one, some at a time); without one columns are matched by name and missing ones are null.
    """
    if schema is None:
        return spark.read.option("mergeSchema", True).parquet(pattern)
    files = spark.read.parquet(pattern).inputFiles()
    with ThreadPoolExecutor(16) as pool:
        for found in pool.map(lambda f: spark.read.parquet(f), files):
            assert_columns(found, schema, exact=True)
    found = spark.read.option("mergeSchema", True).parquet(pattern)
    return found.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def unprocessed(incoming: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of ``incoming`` whose key isn't in ``done``: what a resumed job has left."""
    return incoming.join(done.select(key).distinct(), key, "left_anti")


def settings_json(settings: dict) -> str:
    return json.dumps({k: str(v) for k, v in settings.items()}, sort_keys=True)


def claim_state(spark: SparkSession, path: str, settings: dict) -> bool:
    """Whether ``path`` holds the state of an earlier run with these settings; a new one is begun, and one of another run is an error."""
    wanted = settings_json(settings)
    if not exists(spark, f"{path}/settings"):
        spark.createDataFrame([(wanted,)], "settings string").coalesce(1).write.parquet(f"{path}/settings")
        return False
    known = spark.read.parquet(f"{path}/settings").first()["settings"]
    if known != wanted:
        raise ContractError(f"the state at {path} belongs to another run: {known}")
    return True


def ingest(spark: SparkSession, incoming: DataFrame, target: str, state: str, key: str, settings: dict) -> DataFrame:
    """Append the rows of ``incoming`` that no earlier run with this state has written; the table so far.

    A run writes its rows under its own number first and then records their keys; a
    run that was cut off in between is written again under the same number, so no row
    is lost or doubled. The state of a run with other settings is an error.
    """
    claim_state(spark, state, settings | {"target": target, "key": key})
    keys = f"{state}/keys"
    done = spark.read.parquet(keys) if exists(spark, keys) else None
    run = done.select(F.coalesce(F.max("run"), F.lit(-1)) + 1).first()[0] if done is not None else 0
    todo = unprocessed(incoming, done, key) if done is not None else incoming
    write_table(todo, f"{target}/run={run}", "overwrite")
    new = spark.read.parquet(f"{target}/run={run}")
    new.select(key, F.lit(run).cast("int").alias("run")).distinct().write.mode("append").parquet(keys)
    return spark.read.parquet(target).drop("run")


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, content: a hash of the content in which the order of rows doesn't count and repeated rows do."""
    row = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row.cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"))


def _files(spark: SparkSession, path: str) -> dict[str, tuple[int, int]]:
    """Size and time of change of each data file below a path, from the file system alone."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base, out = system.makeQualified(root).toUri().getPath().rstrip("/"), {}
    found = system.listFiles(root, True)
    while found.hasNext():
        f = found.next()
        name = f.getPath().toUri().getPath()[len(base) + 1 :]
        if not any(part.startswith(("_", ".")) for part in name.split("/")):
            out[name] = (f.getLen(), f.getModificationTime())
    return out


_FILE = "file string, size long, changed long"


def file_fingerprints(spark: SparkSession, path: str, only: list[str] | None = None) -> DataFrame:
    """file, size, changed, rows, content of the Parquet files below a path: the fingerprint of each file, which add up to the table's.

    ``only``: names of the files to read (all by default). Their rows are hashed in one
    job; a file without rows has content 0.
    """
    listed = {f: x for f, x in _files(spark, path).items() if only is None or f in only}
    files = spark.createDataFrame([(f, *x) for f, x in sorted(listed.items())], _FILE)
    if not listed:
        return files.withColumn("rows", F.lit(0).cast("long")).withColumn("content", F.lit("0"))
    read = spark.read.option("basePath", path).parquet(*[f"{path.rstrip('/')}/{f}" for f in sorted(listed)])
    own = set(spark.read.parquet(f"{path.rstrip('/')}/{min(listed)}").columns)  # without what folders are named for
    row = F.xxhash64(*[F.col(c) for c in sorted(own)]).cast("decimal(38,0)")
    hashed = read.groupBy(F.col("_metadata.file_path").alias("where")).agg(F.count(F.lit(1)).alias("rows"), F.sum(row).cast("string").alias("content"))
    hashed = hashed.withColumn("where", F.url_decode(F.regexp_replace("where", r"\+", "%2B")))
    joined = files.join(hashed, F.endswith("where", F.concat(F.lit("/"), "file")), "left")  # one row a file on either side
    return joined.select("file", "size", "changed", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("content", F.lit("0")).alias("content"))


def table_content(files: DataFrame) -> DataFrame:
    """rows, content of the whole table from the fingerprints of its files, as ``fingerprint`` gives them."""
    return files.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum(F.col("content").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("content"))


def changed_parts(spark: SparkSession, path: str, known: DataFrame) -> DataFrame:
    """part, status (same, touched, changed, added or removed), rows, read: the folders of files below a path against ``known`` fingerprints of files.

    Only files that are new, or whose size or time of change differs, are read; ``read``
    counts them. A part whose files are others but hold the same rows is ``touched``.
    """
    before = {r["file"]: r for r in known.collect()}  # one row a file
    now = _files(spark, path)
    suspects = [f for f, x in now.items() if f not in before or (before[f]["size"], before[f]["changed"]) != x]
    fresh = {r["file"]: r for r in file_fingerprints(spark, path, suspects).collect()}
    of = lambda names: {p: [f for f in names if f.rpartition("/")[0] == p] for p in {f.rpartition("/")[0] for f in names}}
    old, new, rows = of(before), of(now), []
    total = lambda found: (sum(r["rows"] for r in found), sum(int(r["content"]) for r in found))
    for p in sorted({*old, *new}):
        was, is_ = total([before[f] for f in old.get(p, [])]), total([fresh.get(f) or before[f] for f in new.get(p, [])])
        read = sum(f in fresh for f in new.get(p, []))
        moved = read or set(old.get(p, [])) != set(new.get(p, []))
        status = "removed" if p not in new else "added" if p not in old else "same" if not moved else "touched" if was == is_ else "changed"
        rows.append((p, status, was[0] if p not in new else is_[0], read))
    return spark.createDataFrame(rows, "part string, status string, rows long, read long")


def manifest(name: str, df: DataFrame, **config: str) -> DataFrame:
    """One row: name, rows, columns, content and the settings as JSON."""
    settings = F.to_json(F.create_map(*[x for k in sorted(config) for x in (F.lit(k), F.lit(str(config[k])))])) if config else F.lit("{}")
    return fingerprint(df).select(F.lit(name).alias("name"), "rows", F.lit(len(df.columns)).alias("columns"), "content", settings.alias("settings"))
