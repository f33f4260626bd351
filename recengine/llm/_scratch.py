"""Shared scratch tables.

Lineage is cut by writing a table into the folder that the cluster names in
``spark.checkpoint.dir`` and reading it again, so a lost executor costs only the
tasks of the current stage. Where the setting is absent (tests, a laptop) a
temporary folder of the driver is used, which in local mode all tasks share.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
#: Paths made within the open blocks of temporary_tables.
_SCOPES: list[list[str]] = []
#: Tables of such a block after which the driver's garbage is collected; its heap grows with what many jobs leave, and shrinks then.
COLLECT_AFTER = 6


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables, without a trailing slash."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="recengine-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _SCOPES:
        made.append(path)
    return path


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """What is written under the shared folder within this block is deleted after it: results must have been written elsewhere."""
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back with the same schema."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    if any(len(made) % COLLECT_AFTER == 0 for made in _SCOPES):
        spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
