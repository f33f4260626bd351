"""Parts by user: whole users, sorted, so that one task that compacts them reads less."""

import os

from pyspark.sql import functions as F

from recengine.sources import tables as IO


def test_parts_by_user_are_sorted(spark, tmp_path):
    rows = spark.range(40_000).select((F.xxhash64("id") % 3000).alias("user_id"), (F.xxhash64(F.lit(1), "id") % 500).alias("item_id"), F.col("id").alias("ord")).repartition(5)
    parts, whole = (str(tmp_path / n) for n in ("parts", "whole"))
    IO.write_by_user(rows, parts, 3, order=("ord",))
    files = [f.path for f in os.scandir(parts) if f.name.endswith(".parquet")]
    found = [[(r["user_id"], r["ord"]) for r in spark.read.parquet(f).coalesce(1).collect()] for f in files]
    assert len(files) == 3 and all(f == sorted(f) for f in found)
    assert IO.compact(spark, parts, whole) == 40_000
    assert sorted(map(tuple, spark.read.parquet(whole).collect())) == sorted(map(tuple, rows.collect()))
