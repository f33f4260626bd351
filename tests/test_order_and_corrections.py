"""Percentiles of groups of any size, and popularity under corrections from a stream."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recengine.operators.metrics import latency_summary
from recengine.operators.order import percentiles, running_counts
from recengine.operators.splits import positives
from recengine.streaming import jobs


@pytest.mark.parametrize("by", [[], ["g"], ["g", "h"]])
def test_percentiles_equal_numpy(spark, by):
    rng = np.random.default_rng(len(by))
    rows = [(rng.choice(["a", "b", None]), int(rng.integers(0, 2)), float(rng.choice([1.0, 2.0, rng.normal()]))) for _ in range(500)]
    rows += [("only null", 0, None), ("one", 1, 7.0)]
    table = spark.createDataFrame([(None if g is None else str(g), h, v) for g, h, v in rows], "g string, h int, v double").repartition(7)
    shares = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    got = {tuple(r[c] for c in by): [r[f"p{k}"] for k in range(len(shares))] for r in percentiles(table, "v", shares, by).collect()}
    groups = {}
    for g, h, v in rows:
        if v is not None:
            groups.setdefault(tuple({"g": None if g is None else str(g), "h": h}[c] for c in by), []).append(v)
    assert got.keys() == groups.keys()
    for k, values in groups.items():
        assert np.allclose(got[k], np.quantile(values, shares), atol=1e-12)


def test_one_group_of_all_rows_is_counted_by_many_tasks(spark):
    counts = spark.range(20_000).select(F.lit("all").alias("g"), F.col("id").alias("v"), F.lit(2).cast("long").alias("n"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = running_counts(counts, ["g"], "v")
        tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count(F.lit(1)).alias("n")).collect()
        assert len(tasks) > 1 and max(t["n"] for t in tasks) < 20_000
        assert rows.where("before <> 2 * v or place <> v or whole <> 40000 or distinct <> 20000").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_latency_summary_of_null_and_missing_groups(spark):
    table = spark.createDataFrame([(None, 1.0), (None, 3.0), ("x", None)], "g string, v double")
    got = {r["g"]: (r["n"], r["mean"], r["max"], r["p50"]) for r in latency_summary(table, "v", ("g",)).collect()}
    assert got == {None: (2, 2.0, 3.0, 2.0), "x": (0, None, None, None)}
    assert latency_summary(table.limit(0), "v", ("g",)).collect() == []


def test_corrected_popularity_equals_the_batch(spark, tmp_path):
    rng = random.Random(4)
    schema = "user_id long, item_id long, rating double, ts long, ord long"
    rows = [(rng.randint(1, 12), rng.randint(-1, 9), rng.choice([1.0, 2.5, 3.0, 5.0, None]), rng.randint(0, 40), rng.randint(0, 5)) for _ in range(400)]
    rows += rows[:30]  # repeated events
    arrivals = [rows[150:300], rows[:150], rows[300:]]  # late ones among them
    source, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    seen = []
    for part in arrivals:
        seen += part
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            jobs.run_corrected_popularity(spark.readStream.schema(schema).parquet(source), target, checkpoint)
        got = {r["item_id"]: r["popularity"] for r in jobs.corrected_popularity(spark, target).collect()}
        batch = positives(spark.createDataFrame(seen, schema)).where("item_id > 0").groupBy("item_id").count().collect()
        assert got == {r["item_id"]: r["count"] for r in batch}


def test_corrections_run_without_python(spark, tmp_path):
    schema = "user_id long, item_id long, rating double, ts long, ord long"
    rows = spark.range(60_000).select((F.col("id") % 600).alias("user_id"), (F.col("id") % 97 + 1).alias("item_id"), (F.col("id") % 6).cast("double").alias("rating"), (F.col("id") * 7919 % 1000).alias("ts"), F.col("id").alias("ord"))
    source, target, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "out", "state"))
    for part in (0, 1):
        rows.where(F.col("ord") % 2 == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.run_corrected_popularity(stream, target, checkpoint)
    plan = jobs.latest_signs(stream)._jdf.queryExecution().analyzed().toString()
    assert "Aggregate" in plan and "TransformWithState" not in plan and "Python" not in plan
    got = {r["item_id"]: r["popularity"] for r in jobs.corrected_popularity(spark, target).collect()}
    assert got == {r["item_id"]: r["count"] for r in positives(rows).groupBy("item_id").count().collect()}
