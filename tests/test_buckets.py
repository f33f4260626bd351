"""Jobs on a bucketed table of events plan no shuffle by user."""

import random

from pyspark.sql import functions as F

from recengine.operators import splits as P
from recengine.sources import tables as IO


def test_jobs_by_user_need_no_shuffle(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randint(1, 40), rng.randint(1, 200), rng.choice([1.0, 3.0, 4.5]), rng.randint(0, 500), k) for k in range(3000)]
    plain = spark.createDataFrame(rows, "user_id long, item_id long, rating double, ts long, ord long")
    path = f"file://{tmp_path}/events_by_user"
    table = IO.write_bucketed(plain, path, "user_id", 6, ("ts",))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        latest, pos = P.latest_events(table), P.positives(table)
        split = P.split_per_user(pos)
        jobs = {
            "latest": (latest, P.latest_events(plain)),
            "split": (split, P.split_per_user(P.positives(plain))),
            "records": (P.query_records(split, "test"), P.query_records(P.split_per_user(P.positives(plain)), "test")),
            "pairs": (P.adjacent_pairs(split), P.adjacent_pairs(P.split_per_user(P.positives(plain)))),
            "join": (table.join(latest.select("user_id", F.col("item_id").alias("other")), "user_id"), plain.join(P.latest_events(plain).select("user_id", F.col("item_id").alias("other")), "user_id")),
        }
        for name, (fast, slow) in jobs.items():
            assert "Exchange" in slow._jdf.queryExecution().executedPlan().toString(), name
            assert "Exchange" not in fast._jdf.queryExecution().executedPlan().toString(), name
            assert sorted(map(str, fast.select(*slow.columns).collect())) == sorted(map(str, slow.collect())), name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        IO.drop_bucketed(spark, path)
    assert not IO.exists(spark, path) and not spark.catalog.tableExists(IO.bucketed_name(path))
