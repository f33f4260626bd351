"""Dataset jobs, resumable ingest, strict batches and the request path on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from recengine import schemas
from recengine.operators import datasets as O
from recengine.operators import features as Z
from recengine.operators import fitting as M
from recengine.operators import lineup as L
from recengine.operators import metrics as E
from recengine.operators import splits as P
from recengine.sources import tables as IO

EVENTS = "user_id long, item_id long, rating double, ts long, ord long"


def some_events(spark, users=12, items=40, each=20, seed=3):
    rng = random.Random(seed)
    rows = [(u, rng.randint(1, items), rng.choice([2.0, 3.5, 4.0, 5.0]), rng.randint(0, 400), k) for u in range(1, users + 1) for k in range(each)]
    return spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("strategy", O.STRATEGIES)
def test_split_dataset_writes_all_tables_and_rejects_other_input(spark, tmp_path, strategy):
    x, path = some_events(spark), f"file://{tmp_path}/d"
    out = O.split_dataset(x, path, strategy)
    m = out["manifest"].first()
    parts = {r["part"]: r["rows"] for r in P.split_counts(out["split"]).collect()}
    assert (m["status"], m["strategy"], m["positive_rows"]) == ("complete", strategy, P.positives(x).count())
    assert {p: m[f"{p}_rows"] for p in parts} == parts and m["eligible_users"] == out["validation"].count() == out["test"].count()
    assert out["test"].where("history_end_ts >= truth_start_ts").count() == 0
    again = O.split_dataset(x, path, strategy)
    assert again["manifest"].collect() == out["manifest"].collect()
    with pytest.raises(schemas.ContractError, match="another run"):
        O.split_dataset(x.where("user_id > 2"), path, strategy)
    with pytest.raises(schemas.ContractError):
        O.split_dataset(x.limit(0), f"file://{tmp_path}/none", strategy)


def test_prepare_ranking_drops_repeated_and_low_events_again(spark, tmp_path):
    rows = [(1, k, 5.0, k, k) for k in range(1, 11)] + [(1, 3, 1.0, 50, 60), (2, 1, 5.0, 1, 70)]
    out = O.prepare_ranking(spark.createDataFrame(rows, EVENTS), f"file://{tmp_path}/r", seed_count=2)
    history, targets = (sorted(r.item_id for r in out[n].collect()) for n in ("history", "targets"))
    assert history == [1, 2, 4, 5, 6, 7, 8] and targets == [9, 10]
    q = out["queries"].first()
    assert (q.query_id, q.seeds, q.truth) == ("ranking:1", [7, 8], [9, 10])
    m = out["manifest"].first()
    assert (m["eligible_users"], m["excluded_users"], m["history_rows"], m["target_rows"]) == (1, 1, 7, 2)


def test_ingest_goes_on_after_a_run_that_was_cut_off(spark, tmp_path):
    x = spark.createDataFrame([(k, f"v{k}") for k in range(10)], "k long, v string")
    target, state = f"file://{tmp_path}/t", f"file://{tmp_path}/s"
    IO.ingest(spark, x.where("k < 4"), target, state, "k", {"a": 1})
    IO.write_table(x.where("k >= 4"), f"{target}/run=1")  # written, but its keys aren't recorded
    out = IO.ingest(spark, x, target, state, "k", {"a": 1})
    assert sorted(r.k for r in out.collect()) == list(range(10))
    assert sorted(r.k for r in IO.ingest(spark, x, target, state, "k", {"a": 1}).collect()) == list(range(10))
    with pytest.raises(schemas.ContractError, match="another run"):
        IO.ingest(spark, x, target, state, "k", {"a": 2})


def test_strict_batches_look_at_every_file(spark, tmp_path):
    schema = schemas.T.StructType([schemas.T.StructField("a", schemas.T.LongType()), schemas.T.StructField("b", schemas.T.LongType())])
    spark.createDataFrame([(1, 2)], "a long, b long").write.parquet(f"{tmp_path}/movies_batch_0")
    assert IO.merge_batches(spark, f"{tmp_path}/movies_batch_*", schema).count() == 1
    spark.createDataFrame([(1,)], "a long").write.parquet(f"{tmp_path}/movies_batch_1")
    with pytest.raises(schemas.ContractError):
        IO.merge_batches(spark, f"{tmp_path}/movies_batch_*", schema)
    assert IO.merge_batches(spark, f"{tmp_path}/movies_batch_*").where("b is null").count() == 1


def test_integers_are_exact_over_64_bits(spark):
    values = ["9007199254740993", "-9223372036854775808", "9223372036854775807", "12.0", "1e3", "9223372036854775808", "x", "", "Infinity", None]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r.n for r in df.select(schemas.to_integer(F.col("v"), nullable=True).alias("n")).collect()] == [9007199254740993, -(2**63), 2**63 - 1, 12, 1000, None, None, None, None, None]
    r = schemas.integer_report(df.unionByName(spark.createDataFrame([("0.5",)], "v string")), ["v"]).first()
    assert (r.malformed, r.fractional, r.missing) == (4, 1, 1)


def test_dense_index_of_sparse_and_text_ids(spark):
    ids = [k * 1_000_003 + 17 for k in range(500)]
    got = Z.dense_index(spark.createDataFrame([(i,) for i in ids + ids[:9] + [None]], "item_id long")).collect()
    assert sorted((r.item_id, r.item_index) for r in got) == list(zip(ids, range(500), strict=True))
    text = Z.dense_index(spark.createDataFrame([("b",), ("a",), ("c",)], "item_id string")).collect()
    assert {r.item_id: r.item_index for r in text} == {"a": 0, "b": 1, "c": 2}


def test_popular_items_go_on_where_seeds_are_popular(spark):
    counts = spark.createDataFrame([(k, 100 - k) for k in range(1, 30)], "item_id long, popularity long")
    q = spark.createDataFrame([("a", [1, 2, 2, 7]), ("b", [50]), ("c", []), ("d", list(range(1, 12)))], "query_id string, seeds array<long>")
    got = {}
    for r in Z.recommend_popular(q, counts, 5).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append(r.candidate_id)
    assert got == {"a": [3, 4, 5, 6, 8], "b": [1, 2, 3, 4, 5], "c": [1, 2, 3, 4, 5], "d": [12, 13, 14, 15, 16]}


def test_ranker_stops_early_and_beats_rrf_on_planted_candidates(spark):
    rng = random.Random(5)

    def candidates(name, n):
        rows = []
        for q in range(n):
            for c in range(20):
                popular = rng.random()
                hit = int(rng.random() < (0.7 if popular > 0.85 else 0.04))
                rows.append((f"{name}{q}", c, hit, float(rng.randint(0, 2)), float(rng.randint(0, 20)), 0.0, float(rng.randint(0, 20)), 0.0, float(int(popular * 100)), popular))
        return spark.createDataFrame(rows, "query_id string, candidate_id long, label int, source_count float, item_graph_rank float, item_graph_rr float, content_rank float, content_rr float, popularity float, log_popularity float")

    names, history = list(Z.feature_columns(("item_graph", "content"))), []
    model = M.fit_ranker(candidates("t", 80), names, candidates("v", 30), rounds=40, rate=0.3, depth=3, patience=4, history=history)
    assert 1 <= len(model.trees) == history.index(max(history)) + 1 and (len(history) == 40 or len(history) == len(model.trees) + 4)
    report = {(r.ordering, r.k): r.ndcg for r in M.evaluate_heldout(model, candidates("h", 60)).collect()}
    assert report["model", 10] > report["rrf", 10] + 0.1
    with pytest.raises(ValueError):
        M.fit_ranker(candidates("t", 2).drop("popularity"), names)


def test_lineup_fills_up_with_items_that_can_be_shown(spark):
    near = spark.createDataFrame([("content", 1, c, 1.0 / c, c - 1) for c in range(2, 30)], "source string, seed_id long, candidate_id long, score double, rank int")
    catalog = spark.createDataFrame([(c, f"t{c}", None if c % 2 else f"/p{c}") for c in range(1, 30)], "item_id long, title string, poster_path string")
    requests = spark.createDataFrame([("r", [1, 4]), ("s", [99])], "request_id string, seeds array<long>")
    model = M.Ranker(["content_rank"], 1.0, ["-content_rank"])
    got = L.lineup(requests, near, spark.createDataFrame([(2, 5)], "item_id long, popularity long"), model, catalog, 5, ("content",)).orderBy("position").collect()
    assert [(r.request_id, r.candidate_id, r.title) for r in got] == [("r", c, f"t{c}") for c in (2, 6, 8, 10, 12)]


def test_fusion_report_has_the_overlap(spark):
    ranks = spark.createDataFrame([("q", "a", 1, 1), ("q", "a", 2, 2), ("q", "b", 2, 1), ("q", "b", 3, 2)], "query_id string, source string, candidate_id long, rank int")
    q = spark.createDataFrame([("q", [3]), ("z", [9])], "query_id string, truth array<long>")
    got = {r.system: r for r in E.fusion_evaluation(ranks, q, "a", "b", (2,)).collect()}
    assert {k: r.recall for k, r in got.items()} == {"a": 0.0, "b": 0.5, "fused": 0.0} and {(r.shared_rate, round(r.mean_jaccard, 6)) for r in got.values()} == {(0.5, round(1 / 6, 6))}
