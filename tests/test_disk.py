"""What a query leaves on disk and moves: shuffles end with the table they were made for, lists and bins travel instead of rows."""

import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from recengine.operators import boosting as B
from recengine.operators import candidates as K
from recengine.operators import embedding as M
from recengine.operators import lineup as L
from recengine.operators import metrics as E
from recengine.operators import neighbors as N
from recengine.operators.fitting import fit_als
from recengine.sources import scratch
from recengine.sources.tables import exists


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().rpartition("== Initial Plan ==")[2]


def _shuffled(spark) -> int:
    found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(found.apply(i).getName().startswith("shuffle_") for i in range(found.size()))


def test_a_written_table_leaves_no_shuffle(spark):
    before = _shuffled(spark)
    table = scratch.written(spark.range(5000).repartition(7, "id").groupBy((F.col("id") % 50).alias("k")).count(), "counts")
    for _ in range(50):
        if _shuffled(spark) <= before:
            break
        time.sleep(0.1)
    assert _shuffled(spark) <= before and table.count() == 50
    folder = table.inputFiles()[0].rsplit("/", 1)[0]
    scratch.discard(table)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(folder)


@pytest.mark.parametrize("blocks,shift", [((3, 1), 0), ((3, 2), 0), ((2, 1), 1 << 33)])
def test_lists_give_the_same_candidates_as_rows(spark, blocks, shift):
    rng = np.random.default_rng(3)
    table = spark.createDataFrame([(int(u), int(i) + shift) for u in range(50) for i in rng.zipf(1.4, 9) % 60], "user_id long, item_id long")
    rows, lists = N.item_graph(table, 6, blocks=blocks), N.item_graph(table, 6, blocks=blocks, lists=True)
    expected = {}
    for r in sorted(rows.collect(), key=lambda r: r["rank"]):
        expected.setdefault(r["seed_id"], []).append(r["candidate_id"])
    assert {r["seed_id"]: r["near"] for r in lists.collect()} == expected
    short = K.narrowed(lists)
    assert dict(short.dtypes)["near"] == ("array<bigint>" if shift else "array<smallint>")
    queries = spark.createDataFrame([(f"q{q}", [int(x) + shift for x in rng.integers(0, 60, 4)]) for q in range(20)], "query_id string, seeds array<long>")
    found = K.seed_candidates(queries, short, 5)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, K.seed_candidates(queries, rows, 5).collect()))
    assert dict(found.dtypes)["candidate_id"] == "bigint"


def test_lineups_are_shuffled_by_request_alone(spark):
    requests = spark.createDataFrame([("a", [1, 2, 2]), ("b", [3]), ("c", [])], "request_id string, seeds array<long>")
    lineups = spark.createDataFrame([("a", 2), ("a", 2), ("a", 9), ("b", -1), ("b", None), ("x", 3)], "request_id string, candidate_id long")
    checked = L.check_recommendations(requests, lineups, 2)
    assert sorted(map(tuple, checked.collect())) == [("a", True, False, True, False, False), ("b", True, True, False, False, True), ("c", False, True, True, True, True)]
    assert not re.search(r"hashpartitioning\(request_id#\d+, candidate_id", _plan(checked)) and _plan(checked).count("candidate_id") > 0


def test_sources_are_marked_without_a_shuffle(spark):
    rows = [("q", "a", 1, 1), ("q", "b", 1, 2), ("q", "a", 2, 2), ("r", "b", 5, 1), ("r", "c", 6, 1)]
    ranks = spark.createDataFrame(rows, "query_id string, source string, candidate_id long, rank int").repartition(3, "query_id")
    marked = E.marked_sources(ranks, "a", "b")
    assert sorted(map(tuple, marked.collect())) == [("q", 1, 1, 1), ("q", 2, 1, 0), ("r", 5, 0, 1)]
    assert _plan(marked).count("Exchange hashpartitioning") == 1
    of = lambda s: ranks.where(F.col("source") == s)
    queries = spark.createDataFrame([("q",), ("r",), ("s",)], "query_id string")
    assert sorted(map(tuple, E.source_lineup_overlap(ranks, "a", "b", (1, 2), queries).collect())) == sorted(map(tuple, E.lineup_overlap(of("a"), of("b"), (1, 2), queries).collect()))


def test_a_report_is_shuffled_once_for_all_orderings(spark):
    rows = spark.createDataFrame([(f"q{i % 4}", i, int(i % 3 == 0), float(i % 5)) for i in range(40)], "query_id string, candidate_id long, label int, s double")
    report = E.ranking_report(rows, {"up": F.col("s"), "down": -F.col("s")})
    assert not re.search(r"hashpartitioning\(ordering#\d+, query_id", _plan(report))
    assert {(r["ordering"], r["k"], r["queries"]) for r in report.collect()} == {(o, k, 4) for o in ("up", "down") for k in (5, 10)}


def test_bins_are_shuffled_instead_of_features(spark, monkeypatch):
    names = [f"f{k}" for k in range(10)]
    rng = np.random.default_rng(5)
    rows = [(f"q{i % 6}", i, int(rng.random() < 0.3), *(float(x) for x in rng.integers(0, 7, 10))) for i in range(80)]
    table = spark.createDataFrame(rows, "query_id string, candidate_id long, label int, " + ", ".join(f"{n} float" for n in names)).repartition(3)
    bins = B.Bins.of(table, names)
    made = []
    monkeypatch.setattr(B, "written", lambda df, name: made.append(df) or df)
    packed = B.pack(table, bins, "query_id", "rows")
    moved = re.search(r"Exchange hashpartitioning\(q#[\s\S]*?MapInArrow", _plan(made[0]))
    assert moved and "x0" not in moved[0]
    found = sorted((list(np.frombuffer(r["label"], np.int32)), np.frombuffer(r["bins"], np.uint8).reshape(r["n"], 10).tolist()) for r in packed.collect())
    wanted = [[r for r in rows if r[0] == f"q{q}"] for q in range(6)]
    assert found == sorted(([r[2] for r in own], [[int(bins.place(k, np.array([r[3 + k]]))[0]) for k in range(10)] for r in own]) for own in wanted)


def test_one_state_of_the_embeddings_is_kept(spark, monkeypatch):
    made, write = [], M.written
    monkeypatch.setattr(M, "written", lambda df, name: made.append((name, write(df, name))) or made[-1][1])
    events = spark.createDataFrame([(i % 12 + 1,) for i in range(60)], "item_id long")
    pairs = spark.createDataFrame([(i % 12 + 1, (i + 1) % 12 + 1) for i in range(40)], "query_id long, candidate_id long")
    vectors = M.fit_item_embeddings(pairs, events, dim=4, epochs=2, parts=3)
    states = [t.inputFiles()[0].rsplit("/", 1)[0] for name, t in made if name == "embedding-rows"]
    there = [exists(spark, p) for p in states]
    assert len(states) == 7 and there == [False] * 6 + [True] and vectors.count() == 12


def test_als_deletes_what_earlier_iterations_shuffled(spark):
    before = _shuffled(spark)
    events = spark.createDataFrame([(u, (u * 7 + k * k) % 23 + 1, 4.0) for u in range(40) for k in range(6)], "user_id long, item_id long, rating double")
    vectors = fit_als(events, factors=4, iterations=16)
    for _ in range(50):
        if _shuffled(spark) - before < 200:
            break
        time.sleep(0.2)
    assert _shuffled(spark) - before < 200  # 10 blocks of two files each for items and for users, so 640 in all
    assert vectors.count() == vectors.select("item_id").distinct().count() == events.select("item_id").distinct().count()
