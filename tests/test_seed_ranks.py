"""Ranks of seeds' neighbors by arrays: the same rows as by windows, and nothing shuffled after the lists."""

import random
import re

import pytest
from pyspark.sql import functions as F

from recengine.operators import candidates as K


@pytest.mark.parametrize(("step", "top"), [(1 << 18, 60), (7, 60), (7, 1 << 61)])
def test_ranks_of_lists_equal_the_windows(spark, monkeypatch, step, top):
    monkeypatch.setattr(K, "STEP_NEIGHBORS", step)
    rng = random.Random(step)
    ids = [*range(-2, 58), top]
    queries = [(f"q{i}", [rng.choice([*ids, None]) for _ in range(rng.randrange(7))]) for i in range(60)] + [("q1", [3, 4]), ("none", []), ("null", None)]
    near = [(source, seed, c, float(-r), r + 1) for source in ("a", "b", "c") for seed in ids if rng.random() < 0.8 for r, c in enumerate(rng.sample(ids, 12))]
    q = spark.createDataFrame(queries, "query_id string, seeds array<long>").repartition(5)
    n = spark.createDataFrame(near, "source string, seed_id long, candidate_id long, score double, rank int")
    rows = lambda d: sorted(map(tuple, d.select("query_id", "source", "candidate_id", "support", "best_rank", "rank").collect()))
    for per_seed, per_source in ((4, 6), (50, 50)):
        found = K.seed_ranks(q, n, per_seed, per_source)
        assert rows(found) == rows(K.source_ranks(K.seed_candidates(q, n, per_seed), per_source)) != []
    assert rows(K.seed_ranks(q, n.limit(0), 4, 6)) == [] == rows(K.seed_ranks(q.limit(0), n, 4, 6))


def test_fused_lists_equal_the_windows(spark):
    rng = random.Random(3)
    queries = [(f"q{i}", [rng.randrange(40) for _ in range(rng.randrange(5))], [rng.randrange(60) for _ in range(3)]) for i in range(50)]
    near = [(source, seed, c, float(-r), r + 1) for source in ("a", "b", "other") for seed in range(40) for r, c in enumerate(rng.sample(range(60), 15))]
    q = spark.createDataFrame(queries, "query_id string, seeds array<long>, truth array<long>").repartition(3)
    n = spark.createDataFrame(near, "source string, seed_id long, candidate_id long, score double, rank int")
    ranks = K.source_ranks(K.seed_candidates(q, n, 9), 12)
    for limit in (None, 7):
        wanted = K.fuse_rrf(K.pivot_ranks(ranks, ("a", "b")), ("a", "b"), limit=limit)
        found = K.fused_lists(K.rank_lists(q, n, 9, 12), ("a", "b"), limit=limit).select("query_id", F.inline("fused")).select(*wanted.columns)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, wanted.collect())) != []
    none = q.limit(0).select("query_id", F.col("seeds").alias("candidate_id")).select("query_id", F.explode("candidate_id").alias("candidate_id"))
    built = K.build_candidates(q, n, ("a", "b"), 9, 12, 7)
    assert sorted(map(tuple, built.collect())) == sorted(map(tuple, K.build_candidates(q, n, ("a", "b"), 9, 12, 7, exclude=none).select(*built.columns).collect()))
    plan = built._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and not re.search(r"hashpartitioning\(query_id#\d+, candidate_id", plan)


def test_overlaps_of_line_ups_equal_the_windows_and_shuffle_no_ranks(spark):
    from recengine.operators import compression as C

    rng = random.Random(5)
    names = ("graph|2", "graph|5", "4|none", "2|fp16")
    q = spark.createDataFrame([(f"q{i}", [rng.randrange(30) for _ in range(rng.randrange(4))]) for i in range(40)], "query_id string, seeds array<long>")
    n = spark.createDataFrame([(s, seed, c, 0.0, r + 1) for s in names for seed in range(30) if rng.random() < 0.7 for r, c in enumerate(rng.sample(range(40), 6))], "source string, seed_id long, candidate_id long, score double, rank int")
    lists, ranks = K.rank_lists(q, n, 5, 5), K.source_ranks(K.seed_candidates(q, n, 5), 5)
    found = C._overlaps(lists, (2, 5), ["4|none", "2|fp16"], "4|none", 3)
    lineups = {}
    for depth in (2, 5):
        for store in ("4|none", "2|fp16"):
            own = (f"graph|{depth}", store)
            for r in K.fuse_rrf(K.pivot_ranks(ranks.where(F.col("source").isin(*own)), own), own, limit=3).collect():
                lineups.setdefault((depth, store), {}).setdefault(r.query_id, set()).add(r.candidate_id)
    whole = lineups[5, "4|none"]
    wanted = {}
    for k, rows in lineups.items():
        shares = [len(x & whole[i]) / len(x | whole[i]) for i, x in rows.items() if i in whole]
        wanted[k] = round(sum(shares) / len(shares), 9)
    assert {(r.depth, r.store): round(r.overlap, 9) for r in found.collect()} == wanted
    assert "hashpartitioning(depth" not in found._jdf.queryExecution().executedPlan().toString() and "candidate_id" not in "".join(re.findall(r"hashpartitioning\([^)]*", found._jdf.queryExecution().executedPlan().toString()))
