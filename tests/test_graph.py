"""The tiled item graph against brute force, with a very long history."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recengine.operators import neighbors as N


def brute_graph(pairs, k, seeds=None, k1=1.2, b=0.75):
    cells = set(pairs)
    per_user, users = defaultdict(list), Counter(i for _, i in cells)
    for u, i in cells:
        per_user[u].append(i)
    average = len(cells) / len(users)
    weight = lambda u, i: (k1 + 1) / (k1 * (1 - b + b * users[i] / average) + 1) * (math.log(len(users)) - math.log(1 + len(per_user[u])))
    score = defaultdict(float)
    for u, items in per_user.items():
        w = {i: weight(u, i) for i in items}
        for i in items:
            if seeds is None or i in seeds:
                for j in items:
                    if i != j:
                        score[i, j] += w[i] * w[j]
    out = defaultdict(list)
    for (i, j), s in score.items():
        out[i].append((-round(s, 9), j))
    return {(i, j): (-s, r + 1) for i, rows in out.items() for r, (s, j) in enumerate(sorted(rows)[:k])}


@pytest.mark.parametrize("blocks,pairs_at_once", [((1, 1), 1 << 21), ((3, 2), 64), ((7, 5), 1000), (None, 1 << 21)])
def test_graph_equals_brute_force(spark, monkeypatch, blocks, pairs_at_once):
    monkeypatch.setattr(N, "TILE_PAIRS", pairs_at_once)
    rng = np.random.default_rng(11)
    pairs = [(int(u), int(i)) for u in range(60) for i in rng.zipf(1.3, rng.integers(1, 30)) % 90 + 1]
    pairs += [(1000, i) for i in range(1, 91)] + pairs[:50]  # one user with everything; repeated events
    table = spark.createDataFrame(pairs, "user_id long, item_id long")
    got = {(r["seed_id"], r["candidate_id"]): (r["score"], r["rank"]) for r in N.item_graph(table, 9, blocks=blocks).collect()}
    expected = brute_graph(pairs, 9)
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in expected.items()}
    assert all(abs(got[k][0] - v[0]) < 1e-8 for k, v in expected.items())
    seeds = {1, 2, 50, 90, 777}
    asked = spark.createDataFrame([(s,) for s in seeds], "seed_id long")
    some = {(r["seed_id"], r["candidate_id"]): r["rank"] for r in N.item_graph(table, 9, seeds=asked, blocks=blocks).collect()}
    assert some == {k: v[1] for k, v in brute_graph(pairs, 9, seeds).items()}
    assert N.item_graph(table.limit(0), 9).collect() == []


def test_a_very_long_history_is_shared_by_the_tiles(spark):
    """20,000 items of one user: its pairs are dealt out evenly, and no row holds more than a block of them."""
    one = spark.range(1, 20_001).select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("item_id"), F.lit(1.0).alias("weight"))
    rows = N.graph_tiles(one, one, 16, 4)
    tiles = rows.groupBy("seed_block", "item_block").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.size("seeds").cast("long") * F.size("items")).alias("pairs")).collect()
    assert len(tiles) == 64 and all(t["rows"] == 1 for t in tiles)
    assert sum(t["pairs"] for t in tiles) == 20_000**2 and max(t["pairs"] for t in tiles) < 1.2 * 20_000**2 / 64


def test_short_histories_need_one_block_of_candidates(spark, monkeypatch):
    """The tiles follow pairs and histories, not the number of items; with one block of candidates nothing is shuffled after them."""
    table = spark.createDataFrame([(u, int(i)) for u in range(40) for i in np.random.default_rng(u).integers(1, 400, 6)], "user_id long, item_id long")
    seen, make = [], N.graph_tiles
    monkeypatch.setattr(N, "graph_tiles", lambda a, w, *blocks: seen.append(blocks) or make(a, w, *blocks))
    expected = brute_graph([tuple(r) for r in table.collect()], 5)
    for longest, wide in ((4096, 1), (2, 3)):
        monkeypatch.setattr(N, "LIST_ITEMS", longest)
        graph = N.item_graph(table, 5)
        assert seen[-1][1] == wide
        assert ("Window" in graph._jdf.queryExecution().executedPlan().toString()) == (wide > 1)
        assert {(r["seed_id"], r["candidate_id"]): r["rank"] for r in graph.collect()} == {k: v[1] for k, v in expected.items()}
