"""Exact nearest neighbours by blocks against brute force, and the products they take."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from recengine.operators import neighbors as N


def clustered(rng, n, clusters, dim=8, spread=0.02):
    centres = rng.normal(size=(clusters, dim))
    return centres[rng.integers(0, clusters, n)] + rng.normal(size=(n, dim)) * spread


def brute(ids, x, k, metric, asked=None):
    if metric == "cosine":
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        x = np.divide(x, norm, out=x.copy(), where=norm > 0)
    scores = np.round(x @ x.T, 9)
    out = {}
    for i in range(len(ids)):
        if asked is None or ids[i] in asked:
            order = [j for j in np.lexsort((ids, -scores[i])) if ids[j] != ids[i]][:k]
            out[int(ids[i])] = [int(ids[j]) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("seed_id", "rank").collect():
        out.setdefault(r["seed_id"], []).append(r["candidate_id"])
    return out


@pytest.mark.parametrize("metric", ["cosine", "inner"])
@pytest.mark.parametrize("block", [20, 100, 4096])
def test_nearest_equals_brute_force(spark, monkeypatch, metric, block):
    monkeypatch.setattr(N, "BLOCK_ROWS", block)
    monkeypatch.setattr(N, "LEAST_QUERY_ROWS", 30)
    rng = np.random.default_rng(block)
    x = np.r_[clustered(rng, 300, 12), np.zeros((3, 8)), np.ones((150, 8)), rng.normal(size=(40, 8)) * 5]  # ties, zero vectors, one vector of many rows
    ids = rng.permutation(10_000)[: len(x)] + 1
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "item_id long, vector array<double>").repartition(3)
    assert found(N.nearest(table, 7, "s", metric)) == brute(ids, x, 7, metric)
    some = {int(i) for i in ids[:25]}
    asked = table.where(F.col("item_id").isin(list(some)))
    assert found(N.nearest(table, 7, "s", metric, asked)) == brute(ids, x, 7, metric, some)


def test_products_grow_less_than_rows_squared_on_clusters(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 50)
    rng = np.random.default_rng(1)
    products = []
    for n in (1000, 4000):
        x = clustered(rng, n, n // 50)
        table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>")
        work = []
        N.nearest(table, 5, "s", work=work).count()
        products.append(sum(d.select((F.col("queries") * F.col("rows")).alias("p")).agg(F.sum("p")).first()[0] or 0 for d in work))
        assert products[-1] < n * n / 3
    assert products[1] < 8 * products[0]  # 16 times as many pairs


def test_vectors_move_once_for_each_chunk_of_queries(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 40), ("LEAST_QUERY_ROWS", 10), ("CHUNK_QUERIES", 150), ("CHUNK_ROWS", 200), ("STEP_PRODUCTS", 500)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 8))  # no clusters: all blocks are visited
    table = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>")
    kept = N.written
    stored = {}
    monkeypatch.setattr(N, "written", lambda df, name: stored.setdefault(name, kept(df, name)))
    assert found(N.nearest(table, 4, "s", "inner")) == brute(np.arange(1, 601), x, 4, "inner")
    assert "v" not in stored["search-visits"].columns and stored["search-visits"].count() < 600  # a row a chunk and block, not one a query with its vector


def test_a_round_shuffles_about_as_many_vectors_as_there_are(spark, monkeypatch):
    for name, value in (("BLOCK_ROWS", 40), ("LEAST_QUERY_ROWS", 10), ("CHUNK_QUERIES", 60), ("CHUNK_ROWS", 2000), ("ROUND_ROWS", 100)):
        monkeypatch.setattr(N, name, value)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    table = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<float>")
    made, plan = [], N._rounds
    monkeypatch.setattr(N, "_rounds", lambda *a: made.append((a, plan(*a))) or made[-1][1])
    assert found(N.nearest(table, 4, "s", "inner")) == brute(np.arange(1, 601), x.astype(np.float64), 4, "inner")
    ((moved, per_chunk, n, n_asked, _), rounds), = made
    assert sorted(c for own, _ in rounds for c in own) == sorted(moved) and len(rounds) > 3
    assert all(len(own) == 1 or sum(moved[c] for c in own) + parts * len(own) * per_chunk <= n + n_asked for own, parts in rounds)


def test_a_block_of_most_vectors_is_cut(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK_ROWS", 20)
    rng = np.random.default_rng(6)
    x = np.r_[rng.normal(size=(700, 6)) * 0.01, rng.normal(size=(100, 6)) * 10]  # most are near one pivot
    table = spark.createDataFrame([(i + 1, v.tolist()) for i, v in enumerate(x)], "item_id long, vector array<double>")
    work = []
    assert found(N.nearest(table, 3, "s", "inner", work=work)) == brute(np.arange(1, 801), x, 3, "inner")
    assert work[0].agg(F.max("rows")).first()[0] <= 2 * 4 * 20  # about 4 * BLOCK_ROWS


def test_rows_that_cannot_count_are_sorted_out_and_ties_stay():
    rng = np.random.default_rng(8)
    rows, asked = np.round(rng.standard_normal((300, 4)), 1), np.round(rng.standard_normal((40, 4)), 1)
    for floor in (np.nan, 3.0):
        chunk = N._Chunk(5, np.zeros((3, 4)), np.full(3, 100.0))
        chunk.hold(np.full(40, 2), np.arange(1000, 1040), asked, np.full(40, floor))
        for block in (0, 1):
            chunk.meet(block, np.arange(300)[block::2], rows[block::2])
        found = {}
        for batch in chunk.rows():
            for q, i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found.setdefault(q, []).append((-s, i))
        for k in range(40):
            scores = np.round(rows @ asked[k], 9)
            wanted = sorted((-s, i) for i, s in enumerate(scores.tolist()) if not s < floor)[:5]
            got = sorted(found.get(1000 + k, []))
            assert [i for _, i in got] == [i for _, i in wanted]
