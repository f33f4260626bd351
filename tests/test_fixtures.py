"""Literal cases of single operators."""

import pytest
from pyspark.sql import functions as F

from recengine import schemas
from recengine.functions import scalars as S
from recengine.operators import candidates as K
from recengine.operators import catalog as C
from recengine.operators import content as X
from recengine.operators import features as Z
from recengine.operators import fitting as M
from recengine.operators import lineup as L
from recengine.operators import metrics as E
from recengine.operators import neighbors as N
from recengine.operators import payloads as Y
from recengine.operators import splits as P
from recengine.operators.validation import validate_dataset
from recengine.sources import tables as IO

EVENTS = "user_id long, item_id long, rating double, ts long, ord long"
NB = "source string, seed_id long, candidate_id long, score double, rank int"
Q = "query_id string, user_id long, seeds array<long>, truth array<long>, history_end_ts long, truth_start_ts long"


def events(spark, rows):
    return spark.createDataFrame([(u, i, 5.0, t, k) for k, (u, i, t) in enumerate(rows)], EVENTS)


def queries(spark, *rows):
    return spark.createDataFrame([(q, k, s, t, 1, 2) for k, (q, s, t) in enumerate(rows)], Q)


def one_user(spark, stamps):
    return events(spark, [(1, 100 + k, t) for k, t in enumerate(stamps)])


@pytest.mark.parametrize(
    "stamps,want",
    [
        ([*range(1, 11)], (6, 2, 2)),
        ([1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11], (8, 2, 2)),
        ([*range(1, 18), *[18] * 10, *range(19, 23)], (27, 3, 1)),
        ([1], (0, 0, 0)),
        ([], (0, 0, 0)),
    ],
)
def test_chronological_split(spark, stamps, want):
    rows = P.split_per_user(one_user(spark, stamps) if stamps else events(spark, [(1, 1, 1)]).limit(0)).collect()
    parts = {p: sorted(r.ts for r in rows if r.part == p) for p in ("train", "validation", "test")}
    assert tuple(len(parts[p]) for p in ("train", "validation", "test")) == want
    if rows:
        assert parts["train"][-1] < parts["validation"][0] and parts["validation"][-1] < parts["test"][0]


def test_latest_event_decides(spark):
    e = spark.createDataFrame([(1, 5, 5.0, 1, 1), (1, 5, 1.0, 2, 2), (1, 6, 4.0, 1, 3), (1, 6, 5.0, 1, 4)], EVENTS)
    assert [(r.item_id, r.rating) for r in P.positives(e).collect()] == [(6, 5.0)]


def test_query_records_and_eligibility(spark):
    s = P.split_per_user(one_user(spark, range(1, 11)))
    v, t = P.query_records(s, "validation").first(), P.query_records(s, "test").first()
    assert v.seeds == [101, 102, 103, 104, 105] and v.truth == [106, 107] and (v.history_end_ts, v.truth_start_ts) == (6, 7)
    assert t.seeds == [103, 104, 105, 106, 107] and t.truth == [108, 109] and t.query_id == "test:1"
    few = events(spark, [(2, 1, 1)])
    assert P.eligibility(few, P.split_per_user(few)).first() == (0, 1)


def test_global_split(spark):
    rows = events(spark, [(u, 10 * u + k, k) for u in (1, 2) for k in range(1, 21)])
    cut = P.global_cutoffs(rows).first()
    assert (cut.validation_start, cut.test_start, cut.total) == (14, 18, 40)
    assert {(r.part, r["count"]) for r in P.split_global(rows).groupBy("part").count().collect()} == {("train", 26), ("validation", 8), ("test", 6)}


def test_inner_split(spark):
    rows = events(spark, [*[(1, 100 + k, t) for k, t in enumerate([1, 2, 3, 4, 5, 6, 7, 7, 8, 9])], *[(2, 200 + k, k) for k in range(1, 7)], *[(3, 300 + k, 1) for k in range(6)]])
    out = P.split_inner(rows).collect()
    assert {r.user_id for r in out} == {1, 2}
    for u in (1, 2):
        assert max(r.ts for r in out if r.user_id == u and r.part == "history") < min(r.ts for r in out if r.user_id == u and r.part == "target")


def test_catalog_and_exclusions(spark, tmp_path):
    for name, text in {
        "links": "movieId,imdbId,tmdbId\n1,1,101\n2,2,202\n3,3,202\n4,4,\n5,5,505\n",
        "ratings": "userId,movieId,rating,timestamp\n7,1,5,1\n7,2,4,2\n7,3,3,3\n7,4,2,4\n7,5,1,5\n",
        "tags": "userId,movieId,tag,timestamp\n7,1,good,1\n7,2,bad,2\n",
        "movies": "movieId,title,genres\n1,a,b\n",
    }.items():
        (tmp_path / f"{name}.csv").write_text(text)
    meta = spark.createDataFrame([(1, 101), (2, 202), (3, 202), (5, 999)], "movie_id long, tmdb_id long")
    out = C.build_processed(IO.read_raw_csv(spark, str(tmp_path)), meta)
    assert [(r.item_id, r.source_item_id, r.item_index) for r in out["catalog"].collect()] == [(101, 1, 0)]
    assert out["interactions"].count() == 1 and [r.tag for r in out["tags"].collect()] == ["good"]
    x = out["exclusions"].first()
    assert (x.unmapped, x.ambiguous, x.mismatch) == (1, 2, 1)
    (tmp_path / "tags.csv").unlink()
    with pytest.raises(FileNotFoundError):
        IO.read_raw_csv(spark, str(tmp_path))
    with pytest.raises(schemas.ContractError):
        C.prepare_catalog(spark.createDataFrame([(1, 2)], "source_item_id long, item_id long").limit(0), meta.toDF("source_item_id", "item_id"))


def test_candidates_of_one_user(spark):
    nb = [("a", s, c, 1.0, k + 1) for s, cs in {100: [100, 106, 999], 101: [106, 999], **{k: [106] for k in range(102, 106)}}.items() for k, c in enumerate(cs)]
    table = spark.createDataFrame([(src, *r[1:]) for src in ("als", "item_graph", "content") for r in nb], NB)
    q = queries(spark, ("q", [101, 102, 103, 104, 105], [106, 107]))
    got = K.build_candidates(q, table)
    assert {(r.candidate_id, r.label, r.source_count, r.two_tower_rank) for r in got.collect()} == {(106, 1, 3, 0), (999, 0, 3, 0)}
    s = K.candidate_stats(got, q).first()
    assert (s.positives, s.unretrieved, s.zero_candidate_queries) == (1, 1, 0)
    assert K.candidate_stats(got, queries(spark, ("z", [1], [2]))).first().zero_candidate_queries == 1


def test_seed_expansion_and_hygiene(spark):
    nb = spark.createDataFrame([("s", k, c, 1.0, r) for k in range(1, 6) for r, c in ((1, 10 * k), (2, 999))], NB)
    per_seed = K.seed_candidates(queries(spark, ("q", [1, 2, 3, 4, 5], [])), nb, 2)
    assert {(r.seed_id, r.candidate_id, r.rank) for r in per_seed.collect()} == {(k, c, r) for k in range(1, 6) for r, c in ((1, 10 * k), (2, 999))}
    assert [r.candidate_id for r in K.source_ranks(per_seed).orderBy("rank").collect()] == [999, 10, 20, 30, 40, 50]
    dirty = spark.createDataFrame([("s", 7, c, 1.0, k + 1) for k, c in enumerate([7, 0, 8, 8])], NB)
    assert [(r.seed_id, r.candidate_id) for r in K.seed_candidates(queries(spark, ("q", [7, 7, 0], [])), dirty).collect()] == [(7, 8)]
    two = spark.createDataFrame([("s", 1, 10, 1.0, 1), ("s", 1, 20, 1.0, 2), ("s", 2, 20, 1.0, 1), ("s", 2, 30, 1.0, 2)], NB)
    ranks = K.source_ranks(K.seed_candidates(queries(spark, ("q", [1, 2], [])), two))
    assert {r.candidate_id: r.rank for r in ranks.collect()} == {20: 1, 10: 2, 30: 3}


def test_fusion_and_cap(spark):
    pivot = lambda rows, a, b: K.pivot_ranks(spark.createDataFrame([("q", s, c, k) for s, c, k in rows], "query_id string, source string, candidate_id long, rank int"), (a, b))
    p = pivot([("als", 10, 1), ("als", 20, 2), ("content", 20, 1), ("content", 30, 2)], "als", "content")
    got = {r.candidate_id: r.rrf_score for r in K.fuse_rrf(p, ("als", "content")).collect()}
    assert got == pytest.approx({20: 1 / 61 + 1 / 62, 10: 1 / 61, 30: 1 / 62})
    p = pivot([("als", 10, 1), ("als", 20, 2), ("als", 30, 3), ("two_tower", 20, 1), ("two_tower", 40, 2), ("two_tower", 10, 3)], "als", "two_tower")
    assert [r.candidate_id for r in K.fuse_rrf(p, ("als", "two_tower")).orderBy("fused_rank").collect()] == [20, 10, 40, 30]
    p = pivot([("als", 10, 1), ("als", 30, 2), ("content", 20, 1)], "als", "content")
    assert sorted(r.candidate_id for r in K.cap_candidates(p, 2, ("als", "content")).collect()) == [10, 20]


def test_metrics(spark):
    recs = lambda q, ids: spark.createDataFrame([(q, c, k + 1) for k, c in enumerate(ids)], "query_id string, candidate_id long, rank int")
    m = E.retrieval_metrics(recs("q", [2, 3, 4]), queries(spark, ("q", [], [2, 4, 5])), (2,)).first()
    assert (m.recall, m.hit_rate, m.precision) == pytest.approx((1 / 3, 1, 0.5))
    labels = spark.createDataFrame([("q", k + 1, x) for k, x in enumerate([1, 0, 1, 0])], "query_id string, rank int, label int")
    m = E.ranking_metrics(labels, (3,)).first()
    assert (m.ndcg, m.map, m.mrr) == pytest.approx((0.9197207891, 0.8333333333, 1.0))
    none = E.ranking_metrics(labels.withColumn("label", F.lit(0)), (3,)).first()
    assert (none.ndcg, none.map, none.mrr) == (0, 0, 0)
    q = queries(spark, ("a", [9], [2, 4]), ("b", [9], [5]))
    e = E.evaluate(recs("a", [2, 3]).unionByName(recs("b", [2, 3])), q, (2,), 10).first()
    assert (e.recall, e.hit_rate, e.catalog_coverage) == pytest.approx((0.25, 0.5, 0.2))
    o = E.candidate_overlap(recs("q", [10, 20]), recs("q", [20, 40]), queries(spark, ("q", [], [20, 40]))).first()
    assert o.mean_jaccard == pytest.approx(1 / 3) and (o.a_unique_relevant, o.b_unique_relevant) == (0, 1)
    empty = E.lineup_overlap(recs("x", [1]), recs("x", [1]), (1,), queries(spark, ("q", [], []))).first()
    assert (empty.overlap, empty.jaccard) == (0, 1.0)


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    arr = lambda *v: F.array(*map(F.lit, v))
    assert one(S.sanitize(arr(0, 11, 12, 12, -1, 13), arr(11), 3)) == [12, 13]
    assert one(S.clean_seeds(arr(7, 7, 0, 3))) == [7, 3]
    assert one(S.structured_token("genres", F.lit(" Science Fiction!"))) == "genres_science_fiction" and one(S.structured_token("g", F.lit("!!"))) == ""
    assert one(S.year_tokens(F.lit(1997))) == "year_1997 decade_1990" and one(S.year_tokens(F.lit(None).cast("int"))) == "" and one(S.runtime_token(F.lit(134))) == "runtime_120"
    assert one(S.array_tokens("k", arr("a b", "", "!"))) == "k_a_b "
    assert one(S.weighted_document([(F.lit("a"), 2), (F.lit(""), 3), (F.lit("b"), 1)])) == "a a b"
    assert one(S.rotated_rank(F.lit(1), F.lit(5), 7)) == 4 and one(S.shifted_page(F.lit(1), 40)) == 1
    assert one(S.finite_or_zero(F.lit(float("nan")))) == 0 and one(S.reciprocal(F.lit(0))) == 0
    assert one(schemas.to_integer(F.lit("7.0"))) == 7 and one(schemas.to_integer(F.lit("x"), nullable=True)) is None
    for bad in ("x", "7.5"):
        with pytest.raises(Exception, match="integer"):
            one(schemas.to_integer(F.lit(bad)))


def test_features(spark):
    c = spark.createDataFrame([("q", 10, 1, 10, 0, 0, 2, 1), ("q", 20, 0, 2, 0, 0, 1, 0)], "query_id string, candidate_id long, als_rank int, item_graph_rank int, two_tower_rank int, content_rank int, source_count int, label int")
    rows = {r.candidate_id: r for r in Z.materialize_features(c, spark.createDataFrame([(10, 7)], "item_id long, popularity long")).collect()}
    assert (rows[10].als_rr, round(rows[10].item_graph_rr, 6), rows[10].popularity) == (1.0, 0.1, 7.0) and (rows[20].als_rr, rows[20].popularity, rows[20].log_popularity) == (0, 0, 0)
    names = list(Z.feature_columns())
    assert len(names) == 11 and Z.assert_feature_contract(Z.materialize_features(c, spark.createDataFrame([(10, 7)], "item_id long, popularity long")), names)
    assert spark.createDataFrame([(0, 1)], "als_rank int, content_rank int").select(M.rrf_scores(spark.createDataFrame([(0, 1)], "als_rank int, content_rank int")).alias("s")).first().s == pytest.approx(1 / 61)


def test_item_graph_keeps_zero_scores(spark):
    rows = events(spark, [(1, 10, 1), (1, 20, 2), (2, 10, 1), (2, 30, 2), (3, 20, 1), (3, 30, 2)])
    got = N.item_graph(rows, 5).where("seed_id = 10").orderBy("rank").collect()
    assert [(r.candidate_id, r.score) for r in got] == [(20, 0.0), (30, 0.0)]
    assert N.item_graph(rows, 5).where("seed_id = 99").count() == 0


def test_pairs(spark):
    rows = events(spark, [(u, i, k) for u, items in ((1, (10, 20, 30)), (2, (10, 30, 20)), (3, (20, 10, 30))) for k, i in enumerate(items)])
    got = sorted((r.query_id, r.candidate_id) for r in P.adjacent_pairs(rows, 2).collect())
    want = [(10, 20), (20, 30), (10, 30), (30, 20), (20, 10), (10, 30)]
    assert got == sorted(want + [(b, a) for a, b in want])


def test_nearest_blocks_agree_with_one_block(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(0)
    v = spark.createDataFrame([(k, [float(x) for x in rng.standard_normal(6)]) for k in range(1, 60)] + [(60, [0.0] * 6), (61, [0.0] * 6)], "item_id long, vector array<double>")
    whole = sorted(map(tuple, N.nearest(v, 4, "c").collect()))
    monkeypatch.setattr(N, "BLOCK_ROWS", 13)
    assert sorted(map(tuple, N.nearest(v, 4, "c").collect())) == whole and len(whole) == 61 * 4
    coded = N.dequantize(N.quantize(v, 8), 8)
    assert N.squared_error(v, coded).first().mean_squared_error < 1e-3 and N.squared_error(v, N.to_half(v)).first().mean_squared_error < 1e-5


def test_content_groups_texts(spark):
    c = spark.createDataFrame([(1, "space rocket moon orbit"), (2, "space moon rocket launch"), (3, "kitchen recipe cooking")], "item_id long, overview string")
    model = X.fit_content(c, {"overview": 1}, dim=2, min_df=1)
    top = N.nearest(model.vectors(c), 1, "content").where("seed_id in (1, 3)").collect()
    assert {r.seed_id: r.candidate_id for r in top}[1] == 2
    unseen = model.vectors(spark.createDataFrame([(9, "moon orbit"), (8, None)], "item_id long, overview string"))
    assert N.nearest(model.vectors(c), 1, "content", queries=unseen).where("seed_id = 9").first().candidate_id in (1, 2)


def test_fitted_models_find_planted_structure(spark):
    rows = events(spark, [(u, 1 + (u % 2) * 10 + (u * 7 + k * 3) % 8, k) for u in range(60) for k in range(6)])
    side = lambda i: i > 10
    losses: list[float] = []
    for vectors in (M.fit_als(rows, factors=4, iterations=4), M.fit_item_embeddings(P.adjacent_pairs(rows), rows, dim=8, epochs=4, parts=2, losses=losses)):
        near = N.nearest(vectors, 3, "m").collect()
        assert sum(side(r.seed_id) == side(r.candidate_id) for r in near) > 0.8 * len(near)
    assert losses[-1] < losses[0]
    import random

    rng = random.Random(1)
    data = [(f"q{q}", c, int(rng.random() < (0.9 if (x := rng.random()) > 0.8 else 0.05)), float(x), rng.random()) for q in range(60) for c in range(12)]
    f = spark.createDataFrame(data, "query_id string, candidate_id long, label int, a double, b double")
    model = M.fit_ranker(f, ["a", "b"], validation=f, rounds=3, rate=0.5, depth=2, min_rows=5)
    report = {r.ordering: r.ndcg for r in E.ranking_report(model.score(f), {"model": F.col("score"), "noise": F.col("b")}, (5,)).collect()}
    assert report["model"] > report["noise"] + 0.1
    with pytest.raises(ValueError):
        model.score(f.drop("a"))


def test_payload_detail(spark):
    text = '{"id":5,"title":"T","genres":[{"id":1,"name":"Drama"}],"keywords":{"keywords":[{"name":"Key"}]},"credits":{"cast":[{"name":"A"},{"name":"B"}],"crew":[{"job":"Writer","name":"W"},{"job":"Director","name":"D"}]},"release_date":"2001-02-03","poster_path":"/p.jpg","videos":{"results":[{"site":"YouTube","type":"Trailer","key":"x","official":false},{"site":"YouTube","type":"Trailer","key":"y","official":true}]},"production_countries":[{"name":"Chile"}]}'
    rows = spark.createDataFrame([(1, text, None), (2, '{"id":-1}', "{}"), (3, "broken", None)], "movie_id long, tmdb_json string, omdb_json string")
    d = Y.normalize_detail(rows).collect()
    assert len(d) == 1 and d[0].director == "D" and d[0].trailer_url.endswith("=y") and d[0].year == 2001 and d[0].genres == ["Drama"] and d[0].poster_url.endswith("/w500/p.jpg")
    n = {r.movie_id: r for r in Y.normalize_payloads(rows).collect()}
    assert n[1].director == "d" and n[1].genres == ["drama"] and n[3].title is None
    good, bad = Y.partition_failures(rows)
    assert good.count() == 0 and bad.count() == 3


def test_discover_and_paging(spark):
    c = spark.createDataFrame([(k, f"t{k}", ["Drama"], 100 + k, 7.0 + k / 10, float(k), f"20{20 + k}-01-01", None if k == 1 else "/p", False) for k in range(1, 6)], "item_id long, title string, genres array<string>, vote_count long, vote_average double, popularity_score double, release_date string, poster_path string, adult boolean")
    assert [r.item_id for r in C.discover(c, "Drama", 2020, 2025, 7.0, "rating", 2, 2).collect()] == [3, 2]
    line = spark.createDataFrame([("r", k, k) for k in range(1, 6)], "request_id string, candidate_id long, rank int")
    first = L.page(line, c, 0, 2).orderBy("rank").collect()
    assert [(r.candidate_id, r.next_offset) for r in first] == [(2, 3), (3, 3)]
    assert [(r.candidate_id, r.next_offset) for r in L.page(line, c, 3, 2).orderBy("rank").collect()] == [(4, None), (5, None)]
    assert [r.rank for r in L.rotate(line, 7).orderBy("candidate_id").collect()] == [4, 5, 1, 2, 3]
    with pytest.raises(ValueError):
        C.search(c, "t")


def test_validation_reports_leaks(spark):
    q = spark.createDataFrame([("q", 1, [1], [2], 5, 5), ("z", 2, [], [3], 1, 2)], Q)
    got = {(r.rule, r.part): r.violations for r in validate_dataset({"v": q}, {"t": q.limit(0)}).collect()}
    assert got == {("empty_seeds", "v"): 1, ("empty_truth", "v"): 0, ("not_after_history", "v"): 1, ("empty_table", "t"): 1}


def test_contracts(spark):
    df = spark.createDataFrame([("1", "x"), ("2", None)], "a string, b string")
    with pytest.raises(schemas.ContractError, match=r"\['c', 'd'\]"):
        schemas.assert_columns(df, ["d", "a", "c"])
    wanted = schemas.T.StructType([schemas.T.StructField("a", schemas.T.LongType()), schemas.T.StructField("b", schemas.T.DoubleType())])
    assert {r.column: r.uncastable for r in schemas.cast_report(df, wanted).collect()} == {"a": 0, "b": 1}
    with pytest.raises(schemas.ContractError):
        schemas.conform(df, wanted)


def _exchanges(df) -> int:
    """Shuffles of the final plan, those of broadcasts not counted."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum("Exchange hashpartitioning" in line for line in plan.splitlines())


def test_what_is_looked_up_is_shuffled_once_by_query(spark):
    """From the lookup to the labels: only the short lists of neighbors, the seeds and the truths are dealt out, each once."""
    nb = spark.createDataFrame([(x, s, c, 1.0, r) for x in ("als", "content") for s in range(1, 6) for r, c in ((2, 999), (1, 10 * s), (3, 999), (4, s % 5 + 1), (5, -1))], NB)
    q = queries(spark, ("q", [1, 2, 3], [10, 999]), ("q", [3, 4, None, 0], [40]), ("r", [5], [None, 50]), ("z", [77], []))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ranks = K.source_ranks(K.seed_candidates(q, nb, 4), 6)
        got = K.label(K.fuse_rrf(K.pivot_ranks(ranks, ("als", "content")), ("als", "content")), q)
        # neighbors by (source, seed) and by seed, seeds by key and by seed, the lookup by key, seeds and truths by key
        assert _exchanges(got) <= 7
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r.query_id, r.candidate_id, r.label) for r in got.collect()} == {("q", c, int(c in (10, 40, 999))) for c in (5, 10, 20, 30, 40, 999)} | {("r", 50, 1), ("r", 999, 0), ("r", 1, 0)}
    assert {r.candidate_id: (r.support, r.best_rank) for r in ranks.where("query_id = 'q' AND source = 'als'").collect()} == {999: (4, 2), **{10 * s: (1, 1) for s in (1, 2, 3, 4)}, 5: (1, 3)}
