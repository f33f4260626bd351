"""Registered queries: neighbors, candidates, features, metrics, lineups, models and streams."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.functions import scalars as S
from recengine.functions.scalars import clean_seeds
from recengine.operators import boosting
from recengine.operators import candidates as K
from recengine.operators.compression import compression_sweep
from recengine.operators import content as X
from recengine.operators import features as Z
from recengine.operators import fitting as M
from recengine.operators import lineup as L
from recengine.operators import metrics as E
from recengine.operators import neighbors as N
from recengine.operators import splits as P
from recengine.plans import views as V
from recengine.plans.registry import query, table
from recengine.sources.scratch import scratch_path, written
from recengine.streaming import jobs

SRC, DEPTH, LIMIT = V.SOURCES, V.DEPTH, V.LIMIT

# --- flagship: the whole chain of the co-occurrence recommender ---

_REC10 = "SELECT query_id, candidate_id, rank FROM source_ranks WHERE source = 'item_graph' AND rank <= 10"


def _graph_recs(spark, d) -> tuple[DataFrame, DataFrame]:
    s = V.stored_split(spark, d)
    q = written(V.validation_queries(spark, d, s), "queries")
    near = K.narrowed(N.item_graph(V.train(spark, d, s), DEPTH, seeds=V.seeds_of(q), lists=True))
    return q, written(K.seed_ranks(q, near, DEPTH, DEPTH), "source-ranks")


@query(
    "flagship_recall",
    "queries:l recommended:l hits:l recall:d hit_rate:d precision:d",
    "SELECT count(*) AS queries, sum(n) AS recommended, sum(h) AS hits, avg(h / r) AS recall, avg(CASE WHEN h > 0 THEN 1.0 "
    "ELSE 0 END) AS hit_rate, avg(h / 10) AS precision FROM (SELECT q.query_id, CAST(len(q.truth) AS DOUBLE) AS r, count(x.candidate_id) "
    "AS n, CAST(count(t.candidate_id) AS DOUBLE) AS h "
    f"FROM validation_queries q LEFT JOIN ({_REC10}) x USING (query_id) LEFT JOIN truth t ON t.query_id = x.query_id AND t.candidate_id "
    "= x.candidate_id GROUP BY 1, 2)",
    "validation_queries", "source_ranks", "truth",
)
def flagship_recall(spark, d):
    q, ranks = _graph_recs(spark, d)
    m = E.hits_at(ranks.where("rank <= 10"), q, (10,))
    return m.agg(
        F.count(F.lit(1)).alias("queries"), F.sum("returned").alias("recommended"), F.sum("hits").alias("hits"), F.avg(F.col("hits") / F.col("relevant")).alias("recall"), F.avg((F.col("hits") > 0).cast("double")).alias("hit_rate"), F.avg(F.col("hits") / 10).alias("precision")
    )


# --- neighbors ---


@query("m2_item_graph", "seed_id:l candidate_id:l score:f rank:l", "SELECT seed_id, candidate_id, score, rank FROM graph", "graph")
@query("k5_graph_top_rows", "seed_id:l candidate_id:l rank:l", "SELECT seed_id, candidate_id, rank FROM graph", "graph")
def m2_item_graph(spark, d):
    return V.graph(spark, d)


@query("k7_depth_truncation", "seed_id:l candidate_id:l rank:l", "SELECT seed_id, candidate_id, rank FROM graph WHERE rank <= 25", "graph")
def k7_depth_truncation(spark, d):
    return N.truncate(V.graph(spark, d), 25)


@query("k2_topk_cosine", "seed_id:l candidate_id:l score:f rank:l", "SELECT seed_id, candidate_id, score, rank FROM content", "content")
def k2_topk_cosine(spark, d):
    return V.content_neighbors(spark, d)


@query(
    "k1_topk_inner_product",
    "seed_id:l candidate_id:l score:f rank:l",
    "SELECT seed_id, candidate_id, score, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, candidate_id) AS rank "
    "FROM (SELECT a.item_id AS seed_id, b.item_id AS candidate_id, round(list_inner_product(a.vector, b.vector), 9) AS score "
    "FROM vectors a JOIN vectors b ON a.item_id <> b.item_id) QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY score "
    "DESC, candidate_id) <= 20",
    "vectors",
)
def k1_topk_inner_product(spark, d):
    return N.nearest(V.vectors(spark, d), 20, "als", "inner")


@query(
    "k3_l2_normalize",
    "item_id:l dim:l x:d",
    "SELECT item_id, unnest(range(len(vector))) AS dim, unnest(vector) / sqrt(list_inner_product(vector, vector)) AS x FROM "
    "vectors",
    "vectors",
)
def k3_l2_normalize(spark, d):
    return V.vectors(spark, d).select("item_id", F.posexplode(N.l2_normalize(F.col("vector"))).alias("dim", "x"))


@query("k1_search_work", "step:l queries:l products:l all_pairs:l")
def k1_search_work(spark, d):
    """How many products the exact search of the vectors takes, by step, of all pairs."""
    v, work = V.vectors(spark, d), []
    N.nearest(v, 20, "content", work=work).write.format("noop").mode("overwrite").save()
    n = v.count()
    step = lambda k, w: w.agg(F.lit(k).alias("step"), F.coalesce(F.sum("queries"), F.lit(0)).alias("queries"), F.coalesce(F.sum(F.col("queries") * F.col("rows")), F.lit(0)).alias("products"), F.lit(n * n).alias("all_pairs"))
    return reduce(DataFrame.unionByName, [step(k, w) for k, w in enumerate(work)])


@query(
    "k6_neighbors_of_seeds",
    "seed_id:l candidate_id:l rank:l",
    "SELECT seed_id, candidate_id, rank FROM graph WHERE seed_id IN (SELECT seed_id FROM seeds)",
    "graph",
    "seeds",
)
def k6_neighbors_of_seeds(spark, d):
    seeds = K.query_seeds(V.validation_queries(spark, d)).select("seed_id").distinct()
    return N.item_graph(V.train(spark, d), DEPTH, seeds=seeds)


@query("k8_query_subset", "user_id:l", "SELECT user_id FROM validation_queries ORDER BY user_id LIMIT 50", "validation_queries")
def k8_query_subset(spark, d):
    return P.query_subset(V.validation_queries(spark, d), 50)


# --- candidates ---


@query(
    "j4_seed_neighbors",
    "query_id:s source:s seed_id:l candidate_id:l rank:l",
    "SELECT s.query_id, n.source, s.seed_id, n.candidate_id, n.rank FROM seeds s JOIN neighbors n ON n.seed_id = s.seed_id "
    "WHERE n.rank <= 10",
    "seeds",
    "neighbors",
)
def j4_seed_neighbors(spark, d):
    s = V.stored_split(spark, d)
    q = written(V.validation_queries(spark, d, s), "queries")
    return K.query_seeds(q).join(V.neighbors(spark, d, s, q).where("rank <= 10"), "seed_id")


@query(
    "j5_seed_exclusion",
    "query_id:s looked_up:l seeds_looked_up:l kept:l seeds_kept:l",
    "WITH x AS (SELECT s.query_id, n.source, s.seed_id, n.candidate_id, n.candidate_id IN (SELECT y.seed_id FROM seeds y "
    "WHERE y.query_id = s.query_id) AS is_seed FROM seeds s JOIN neighbors n ON n.seed_id = s.seed_id) "
    "SELECT query_id, count(*) AS looked_up, count(*) FILTER (is_seed) AS seeds_looked_up, count(*) FILTER (NOT is_seed AND "
    "candidate_id > 0) AS kept, 0 AS seeds_kept FROM x GROUP BY query_id",
    "seeds", "neighbors",
)
def j5_seed_exclusion(spark, d):
    """Per query the neighbors of its seeds, how many of them are seeds, and the same after the exclusion."""
    s = V.stored_split(spark, d)
    q = written(V.validation_queries(spark, d, s), "queries")
    found = written(V.neighbors(spark, d, s, q), "neighbors")
    seeds = q.select("query_id", clean_seeds(F.col("seeds")).alias("own"))
    lists = found.groupBy("seed_id").agg(F.collect_list("candidate_id").alias("near"))
    looked = K.query_seeds(q).select("query_id", "seed_id").join(lists, "seed_id").join(seeds, "query_id")
    is_seed = lambda c: F.array_contains("own", c)
    before = looked.groupBy("query_id").agg(F.sum(F.size("near")).alias("looked_up"), F.sum(F.size(F.filter("near", is_seed))).alias("seeds_looked_up"))
    after = K.seed_candidates(q, found, DEPTH).join(seeds, "query_id").groupBy("query_id").agg(F.count(F.lit(1)).alias("kept"), F.count_if(is_seed(F.col("candidate_id"))).alias("seeds_kept"))
    return before.join(after, "query_id", "left").fillna(0)


@query("w6_rank_within_seed", "query_id:s source:s seed_id:l candidate_id:l rank:l", f"SELECT * FROM per_seed WHERE rank <= {DEPTH}", "per_seed")
def w6_rank_within_seed(spark, d, s=None):
    s = s if s is not None else V.stored_split(spark, d)
    q = written(V.validation_queries(spark, d, s), "queries")
    return K.seed_candidates(q, V.near(spark, d, s, q), DEPTH)


@query(
    "a8_support_best_rank",
    "query_id:s source:s candidate_id:l support:l best_rank:l",
    "SELECT query_id, source, candidate_id, support, best_rank FROM source_ranks",
    "source_ranks",
)
@query(
    "w7_rank_within_source",
    "query_id:s source:s candidate_id:l rank:l",
    "SELECT query_id, source, candidate_id, rank FROM source_ranks",
    "source_ranks",
)
def w7_rank_within_source(spark, d):
    return _rank_lists(spark, d).select("query_id", F.inline("lists")).select("query_id", "source", F.inline("found"))


def _rank_lists(spark, d, s=None) -> DataFrame:
    s = s if s is not None else V.stored_split(spark, d)
    q = written(V.validation_queries(spark, d, s), "queries")
    return K.rank_lists(q, V.near(spark, d, s, q), DEPTH, DEPTH)


def _fused_lists(spark, d, s=None, limit: int | None = None) -> DataFrame:
    return K.fused_lists(_rank_lists(spark, d, s), SRC, limit=limit)


def _lying_ranks(spark, d, s=None) -> DataFrame:
    """The same ranks by windows: Spark knows that they lie by query, for what goes on to group by it."""
    return K.source_ranks(w6_rank_within_seed(spark, d, s), DEPTH)


def _pivoted(spark, d, s=None) -> DataFrame:
    return K.pivot_ranks(_lying_ranks(spark, d, s), SRC)


def _fused(spark, d, s=None) -> DataFrame:
    return K.fuse_rrf(_pivoted(spark, d, s), SRC, limit=None)


@query("j6_merged_source_ranks", "query_id:s candidate_id:l item_graph_rank:l content_rank:l", "SELECT * FROM pivoted", "pivoted")
@query("a10_source_count", "query_id:s candidate_id:l source_count:l", "SELECT * FROM pivoted", "pivoted")
def j6_merged_source_ranks(spark, d):
    return _fused_lists(spark, d).select("query_id", F.inline("fused"))


@query("u1_union_of_sources", "query_id:s candidate_id:l", "SELECT query_id, candidate_id FROM pivoted", "pivoted")
def u1_union_of_sources(spark, d):
    r = _lying_ranks(spark, d)
    return K.union_candidates(r.where("source = 'item_graph'"), r.where("source = 'content'"))


@query("a9_reciprocal_rank_score", "query_id:s candidate_id:l rrf_score:d", "SELECT query_id, candidate_id, rrf_score FROM fused", "fused")
@query(
    "w8_fuse_rrf",
    "query_id:s candidate_id:l rrf_score:d fused_rank:l",
    "SELECT query_id, candidate_id, rrf_score, fused_rank FROM fused",
    "fused",
)
def w8_fuse_rrf(spark, d, s=None):
    return _fused_lists(spark, d, s).select("query_id", F.inline("fused"))


@query(
    "w9_cap_candidates",
    "query_id:s candidate_id:l source_count:l",
    f"SELECT query_id, candidate_id, source_count FROM fused WHERE fused_rank <= {LIMIT}",
    "fused",
)
def w9_cap_candidates(spark, d):
    return _fused_lists(spark, d, limit=LIMIT).select("query_id", F.inline("fused"))


@query("j7_labels", "query_id:s candidate_id:l label:l", "SELECT query_id, candidate_id, label FROM candidates", "candidates")
def j7_labels(spark, d):
    return V.candidates(spark, d)


@query(
    "e14_build_candidates",
    "query_id:s candidate_id:l item_graph_rank:l content_rank:l source_count:l label:l",
    "SELECT * FROM inner_candidates",
    "inner_candidates",
)
def e14_build_candidates(spark, d):
    """Candidates of the ranker's own queries, with neighbors fitted on the history of its own split."""
    return V.inner_candidates(spark, d, V.ranking_split(spark, d))


@query(
    "e15_partition_candidates",
    "query_id:s candidate_id:l item_graph_rank:l content_rank:l source_count:l label:l",
    "SELECT * FROM candidates UNION ALL SELECT * FROM test_candidates",
    "candidates",
    "test_candidates",
)
def e15_partition_candidates(spark, d):
    """Candidates of validation and test queries, with neighbors fitted on the whole train part."""
    return V.partition_candidates(spark, d, V.stored_split(spark, d))


@query(
    "a12_candidate_statistics",
    "queries:l candidates:l positives:l unretrieved:l zero_candidate_queries:l zero_positive_queries:l",
    "SELECT count(*) AS queries, sum(c) AS candidates, sum(p) AS positives, sum(t - p) AS unretrieved, count(*) FILTER (c "
    "= 0) AS zero_candidate_queries, count(*) FILTER (p = 0) AS zero_positive_queries FROM (SELECT q.query_id, len(list_distinct(q.truth)) "
    "AS t, count(k.candidate_id) AS c, coalesce(sum(k.label), 0) AS p FROM validation_queries q LEFT JOIN candidates k USING "
    "(query_id) GROUP BY 1, 2)",
    "validation_queries", "candidates",
)
def a12_candidate_statistics(spark, d):
    s = V.stored_split(spark, d)
    return K.candidate_stats(V.candidates(spark, d, s), V.validation_queries(spark, d, s))


@query("a11_query_group_sizes", "query_id:s rows:l", "SELECT query_id, count(*) AS rows FROM candidates GROUP BY 1", "candidates")
def a11_query_group_sizes(spark, d):
    return K.group_sizes(V.candidates(spark, d))


@query(
    "j11_known_seeds",
    "query_id:s seed_id:l",
    "SELECT query_id, seed_id FROM seeds WHERE seed_id IN (SELECT item_id FROM vectors)",
    "seeds",
    "vectors",
)
def j11_known_seeds(spark, d):
    return K.known_seeds(K.query_seeds(V.validation_queries(spark, d)), V.vectors(spark, d))


@query("j8_popularity_lookup", "query_id:s candidate_id:l popularity:l", "SELECT query_id, candidate_id, popularity FROM features", "features")
@query(
    "e17_materialize_features",
    "query_id:s candidate_id:l label:l source_count:d item_graph_rank:d item_graph_rr:d content_rank:d content_rr:d popularity:d log_popularity:d",
    "SELECT * FROM features",
    "features",
)
def e17_materialize_features(spark, d):
    return V.features(spark, d)


# --- metrics ---

_RECS = "SELECT query_id, candidate_id, fused_rank AS rank FROM fused"


@query(
    "v1_recall_hit_precision",
    "query_id:s k:l recall:d hit_rate:d precision:d",
    f"WITH r AS ({_RECS}) SELECT q.query_id, k.k, count(t.candidate_id) / CAST(len(list_distinct(q.truth)) AS DOUBLE) AS recall, "
    "CASE WHEN count(t.candidate_id) > 0 THEN 1 ELSE 0 END AS hit_rate, count(t.candidate_id) / CAST(k.k AS DOUBLE) AS precision "
    "FROM validation_queries q CROSS JOIN (VALUES (5), (10), (20)) k(k) "
    "LEFT JOIN r ON r.query_id = q.query_id AND r.rank <= k.k LEFT JOIN truth t ON t.query_id = r.query_id AND t.candidate_id "
    "= r.candidate_id GROUP BY q.query_id, k.k, q.truth",
    "fused", "validation_queries", "truth",
)
def v1_recall_hit_precision(spark, d):
    s = V.stored_split(spark, d)
    recs = _fused(spark, d, s).select("query_id", "candidate_id", F.col("fused_rank").alias("rank"))
    return E.retrieval_metrics(recs, V.validation_queries(spark, d, s), (5, 10, 20))


_EVAL = """WITH r AS ({recs}), m AS (SELECT q.query_id, k.k, count(t.candidate_id) AS h, len(list_distinct(q.truth)) AS n FROM validation_queries q CROSS JOIN (VALUES (10), (20)) k(k) LEFT JOIN r ON r.query_id = q.query_id AND r.rank <= k.k LEFT JOIN truth t ON t.query_id = r.query_id AND t.candidate_id = r.candidate_id GROUP BY q.query_id, k.k, q.truth)
SELECT k, count(*) AS queries, avg(h / CAST(n AS DOUBLE)) AS recall, avg(CASE WHEN h > 0 THEN 1.0 ELSE 0 END) AS hit_rate, avg(h / CAST(k AS DOUBLE)) AS precision, (SELECT count(DISTINCT candidate_id) FROM r WHERE r.rank <= m.k) / CAST((SELECT count(*) FROM catalog) AS DOUBLE) AS catalog_coverage, (SELECT count(DISTINCT query_id) FROM r) / CAST(count(*) AS DOUBLE) AS user_coverage FROM m GROUP BY k"""


@query(
    "v5_evaluate",
    "k:l queries:l recall:d hit_rate:d precision:d catalog_coverage:d user_coverage:d",
    _EVAL.format(recs=_RECS),
    "fused",
    "validation_queries",
    "truth",
    "catalog",
)
@query("a15_catalog_coverage", "k:l catalog_coverage:d", _EVAL.format(recs=_RECS), "fused", "validation_queries", "truth", "catalog")
def v5_evaluate(spark, d):
    s = V.stored_split(spark, d)
    recs = written(w8_fuse_rrf(spark, d, s).select("query_id", "candidate_id", F.col("fused_rank").alias("rank")), "recs")
    return E.evaluate(recs, V.validation_queries(spark, d, s), (10, 20), V.catalog(spark, d).count())


_TOP = "SELECT q.query_id, p.item_id AS candidate_id, row_number() OVER (PARTITION BY q.query_id ORDER BY p.popularity DESC, p.item_id) AS rank FROM validation_queries q JOIN popularity p ON NOT list_contains(q.seeds, p.item_id) QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY p.popularity DESC, p.item_id) <= 20"


@query("w12_popularity_top_n", "query_id:s candidate_id:l rank:l", _TOP, "validation_queries", "popularity")
def w12_popularity_top_n(spark, d):
    s = V.stored_split(spark, d)
    q = written(V.validation_queries(spark, d, s).select("query_id", "seeds"), "queries")
    return Z.recommend_popular(q, Z.popularity(V.train(spark, d, s)), 20)


@query(
    "v12_popularity_baseline",
    "k:l queries:l recall:d hit_rate:d precision:d catalog_coverage:d user_coverage:d",
    _EVAL.format(recs=_TOP),
    "validation_queries",
    "popularity",
    "truth",
    "catalog",
)
def v12_popularity_baseline(spark, d):
    s = V.stored_split(spark, d)
    q = written(V.validation_queries(spark, d, s), "queries")
    recs = written(Z.recommend_popular(q, Z.popularity(V.train(spark, d, s)), 20), "popular")
    return E.evaluate(recs, q, (10, 20), V.catalog(spark, d).count())


_FUSED_ROWS = "SELECT query_id, candidate_id, label, fused_rank AS rank FROM candidates"
_IDEAL = "list_sum(list_transform(range(1, CAST(inside AS BIGINT) + 1), lambda i: 1 / log2(i + 1)))"


def _ranking_sql(rows: str, part: str = "") -> str:
    keys = f"{part}query_id, k"
    inner = f"SELECT *, sum(CASE WHEN rank <= k THEN label ELSE 0 END) OVER (PARTITION BY {keys}) AS inside, sum(label) OVER (PARTITION BY {keys} ORDER BY rank) AS seen FROM ({rows}) CROSS JOIN (VALUES (5), (10)) k(k)"
    return (
        f"SELECT {keys}, CASE WHEN inside > 0 THEN g / {_IDEAL} ELSE 0 END AS ndcg, CASE WHEN inside > 0 THEN p / inside ELSE "
        f"0 END AS map, coalesce(CAST(1 AS DOUBLE) / f, 0) AS mrr FROM (SELECT {keys}, max(inside) AS inside, "
        "sum(CASE WHEN rank <= k THEN label / log2(rank + 1) ELSE 0 END) AS g, sum(CASE WHEN rank <= k THEN label * seen "
        f"/ CAST(rank AS DOUBLE) ELSE 0 END) AS p, min(CASE WHEN rank <= k AND label = 1 THEN rank END) AS f FROM ({inner}) "
        f"GROUP BY {keys})"
    )


@query("v2_v3_v4_ndcg_map_mrr", "query_id:s k:l ndcg:d map:d mrr:d", _ranking_sql(_FUSED_ROWS), "candidates")
def v2_v3_v4_ndcg_map_mrr(spark, d):
    rows = V.candidates(spark, d).withColumn("s", S.rrf_score([F.col(f"{s}_rank") for s in SRC]))
    return E.ranking_metrics(E.order_by_score(rows, "s"), (5, 10))


_ORDERED = (
    "SELECT ordering, query_id, candidate_id, label, row_number() OVER (PARTITION BY ordering, query_id ORDER BY round(s, "
    "9) DESC, candidate_id) AS rank FROM (SELECT 'popularity' AS ordering, query_id, candidate_id, label, CAST(popularity "
    "AS DOUBLE) AS s FROM features UNION ALL SELECT 'rrf', query_id, candidate_id, label, rrf_score FROM features)"
)


@query(
    "v6_ranking_report",
    "ordering:s k:l queries:l ndcg:d map:d mrr:d",
    f"SELECT ordering, k, count(*) AS queries, avg(ndcg) AS ndcg, avg(map) AS map, avg(mrr) AS mrr FROM ({_ranking_sql(_ORDERED, 'ordering, ')}) "
    "GROUP BY 1, 2",
    "features",
)
def v6_ranking_report(spark, d):
    f = V.stored_features(spark, d)
    return E.ranking_report(f, {"popularity": F.col("popularity"), "rrf": M.rrf_scores(f)})


@query("m10_rrf_scores", "query_id:s candidate_id:l score:d", "SELECT query_id, candidate_id, rrf_score AS score FROM features", "features")
def m10_rrf_scores(spark, d):
    f = V.features(spark, d)
    return f.withColumn("score", M.rrf_scores(f))


_A, _B = "SELECT query_id, candidate_id, rank FROM source_ranks WHERE source = 'item_graph' AND rank <= 30", "SELECT query_id, candidate_id, rank FROM source_ranks WHERE source = 'content' AND rank <= 30"
_MARKS = f"SELECT query_id, candidate_id, max(a) AS a, max(b) AS b FROM (SELECT query_id, candidate_id, 1 AS a, 0 AS b FROM ({_A}) UNION ALL SELECT query_id, candidate_id, 0, 1 FROM ({_B})) GROUP BY 1, 2"


def _first(spark, d, s=None) -> DataFrame:
    """The first 30 of either source; they lie by query, so what follows shuffles none of them."""
    return _lying_ranks(spark, d, s).where("rank <= 30")


@query(
    "u2_candidate_sets",
    "query_id:s shared:l a_only:l b_only:l united:l",
    "SELECT query_id, count(*) FILTER (a = 1 AND b = 1) AS shared, count(*) FILTER (b = 0) AS a_only, count(*) FILTER (a "
    f"= 0) AS b_only, count(*) AS united FROM ({_MARKS}) GROUP BY 1",
    "source_ranks",
)
def u2_candidate_sets(spark, d):
    both, key = F.col("in_a") + F.col("in_b"), "query_id"
    return E.marked_sources(_first(spark, d), *SRC).groupBy(key).agg(F.count_if(both == 2).alias("shared"), F.count_if(F.col("in_b") == 0).alias("a_only"), F.count_if(F.col("in_a") == 0).alias("b_only"), F.count(F.lit(1)).alias("united"))


_OVERLAP_COLUMNS = "queries:l mean_jaccard:d shared_rate:d mean_shared:d mean_a_unique:d mean_b_unique:d a_unique_relevant:l b_unique_relevant:l"
_OVERLAP = (
    "SELECT count(*) AS queries, avg(CASE WHEN s + ua + ub > 0 THEN s / CAST(s + ua + ub AS DOUBLE) ELSE 0 END) AS mean_jaccard, "
    "avg(CASE WHEN s > 0 THEN 1.0 ELSE 0 END) AS shared_rate, avg(s) AS mean_shared, avg(ua) AS mean_a_unique, avg(ub) AS "
    "mean_b_unique, sum(ra) AS a_unique_relevant, sum(rb) AS b_unique_relevant FROM ("
    "SELECT q.query_id, count(*) FILTER (a = 1 AND b = 1) AS s, count(*) FILTER (a = 1 AND b = 0) AS ua, count(*) FILTER "
    "(a = 0 AND b = 1) AS ub, count(*) FILTER (a = 1 AND b = 0 AND t.query_id IS NOT NULL) AS ra, count(*) FILTER (a = 0 "
    f"AND b = 1 AND t.query_id IS NOT NULL) AS rb FROM validation_queries q LEFT JOIN ({_MARKS}) m ON m.query_id = q.query_id "
    "LEFT JOIN truth t ON t.query_id = m.query_id AND t.candidate_id = m.candidate_id GROUP BY 1)"
)


@query("v8_candidate_overlap", _OVERLAP_COLUMNS, _OVERLAP, "validation_queries", "source_ranks", "truth")
def v8_candidate_overlap(spark, d):
    s = V.stored_split(spark, d)
    return E.overlap_of(E.marked_sources(_first(spark, d, s), *SRC), V.validation_queries(spark, d, s))


@query(
    "v9_lineup_overlap",
    "query_id:s top:l overlap:l jaccard:d a_count:l b_count:l",
    "SELECT q.query_id, n.n AS top, count(*) FILTER (ra <= n AND rb <= n) AS overlap, count(*) FILTER (ra <= n) AS a_count, "
    "count(*) FILTER (rb <= n) AS b_count, CASE WHEN count(*) FILTER (ra <= n OR rb <= n) > 0 THEN count(*) FILTER (ra <= "
    "n AND rb <= n) / CAST(count(*) FILTER (ra <= n OR rb <= n) AS DOUBLE) ELSE 1 END AS jaccard "
    "FROM validation_queries q CROSS JOIN (VALUES (5), (20)) n(n) LEFT JOIN (SELECT query_id, candidate_id, min(ra) AS ra, "
    f"min(rb) AS rb FROM (SELECT query_id, candidate_id, rank AS ra, NULL AS rb FROM ({_A}) UNION ALL SELECT query_id, candidate_id, "
    f"NULL, rank FROM ({_B})) GROUP BY 1, 2) p ON p.query_id = q.query_id GROUP BY 1, 2",
    "validation_queries", "source_ranks",
)
def v9_lineup_overlap(spark, d):
    s = V.stored_split(spark, d)
    return E.source_lineup_overlap(_first(spark, d, s), *SRC, (5, 20), V.validation_queries(spark, d, s))


@query(
    "v10_fusion_evaluation",
    "system:s k:l recall:d precision:d shared_rate:d mean_jaccard:d",
    "SELECT x.*, shared_rate, mean_jaccard FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS system, 10 AS k, avg(h / CAST(n AS DOUBLE)) AS recall, avg(h / CAST(10 AS DOUBLE)) AS precision "
        "FROM (SELECT q.query_id, count(t.candidate_id) AS h, len(list_distinct(q.truth)) AS n FROM validation_queries q "
        f"LEFT JOIN ({r}) r ON r.query_id = q.query_id AND r.rank <= 10 LEFT JOIN truth t ON t.query_id = r.query_id AND t.candidate_id "
        "= r.candidate_id GROUP BY q.query_id, q.truth)"
        for n, r in (("item_graph", _A), ("content", _B), ("fused", _RECS))
    ) + f") x, ({_OVERLAP}) o",
    "validation_queries", "source_ranks", "truth", "fused",
)
def v10_fusion_evaluation(spark, d):
    s = V.stored_split(spark, d)
    ranks = written(_lying_ranks(spark, d, s), "source-ranks")
    return E.fusion_evaluation(ranks, written(V.validation_queries(spark, d, s), "queries"), *SRC)


@query(
    "v15_component_sizes",
    "component:s rows:l bytes:l",
    "WITH p AS (SELECT 'graph' AS component, count(*) AS rows, count(*) * 8 AS bytes FROM graph UNION ALL SELECT 'vectors', "
    "count(*), count(*) * 64 FROM vectors) SELECT * FROM p UNION ALL SELECT 'total', sum(rows), sum(bytes) FROM p",
    "graph",
    "vectors",
)
def v15_component_sizes(spark, d):
    return E.component_sizes({"graph": (V.graph(spark, d), 2, 32), "vectors": (V.vectors(spark, d), 64, 8)})


# --- lineups ---


def _lineups(spark, d) -> DataFrame:
    return _fused(spark, d).select(F.col("query_id").alias("request_id"), "candidate_id", F.col("rrf_score").alias("score"))


@query(
    "w13_score_ranking",
    "request_id:s candidate_id:l rank:l",
    "SELECT query_id AS request_id, candidate_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, "
    "candidate_id) AS rank FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, "
    f"candidate_id) <= {L.over_fetch(10)}",
    "fused",
)
@query(
    "w16_over_fetch",
    "request_id:s rank:l",
    "SELECT query_id AS request_id, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, candidate_id) "
    "AS rank FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 9) DESC, candidate_id) "
    f"<= {L.over_fetch(10)}",
    "fused",
)
def w13_score_ranking(spark, d):
    return L.top_scores(_lineups(spark, d), L.over_fetch(10))


_LINE = "SELECT query_id AS request_id, candidate_id, fused_rank AS rank FROM fused WHERE fused_rank <= 20"


def _line(spark, d) -> DataFrame:
    return _fused_lists(spark, d, limit=20).select(F.col("query_id").alias("request_id"), F.inline("fused")).select("request_id", "candidate_id", F.col("fused_rank").alias("rank"))


@query(
    "w14_refresh_rotation",
    "request_id:s candidate_id:l rank:l",
    "SELECT request_id, candidate_id, (rank - 1 - 7 % n + n) % n + 1 AS rank FROM (SELECT *, count(*) OVER (PARTITION BY "
    f"request_id) AS n FROM ({_LINE}))",
    "fused",
)
def w14_refresh_rotation(spark, d):
    lines = _fused_lists(spark, d, limit=20).select(F.col("query_id").alias("request_id"), F.size("fused").alias("n"), F.inline("fused"))
    return lines.withColumn("rank", S.rotated_rank(F.col("fused_rank"), F.col("n"), 7))


@query(
    "j10_metadata_enrichment",
    "request_id:s candidate_id:l rank:l title:s",
    f"SELECT request_id, candidate_id, rank, title FROM ({_LINE}) JOIN catalog ON item_id = candidate_id",
    "fused",
    "catalog",
)
def j10_metadata_enrichment(spark, d):
    return L.enrich(_line(spark, d), V.catalog(spark, d))


@query(
    "w15_page",
    "request_id:s candidate_id:l rank:l position:l next_offset:l",
    "WITH s AS (SELECT request_id, candidate_id, rank, row_number() OVER (PARTITION BY request_id ORDER BY rank) AS position "
    f"FROM ({_LINE}) JOIN catalog ON item_id = candidate_id WHERE rank > 4 AND poster_path IS NOT NULL) SELECT *, CASE WHEN "
    "max(position) OVER (PARTITION BY request_id) > 6 THEN max(CASE WHEN position <= 6 THEN rank END) OVER (PARTITION BY "
    "request_id) END AS next_offset FROM s QUALIFY position <= 6",
    "fused", "catalog",
)
def w15_page(spark, d):
    return L.page(_line(spark, d), V.catalog(spark, d), 4, 6)


_FAULTY_LINE = f"SELECT request_id, candidate_id FROM ({_LINE}) UNION ALL SELECT query_id, -1 FROM validation_queries WHERE user_id % 4 = 0 UNION ALL SELECT request_id, candidate_id FROM ({_LINE}) l JOIN validation_queries q ON q.query_id = l.request_id WHERE q.user_id % 3 = 0 UNION ALL SELECT query_id, seeds[1] FROM validation_queries WHERE user_id % 5 = 0"


@query(
    "e11_validate_recommendations",
    "request_id:s not_empty:b within_limit:b positive:b unique:b no_seed:b",
    "SELECT q.query_id AS request_id, count(l.candidate_id) > 0 AS not_empty, count(l.candidate_id) <= 15 AS within_limit, "
    "coalesce(min(l.candidate_id) > 0, true) AS positive, count(l.candidate_id) = count(DISTINCT l.candidate_id) AS \"unique\", "
    "NOT coalesce(bool_or(list_contains(q.seeds, l.candidate_id)), false) AS no_seed FROM validation_queries q LEFT JOIN "
    f"({_FAULTY_LINE}) l ON l.request_id = q.query_id GROUP BY 1",
    "validation_queries", "fused",
)
def e11_validate_recommendations(spark, d):
    """The checks of lineups with planted faults: a negative id, every row twice, a seed."""
    s = V.stored_split(spark, d)
    requests = written(V.validation_queries(spark, d, s), "requests").withColumnRenamed("query_id", "request_id")
    best = _fused_lists(spark, d, s, 20).select(F.col("query_id").alias("request_id"), F.col("fused.candidate_id").alias("line"))
    line, none = F.coalesce("line", F.array().cast("array<bigint>")), F.array().cast("array<bigint>")
    planted = lambda n, x: F.when(F.col("user_id") % n == 0, x).otherwise(none)
    shown = F.concat(line, planted(3, line), planted(4, F.array(F.lit(-1).cast("long"))), planted(5, F.array(F.get("seeds", F.lit(0)).cast("long"))))
    faulty = requests.join(written(best, "lines"), "request_id", "left").select("request_id", F.explode(shown).alias("candidate_id"))
    return L.check_recommendations(requests, faulty, 15)


# --- content terms and quantisation ---

_TERMS = """WITH dd AS (SELECT doc_id AS item_id, lower('lang_' || lang || ' ' || coalesce(text, '')) AS t FROM documents), c AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(t, '[\\p{L}\\p{N}_]{2,}')) AS term FROM dd) GROUP BY 1, 2),
v AS (SELECT term, count(*) AS df, sum(tf) AS total FROM c GROUP BY 1 HAVING count(*) >= 5 ORDER BY total DESC, term LIMIT 300), w AS (SELECT item_id, term, tf * (ln((1 + (SELECT count(*) FROM dd)) / (1 + CAST(df AS DOUBLE))) + 1) AS w FROM c JOIN v USING (term)) SELECT item_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY item_id)) AS weight FROM w"""


def _text_catalog(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "lang", "source", F.col("text").alias("overview"))


@query("m3_tfidf_weights", "item_id:l term:s weight:d", _TERMS.replace(" HAVING count(*) >= 5 ORDER BY total DESC, term LIMIT 300", ""))
def m3_tfidf_weights(spark, d):
    """The weights of all terms of all documents."""
    return X.tfidf(X.documents(_text_catalog(spark, d), {"lang": 1, "overview": 1}))


@query("m3_tfidf_weights_50k", "item_id:l term:s weight:d", _TERMS.replace(">= 5", ">= 2").replace("LIMIT 300", "LIMIT 50000"))
def m3_tfidf_weights_50k(spark, d):
    """The same with the reference's least count of documents and the operators' own vocabulary size."""
    return X.tfidf(X.documents(_text_catalog(spark, d), {"lang": 1, "overview": 1}), 2, 50_000)


_SIX_FIELDS = {"title": 1, "overview": 1, "genres": 1, "keywords": 1, "top_cast": 1, "director": 1}


def _six_field_catalog(spark, d) -> DataFrame:
    """Parts with an item of ``documents`` as their text: the six fields of the plain TF-IDF retriever, some of them null."""
    k, text = F.col("p_partkey"), table(spark, d, "documents").select(F.col("doc_id").alias("p_partkey"), F.col("text").alias("overview"), "lang", "source")
    parts = table(spark, d, "part").join(text, "p_partkey")
    return parts.select(
        k.alias("item_id"), F.col("p_name").alias("title"), "overview", F.array("p_type", "p_brand").alias("genres"), F.when(k % 3 != 0, F.array("lang", "source")).alias("keywords"),
        F.array(F.concat(F.lit("Actor "), (k % 97).cast("string")), F.concat(F.lit("actor"), (k % 89).cast("string"))).alias("top_cast"), F.when(k % 5 != 0, F.concat(F.lit("Dir "), (k % 41).cast("string"))).alias("director"),
    )


def _token_sql(field: str, x: str) -> str:
    bare = f"regexp_replace(regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"CASE WHEN coalesce({bare}, '') = '' THEN '' ELSE concat('{field}_', {bare}) END"


def _tokens_sql(field: str) -> str:
    return f"coalesce(array_to_string(list_transform(list_filter({field}, lambda x: x IS NOT NULL AND x <> ''), lambda x: {_token_sql(field, 'x')}), ' '), '')"


_SIX_FIELD_TERMS = f"""
    WITH p AS (
      SELECT p_partkey AS item_id, p_name AS title, text AS overview, [p_type, p_brand] AS genres, CASE WHEN p_partkey % 3 <> 0 THEN [lang, source] END AS keywords,
             [concat('Actor ', p_partkey % 97), concat('actor', p_partkey % 89)] AS top_cast, CASE WHEN p_partkey % 5 <> 0 THEN concat('Dir ', p_partkey % 41) END AS director
      FROM part JOIN documents ON doc_id = p_partkey),
    dd AS (
      SELECT item_id, lower(concat_ws(' ', coalesce(title, ''), coalesce(overview, ''), {_tokens_sql("genres")}, {_tokens_sql("keywords")}, {_tokens_sql("top_cast")}, {_token_sql("director", "director")})) AS t
      FROM p), """ + _TERMS[_TERMS.index("c AS (SELECT") :].replace(">= 5", ">= 2").replace("LIMIT 300", "LIMIT 50000")


@query("m4_tfidf", "item_id:l term:s weight:d", _SIX_FIELD_TERMS)
def m4_tfidf(spark, d):
    """The plain TF-IDF retriever's rows: its six fields, terms of two items at least, 50,000 of them."""
    return X.tfidf(X.documents(_six_field_catalog(spark, d), _SIX_FIELDS), 2, 50_000)


@query("m3_fit_content", "item_a:l item_b:l product:f")
def m3_fit_content(spark, d):
    """Inner products of the vectors of neighbouring documents, by id: those of copies are 1, those of other languages near 0."""
    vectors = X.fit_content(_text_catalog(spark, d), {"lang": 2, "source": 1, "overview": 1}).vectors(_text_catalog(spark, d))
    vectors = written(vectors, "content-vectors")
    other = vectors.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("item_b"), F.col("vector").alias("other"))
    return vectors.join(other, "item_id").select(F.col("item_id").alias("item_a"), "item_b", N.dot(F.col("vector"), F.col("other")).alias("product"))


@query("m9_k4_embed_unseen", "seed_id:l candidate_id:l score:f rank:l")
def m9_k4_embed_unseen(spark, d):
    c = _text_catalog(spark, d)
    model = X.fit_content(c.where("item_id % 10 <> 0"), {"lang": 2, "source": 1, "overview": 1})
    known, unseen = written(model.vectors(c.where("item_id % 10 <> 0")), "known"), written(model.vectors(c.where("item_id % 10 = 0")), "unseen")
    return N.nearest(known, 5, "content", queries=unseen)


@query(
    "m11_cold_start",
    "request_id:s shown:l known:l seeds:l best_rank:l",
    "SELECT CAST(doc_id AS VARCHAR) AS request_id, 10 AS shown, 10 AS known, 0 AS seeds, 1 AS best_rank FROM documents WHERE "
    "doc_id % 10 = 0 AND (lang IS NOT NULL OR source IS NOT NULL)",
)
def m11_cold_start(spark, d):
    """Line-ups for requests whose only seed has no trained vector: every seed with a known term gets ten known items, none of them the seed."""
    c = _text_catalog(spark, d)
    model = X.fit_content(c.where("item_id % 10 <> 0"), {"lang": 2, "source": 1, "overview": 1}, dim=64)
    known = written(model.vectors(c.where("item_id % 10 <> 0")), "known")
    moved = written(c.where("item_id % 10 = 0").select(F.col("item_id").cast("string").alias("request_id"), F.array(F.col("item_id") + 1).alias("seeds")), "requests")  # seeds are positive
    shift = lambda v: v.withColumn("item_id", F.col("item_id") + 1)
    unseen = L.unseen_seed_neighbors(moved, shift(c), model, shift(known), 30)
    best = L.recommend(moved, unseen, shift(known).select("item_id", F.lit(1).cast("long").alias("popularity")), lambda f: f.withColumn("score", M.rrf_scores(f)), 10)
    shown = best.join(shift(known).select(F.col("item_id").alias("candidate_id"), F.lit(1).alias("known")), "candidate_id", "left").join(moved, "request_id")
    return shown.groupBy("request_id").agg(F.count(F.lit(1)).alias("shown"), F.count("known").alias("known"), F.count_if(F.array_contains("seeds", F.col("candidate_id"))).alias("seeds"), F.min("rank").alias("best_rank"))


@query(
    "m8_quantize_vectors",
    "item_id:l dim:l code:l",
    "WITH x AS (SELECT item_id, unnest(range(len(vector))) AS dim, unnest(vector) AS x FROM vectors) SELECT item_id, dim, "
    "CASE WHEN max(x) OVER (PARTITION BY dim) > min(x) OVER (PARTITION BY dim) THEN round((x - min(x) OVER (PARTITION BY "
    "dim)) / (max(x) OVER (PARTITION BY dim) - min(x) OVER (PARTITION BY dim)) * 255) ELSE 0 END AS code FROM x",
    "vectors",
)
def m8_quantize_vectors(spark, d):
    return N.quantize(V.vectors(spark, d), 8).select("item_id", F.posexplode("codes").alias("dim", "code"))


@query("v11_compression_sweep", "depth:l dim:l mode:s bytes:l overlap:d")
def v11_compression_sweep(spark, d):
    """Graph depth by leading dimensions by storage mode: bytes, and how much of the first 10 of a line-up stays."""
    s = V.stored_split(spark, d)
    q = written(V.validation_queries(spark, d, s), "queries")
    graph = N.item_graph(V.train(spark, d, s), DEPTH, seeds=V.seeds_of(q), lists=True)
    return compression_sweep(q, graph, V.vectors(spark, d), (25, 50), (32, 64))


# --- fitted models: no SQL form; tests hold them against planted structure ---


@query("m1_fit_als", "seed_id:l candidate_id:l score:f rank:l")
def m1_fit_als(spark, d):
    vectors = written(M.fit_als(V.train(spark, d)), "als")
    return N.nearest(vectors, 10, "als", "inner")


@query("m5_item_embeddings", "seed_id:l candidate_id:l score:f rank:l")
def m5_item_embeddings(spark, d):
    train = written(V.train(spark, d), "train")
    vectors = written(M.fit_item_embeddings(P.adjacent_pairs(train), train), "embeddings")
    return N.nearest(vectors, 10, "two_tower")


#: Rounds and patience of the registered fits; the operator's own are 300 and 30.
ROUNDS, PATIENCE = 15, 5


def _ranker(spark, d) -> tuple[M.Ranker, DataFrame]:
    """The ranker learned on its own split and stopped by validation queries, and the features of test queries."""
    inner, validation, test = V.ranking_features(spark, d)
    return M.fit_ranker(inner, list(Z.feature_columns(SRC)), validation, rounds=ROUNDS, rate=0.1, patience=PATIENCE), test


_NAMES = Z.feature_names(SRC)
_FIRST_HISTOGRAM = f"""
    WITH r AS (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY candidate_id) AS pos,
             CAST(sum(label) OVER (PARTITION BY query_id) AS BIGINT) AS positives
      FROM features),
    g AS (
      SELECT a.query_id, a.candidate_id,
             sum(CASE WHEN a.label > b.label THEN 0.5 ELSE -0.5 END * abs(1 / log2(a.pos + 1) - 1 / log2(b.pos + 1)) / i.ideal) AS gradient,
             sum(0.25 * abs(1 / log2(a.pos + 1) - 1 / log2(b.pos + 1)) / i.ideal) AS hessian
      FROM r a JOIN r b ON a.query_id = b.query_id AND a.label <> b.label
      JOIN (SELECT DISTINCT positives, list_sum(list_transform(range(1, positives + 1), lambda k: 1 / log2(k + 1))) AS ideal FROM r) i ON i.positives = a.positives
      GROUP BY ALL),
    x AS ({" UNION ALL ".join(f"SELECT '{n}' AS feature, query_id, candidate_id, CAST({n} AS DOUBLE) AS value FROM features" for n in _NAMES)}),
    c AS (SELECT feature, value, count(*) AS n FROM x GROUP BY ALL),
    d AS (
      SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY value) - 1 AS place, count(*) OVER (PARTITION BY feature) AS distinct_values,
             sum(n) OVER (PARTITION BY feature ORDER BY value) - n AS before, sum(n) OVER (PARTITION BY feature) AS everything
      FROM c),
    b AS (SELECT feature, value, CASE WHEN distinct_values <= 255 THEN place ELSE (before * 255) // everything END AS bin FROM d)
    SELECT feature, bin, count(*) AS rows, sum(gradient) AS gradient, sum(hessian) AS hessian
    FROM x JOIN g USING (query_id, candidate_id) JOIN b USING (feature, value) GROUP BY feature, bin"""


@query("m6_first_histogram", "feature:s bin:l rows:l gradient:d hessian:d", _FIRST_HISTOGRAM, "features")
def m6_first_histogram(spark, d):
    """The sums from which the ranker's first tree splits its root, over the validation queries."""
    return boosting.first_histogram(V.stored_features(spark, d), list(_NAMES))


@query("m6_m7_fit_and_score_ranker", "query_id:s candidate_id:l score:d")
def m6_m7_fit_and_score_ranker(spark, d):
    model, held = _ranker(spark, d)
    return model.score(held)


@query("v7_evaluate_heldout", "ordering:s k:l queries:l ndcg:d map:d mrr:d")
def v7_evaluate_heldout(spark, d):
    model, held = _ranker(spark, d)
    return M.evaluate_heldout(model, held)


@query("m11_ranked_lineup", "request_id:s position:l candidate_id:l score:d rank:l title:s")
def m11_ranked_lineup(spark, d):
    """The request path of test queries with all four sources, the fitted ranker and the catalog's display data."""
    s = V.stored_split(spark, d)
    ranking, t = V.ranking_split(spark, d, s), written(V.train(spark, d, s), "train")

    def found(events: DataFrame, queries: DataFrame) -> DataFrame:
        seeds = V.seeds_of(queries)
        of = lambda v: v.join(seeds.select(F.col("seed_id").alias("item_id")), "item_id", "left_semi")
        als = written(M.fit_als(events, factors=16, iterations=4), "als")
        tower = written(M.fit_item_embeddings(P.adjacent_pairs(events), events, dim=16, epochs=1), "two-tower")
        out = N.item_graph(events, DEPTH, seeds=seeds).unionByName(V.content_neighbors(spark, d, seeds))
        return written(out.unionByName(N.nearest(als, DEPTH, "als", "inner", of(als))).unionByName(N.nearest(tower, DEPTH, "two_tower", queries=of(tower))), "neighbors")

    table_of = lambda queries, near, events: written(Z.materialize_features(K.build_candidates(queries, near, K.SOURCES, DEPTH, DEPTH, LIMIT), Z.popularity(events)), "features")
    inner = table_of(ranking["queries"], found(ranking["history"], ranking["queries"]), ranking["history"])
    queries = written(P.query_records(s, "validation").unionByName(P.query_records(s, "test")), "queries")
    near = found(t, queries)
    validation = table_of(queries.where("query_id LIKE 'validation:%'"), near, t)
    model = M.fit_ranker(inner, list(Z.feature_columns()), validation, rounds=ROUNDS, rate=0.1, patience=PATIENCE)
    requests = queries.where("query_id LIKE 'test:%'").withColumnRenamed("query_id", "request_id")
    return L.lineup(requests, near, Z.popularity(t), model, V.catalog(spark, d), 10, per_seed=DEPTH, limit=LIMIT)


@query(
    "m11_lineup",
    "request_id:s candidate_id:l score:d rank:l",
    "SELECT query_id AS request_id, candidate_id, rrf_score AS score, fused_rank AS rank FROM fused WHERE fused_rank <= 10",
    "fused",
)
def m11_lineup(spark, d):
    s = V.stored_split(spark, d)
    requests = written(V.validation_queries(spark, d, s).withColumnRenamed("query_id", "request_id"), "requests")
    return L.recommend(requests, V.near(spark, d, s, requests.withColumnRenamed("request_id", "query_id")), Z.popularity(V.train(spark, d, s)), lambda f: f.withColumn("score", M.rrf_scores(f)), 10, SRC, DEPTH, LIMIT)


# --- streams ---


@query("t1_stream_ingest", "event_type:s rows:l", "SELECT event_type, count(*) AS rows FROM events GROUP BY 1")
def t1_stream_ingest(spark, d):
    source, target, checkpoint = (scratch_path(spark, x) for x in ("incoming", "ingested", "ingest-state"))
    events = table(spark, d, "events")
    for part in (0, 1):  # two arrivals, each followed by a run
        events.where(F.col("event_id") % 2 == part).write.mode("append").parquet(source)
        jobs.ingest(spark, source, events.schema, target, checkpoint)
    return spark.read.parquet(target).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "t2_running_popularity",
    "day:s item:l events:l",
    "SELECT strftime(CAST(ts AS TIMESTAMP), '%Y-%m-%d') AS day, item_id AS item, count(*) AS events FROM stream GROUP BY "
    "1, 2",
    "stream",
)
def t2_running_popularity(spark, d):
    source, target, checkpoint = (scratch_path(spark, x) for x in ("clicks", "popularity", "popularity-state"))
    clicks = V.events(spark, d).select(F.col("ts").cast("timestamp").alias("ts"), "item_id")
    clicks.write.parquet(source)
    jobs.run_popularity(spark.readStream.schema(clicks.schema).parquet(source), target, checkpoint)
    return jobs.latest_popularity(spark, target).select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "item", "events")


_CORRECTED = """
    WITH e AS (
      SELECT user_id, item_id, rating, ts, ord FROM interactions
      UNION ALL SELECT user_id, item_id, 5.5 - rating, ts + 86400, ord FROM interactions WHERE ord % 7 = 0
      UNION ALL SELECT user_id, item_id, 5.5 - rating, ts - 86400, ord FROM interactions WHERE ord % 3 = 0),
    n AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, ord DESC, rating DESC) = 1)
    SELECT item_id, count(*) AS popularity FROM n WHERE rating >= 3.0 AND item_id > 0 GROUP BY item_id"""


@query("t2_corrected_popularity", "item_id:l popularity:l", _CORRECTED, "interactions")
def t2_corrected_popularity(spark, d):
    """Popularity from a stream in three arrivals: later contradictions of some events come before them, and earlier ones of others at last."""
    source, target, checkpoint = (scratch_path(spark, x) for x in ("ratings", "corrected", "corrected-state"))
    rows = V.interactions(spark, d)
    again = lambda n, days: rows.where(F.col("ord") % n == 0).withColumn("rating", 5.5 - F.col("rating")).withColumn("ts", F.col("ts") + days * 86_400)
    arrivals = [again(7, 1).unionByName(rows.where("ord % 2 = 0")), rows.where("ord % 2 <> 0"), again(3, -1)]
    for part in arrivals:
        part.write.mode("append").parquet(source)
        jobs.run_corrected_popularity(spark.readStream.schema(rows.schema).parquet(source), target, checkpoint)
    return jobs.corrected_popularity(spark, target)
