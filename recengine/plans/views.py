"""The driver tables as interactions, catalog, vectors and events, in Spark and as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.operators import splits as P
from recengine.operators.candidates import build_candidates, narrowed, query_seeds
from recengine.operators.datasets import prepare_ranking
from recengine.operators.features import materialize_features, popularity
from recengine.operators.neighbors import item_graph, nearest, neighbor_lists
from recengine.plans.registry import CTES, cte, table
from recengine.sources.scratch import discard, scratch_path, written

DEPTH, LIMIT, SOURCES = 50, 40, ("item_graph", "content")


def epoch(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def interactions(spark: SparkSession, d: str) -> DataFrame:
    lines, orders = table(spark, d, "lineitem"), table(spark, d, "orders")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), (F.ceil(F.col("l_quantity") / 5) * 0.5).cast("double").alias("rating"), epoch("l_shipdate").alias("ts"),
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("ord"),
    )


cte(
    "interactions",
    "SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(ceil(l_quantity / 5) * 0.5 AS DOUBLE) AS rating, CAST(epoch(l_shipdate) "
    "AS BIGINT) AS ts, l_orderkey * 1000 + l_linenumber AS ord FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
)


def catalog(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("item_id"), (k + 100_000).alias("source_item_id"), F.col("p_name").alias("title"), F.array("p_type", "p_brand").alias("genres"), (F.col("p_size") * 10).cast("long").alias("vote_count"),
        ((k * 7) % 100 / 10.0).alias("vote_average"), F.col("p_retailprice").alias("popularity_score"), F.concat((k % 70 + 1950).cast("string"), F.lit("-"), F.lpad((k % 12 + 1).cast("string"), 2, "0"), F.lit("-01")).alias("release_date"),
        F.when(k % 7 != 0, F.concat(F.lit("/p"), k.cast("string"), F.lit(".jpg"))).alias("poster_path"), (k % 11 == 0).alias("adult"),
    )


cte(
    "catalog",
    "SELECT p_partkey AS item_id, p_partkey + 100000 AS source_item_id, p_name AS title, [p_type, p_brand] AS genres, p_size "
    "* 10 AS vote_count, CAST((p_partkey * 7) % 100 AS DOUBLE) / 10 AS vote_average, p_retailprice AS popularity_score, "
    "CAST(p_partkey % 70 + 1950 AS VARCHAR) || '-' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS release_date, "
    "CASE WHEN p_partkey % 7 <> 0 THEN '/p' || p_partkey || '.jpg' END AS poster_path, p_partkey % 11 = 0 AS adult FROM part",
)


def links(spark: SparkSession, d: str) -> DataFrame:
    """Some links without an item, some that repeat a source or an item."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k - (k % 19 == 0).cast("int")).alias("source_item_id"), F.when(k % 17 != 0, k - (k % 13 == 0).cast("int")).alias("item_id"))


cte(
    "links",
    "SELECT p_partkey - CASE WHEN p_partkey % 19 = 0 THEN 1 ELSE 0 END AS source_item_id, CASE WHEN p_partkey % 17 <> 0 THEN "
    "p_partkey - CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END END AS item_id FROM part",
)


def metadata(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(k.alias("source_item_id"), (k + (k % 23 == 0).cast("int") * 100_000).alias("item_id"), F.col("p_name").alias("title"))


cte(
    "metadata",
    "SELECT p_partkey AS source_item_id, p_partkey + CASE WHEN p_partkey % 23 = 0 THEN 100000 ELSE 0 END AS item_id, p_name "
    "AS title FROM part",
)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select((F.col("vec_id") + 1).alias("item_id"), F.col("embedding").alias("vector"), "label")


cte("vectors", "SELECT vec_id + 1 AS item_id, CAST(embedding AS DOUBLE[]) AS vector, label FROM embeddings")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").withColumn("epoch", epoch("ts")).withColumn("item_id", F.get_json_object("props", "$.k").cast("long"))


cte(
    "stream",
    "SELECT event_id, ts, CAST(epoch(ts) AS BIGINT) AS epoch, user_id, event_type, value, CAST(json_extract_string(props, "
    "'$.k') AS BIGINT) AS item_id FROM events",
)


def positives(spark: SparkSession, d: str) -> DataFrame:
    return P.positives(interactions(spark, d).repartition("user_id"))  # the windows of the split by user need no other shuffle


cte(
    "latest",
    "SELECT * FROM interactions QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, ord DESC, rating "
    "DESC) = 1",
    "interactions",
)
cte("pos", "SELECT * FROM latest WHERE rating >= 3.0", "latest")


def split(spark: SparkSession, d: str) -> DataFrame:
    return P.split_per_user(positives(spark, d))


cte(
    "placed",
    "SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS "
    "rn, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS le, rank() OVER (PARTITION BY user_id "
    "ORDER BY ts) - 1 AS lt FROM pos",
    "pos",
)
cte("wanted", "SELECT *, least(greatest(6, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT)), n - 2) AS tc FROM placed WHERE n >= 8", "placed")
cte(
    "first_cut",
    "SELECT *, least(greatest(1, CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT)), n - tc - 1) AS vc, max(CASE WHEN rn = tc "
    "THEN le END) OVER (PARTITION BY user_id) AS m1, max(CASE WHEN rn = n - 2 THEN lt END) OVER (PARTITION BY user_id) AS "
    "l1 FROM wanted",
    "wanted",
)
cte("train_end", "SELECT *, CASE WHEN m1 <= n - 2 THEN m1 ELSE l1 END AS te FROM first_cut", "first_cut")
cte(
    "second_cut",
    "SELECT *, max(CASE WHEN rn = least(te + vc, n - 1) THEN le END) OVER (PARTITION BY user_id) AS m2, max(CASE WHEN rn "
    "= n - 1 THEN lt END) OVER (PARTITION BY user_id) AS l2 FROM train_end",
    "train_end",
)
cte("both_ends", "SELECT *, CASE WHEN m2 <= n - 1 THEN m2 ELSE l2 END AS ve FROM second_cut", "second_cut")
cte(
    "split",
    "SELECT user_id, item_id, rating, ts, ord, CASE WHEN rn <= te THEN 'train' WHEN rn <= ve THEN 'validation' ELSE 'test' "
    "END AS part FROM both_ends WHERE te >= 6 AND ve > te AND n > ve",
    "both_ends",
)


def stored_split(spark: SparkSession, d: str) -> DataFrame:
    """The split as a written table, for queries that use several of its parts."""
    return written(split(spark, d), "split")


def train(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    return (s if s is not None else split(spark, d)).where("part = 'train'")


def validation_queries(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    return P.query_records(s if s is not None else split(spark, d), "validation")


for _part, _past in (("validation", "part = 'train'"), ("test", "part IN ('train', 'validation')")):
    cte(
        f"{_part}_queries",
        f"SELECT '{_part}:' || user_id AS query_id, user_id, (list(item_id ORDER BY ts, item_id) FILTER ({_past}))[-5:] AS "
        f"seeds, list(item_id ORDER BY ts, item_id) FILTER (part = '{_part}') AS truth, max(ts) FILTER ({_past}) AS history_end_ts, "
        f"min(ts) FILTER (part = '{_part}') AS truth_start_ts FROM split GROUP BY user_id",
        "split",
    )


def graph(spark: SparkSession, d: str, s: DataFrame | None = None, seeds: DataFrame | None = None) -> DataFrame:
    return item_graph(train(spark, d, s), DEPTH, seeds=seeds)


cte("cells", "SELECT DISTINCT user_id, item_id FROM split WHERE part = 'train'", "split")
cte("item_users", "SELECT item_id, count(*) AS users FROM cells GROUP BY item_id", "cells")
cte("user_items", "SELECT user_id, count(*) AS items FROM cells GROUP BY user_id", "cells")
cte(
    "bm25",
    "SELECT c.user_id, c.item_id, CAST(2.2 AS DOUBLE) / (CAST(1.2 AS DOUBLE) * (CAST(0.25 AS DOUBLE) + CAST(0.75 AS DOUBLE) "
    "* i.users / (t.cells / t.items)) + 1) * (ln(t.items) - ln(1 + u.items)) AS weight "
    "FROM cells c JOIN item_users i USING (item_id) JOIN user_items u USING (user_id), (SELECT CAST(count(*) AS DOUBLE) AS "
    "items, CAST(sum(users) AS DOUBLE) AS cells FROM item_users) t",
    "cells", "item_users", "user_items",
)
cte(
    "graph",
    "SELECT 'item_graph' AS source, seed_id, candidate_id, score, row_number() OVER (PARTITION BY seed_id ORDER BY score "
    "DESC, candidate_id) AS rank FROM (SELECT a.item_id AS seed_id, b.item_id AS candidate_id, round(sum(a.weight * b.weight), "
    "9) AS score "
    "FROM bm25 a JOIN bm25 b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY 1, 2) QUALIFY row_number() OVER "
    f"(PARTITION BY seed_id ORDER BY score DESC, candidate_id) <= {DEPTH}",
    "bm25",
)


def content_neighbors(spark: SparkSession, d: str, seeds: DataFrame | None = None) -> DataFrame:
    v = vectors(spark, d)
    asked = v.join(seeds.select(F.col("seed_id").alias("item_id")), "item_id", "left_semi") if seeds is not None else None
    return nearest(v, DEPTH, "content", queries=asked)


cte(
    "content",
    "SELECT 'content' AS source, seed_id, candidate_id, score, row_number() OVER (PARTITION BY seed_id ORDER BY score DESC, "
    "candidate_id) AS rank FROM (SELECT a.item_id AS seed_id, b.item_id AS candidate_id, round(list_cosine_similarity(a.vector, "
    "b.vector), 9) AS score "
    "FROM vectors a JOIN vectors b ON a.item_id <> b.item_id) QUALIFY row_number() OVER (PARTITION BY seed_id ORDER BY score "
    f"DESC, candidate_id) <= {DEPTH}",
    "vectors",
)


def seeds_of(queries: DataFrame) -> DataFrame:
    """The distinct seeds of some queries, written: only their neighbors are looked for."""
    return written(query_seeds(queries).select("seed_id").distinct(), "seeds")


def neighbors(spark: SparkSession, d: str, s: DataFrame | None = None, queries: DataFrame | None = None) -> DataFrame:
    """The neighbors of both sources; with ``queries`` those of their seeds."""
    seeds = seeds_of(queries) if queries is not None else None
    return graph(spark, d, s, seeds).unionByName(content_neighbors(spark, d, seeds))


def near(spark: SparkSession, d: str, s: DataFrame | None, queries: DataFrame) -> DataFrame:
    """The neighbors of the seeds of ``queries`` of both sources as written lists."""
    return near_lists(spark, d, train(spark, d, s), queries)


def near_lists(spark: SparkSession, d: str, history: DataFrame, queries: DataFrame) -> DataFrame:
    seeds = seeds_of(queries)
    content = written(neighbor_lists(content_neighbors(spark, d, seeds)), "content-lists")
    return narrowed(item_graph(history, DEPTH, seeds=seeds, lists=True).unionByName(content))


cte("neighbors", "SELECT * FROM graph UNION ALL SELECT * FROM content", "graph", "content")
cte(
    "seeds",
    "SELECT query_id, seed_id FROM (SELECT query_id, unnest(seeds) AS seed_id FROM validation_queries) WHERE seed_id > 0",
    "validation_queries",
)
cte(
    "per_seed",
    "SELECT query_id, source, seed_id, candidate_id, row_number() OVER (PARTITION BY query_id, source, seed_id ORDER BY rank) "
    "AS rank FROM (SELECT s.query_id, n.source, s.seed_id, n.candidate_id, n.rank FROM seeds s JOIN neighbors n ON n.seed_id "
    "= s.seed_id "
    "WHERE n.candidate_id > 0 AND NOT EXISTS (SELECT 1 FROM seeds x WHERE x.query_id = s.query_id AND x.seed_id = n.candidate_id))",
    "seeds", "neighbors",
)
cte(
    "source_ranks",
    "SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY support DESC, best_rank, candidate_id) AS rank FROM "
    "(SELECT query_id, source, candidate_id, count(DISTINCT seed_id) AS support, min(rank) AS best_rank FROM per_seed WHERE "
    f"rank <= {DEPTH} GROUP BY 1, 2, 3) "
    f"QUALIFY row_number() OVER (PARTITION BY query_id, source ORDER BY support DESC, best_rank, candidate_id) <= {DEPTH}",
    "per_seed",
)
cte(
    "pivoted",
    "SELECT query_id, candidate_id, coalesce(max(rank) FILTER (source = 'item_graph'), 0) AS item_graph_rank, coalesce(max(rank) "
    "FILTER (source = 'content'), 0) AS content_rank, count(DISTINCT source) AS source_count FROM source_ranks GROUP BY 1, "
    "2",
    "source_ranks",
)
cte(
    "fused",
    "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf_score, 12) DESC, candidate_id) AS fused_rank FROM "
    "(SELECT *, CASE WHEN item_graph_rank > 0 THEN CAST(1 AS DOUBLE) / (60 + item_graph_rank) ELSE 0 END + CASE WHEN content_rank "
    "> 0 THEN CAST(1 AS DOUBLE) / (60 + content_rank) ELSE 0 END AS rrf_score FROM pivoted)",
    "pivoted",
)
cte("truth", "SELECT DISTINCT query_id, unnest(truth) AS candidate_id FROM validation_queries", "validation_queries")
cte(
    "candidates",
    "SELECT f.*, CASE WHEN t.query_id IS NULL THEN 0 ELSE 1 END AS label FROM fused f LEFT JOIN truth t USING (query_id, "
    f"candidate_id) WHERE fused_rank <= {LIMIT}",
    "fused",
    "truth",
)
cte("popularity", "SELECT item_id, count(*) AS popularity FROM split WHERE part = 'train' AND item_id > 0 GROUP BY item_id", "split")


def clone(prefix: str, names: tuple[str, ...], swaps: dict[str, str]) -> None:
    """Copies of some expressions, named with a prefix, that read each other's copies and swapped sources."""
    for name in names:
        needs, sql = CTES[name]
        sources = {n: prefix + n for n in names} | {k: v for k, v in swaps.items() if " " not in k}
        for old, new in swaps.items():
            sql = sql.replace(old, new) if " " in old else sql
        sql = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {sources.get(m[2], m[2])}", sql)
        cte(prefix + name, sql, *(sources.get(n, n) for n in needs))


# the ranker's own split: queries, graph and popularity come from the inner history
INNER = """WITH p AS (SELECT user_id, item_id, ts, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS le, rank() OVER (PARTITION BY user_id ORDER BY ts) - 1 AS lt FROM {source}),
q AS (SELECT *, max(CASE WHEN rn = least(greatest(5, CAST(floor(n * CAST(0.8 AS DOUBLE)) AS BIGINT)), n - 1) THEN le END) OVER (PARTITION BY user_id) AS b, max(CASE WHEN rn = n THEN lt END) OVER (PARTITION BY user_id) AS l FROM p WHERE n >= 6),
r AS (SELECT *, CASE WHEN b >= n THEN l ELSE b END AS e FROM q) SELECT user_id, item_id, ts, CASE WHEN rn <= e THEN 'history' ELSE 'target' END AS part FROM r WHERE e >= 5 AND e < n"""
cte("train_rows", "SELECT * FROM split WHERE part = 'train'", "split")
cte("inner_split", INNER.format(source="train_rows"), "train_rows")
cte(
    "inner_queries",
    "SELECT 'ranking:' || user_id AS query_id, user_id, (list(item_id ORDER BY ts, item_id) FILTER (part = 'history'))[-5:] "
    "AS seeds, list(item_id ORDER BY ts, item_id) FILTER (part = 'target') AS truth FROM inner_split GROUP BY user_id",
    "inner_split",
)
_FUSION = ("seeds", "per_seed", "source_ranks", "pivoted", "fused", "truth", "candidates")
clone("inner_", ("cells", "item_users", "user_items", "bm25", "graph", "neighbors", *_FUSION, "popularity"), {"FROM split WHERE part = 'train'": "FROM inner_split WHERE part = 'history'", "split": "inner_split", "validation_queries": "inner_queries"})
clone("test_", _FUSION, {"validation_queries": "test_queries"})


def ranking_split(spark: SparkSession, d: str, s: DataFrame | None = None) -> dict[str, DataFrame]:
    """history, targets, queries and manifest of the ranker's own split."""
    return prepare_ranking(train(spark, d, s), scratch_path(spark, "ranking"))


def inner_candidates(spark: SparkSession, d: str, ranking: dict[str, DataFrame]) -> DataFrame:
    return build_candidates(ranking["queries"], near_lists(spark, d, ranking["history"], ranking["queries"]), SOURCES, DEPTH, DEPTH, LIMIT)


def partition_candidates(spark: SparkSession, d: str, s: DataFrame) -> DataFrame:
    """Candidates of validation and test queries alike, with the neighbors of the whole train part."""
    queries = written(P.query_records(s, "validation").unionByName(P.query_records(s, "test")), "queries")
    return build_candidates(queries, near(spark, d, s, queries), SOURCES, DEPTH, DEPTH, LIMIT)


def ranking_features(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The feature tables of the ranker's own split, of validation and of test queries."""
    s = stored_split(spark, d)
    ranking = ranking_split(spark, d, s)
    inner = stored_features_of(inner_candidates(spark, d, ranking), ranking["history"], "inner-features")
    outer = stored_features_of(partition_candidates(spark, d, s), train(spark, d, s), "features")
    part = lambda name: outer.where(F.col("query_id").startswith(name))
    return inner, part("validation:"), part("test:")


def candidates(spark: SparkSession, d: str, s: DataFrame | None = None) -> DataFrame:
    s = s if s is not None else stored_split(spark, d)
    queries = written(validation_queries(spark, d, s), "queries")
    return build_candidates(queries, near(spark, d, s, queries), SOURCES, DEPTH, DEPTH, LIMIT)


def features(spark: SparkSession, d: str) -> DataFrame:
    s = stored_split(spark, d)
    found = written(candidates(spark, d, s), "candidates")  # what was shuffled for them goes before they are shuffled by item
    return materialize_features(found, popularity(train(spark, d, s)), SOURCES)


def stored_features(spark: SparkSession, d: str) -> DataFrame:
    s = stored_split(spark, d)
    return stored_features_of(candidates(spark, d, s), train(spark, d, s), "features")


def stored_features_of(rows: DataFrame, history: DataFrame, name: str) -> DataFrame:
    """The features of candidates as a written table; the candidates are written before and deleted after it."""
    found = written(rows, "candidates")
    out = written(materialize_features(found, popularity(history), SOURCES), name)
    discard(found)
    return out


cte(
    "features",
    "SELECT c.query_id, c.candidate_id, c.label, source_count, item_graph_rank, CASE WHEN item_graph_rank > 0 THEN CAST(1.0 "
    "/ item_graph_rank AS FLOAT) ELSE 0 END AS item_graph_rr, content_rank, CASE WHEN content_rank > 0 THEN CAST(1.0 / content_rank "
    "AS FLOAT) ELSE 0 END AS content_rr, "
    "coalesce(p.popularity, 0) AS popularity, CAST(ln(1 + coalesce(p.popularity, 0)) AS FLOAT) AS log_popularity, c.rrf_score "
    "FROM candidates c LEFT JOIN popularity p ON p.item_id = c.candidate_id",
    "candidates", "popularity",
)
