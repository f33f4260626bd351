"""Retrieval, ranking and overlap metrics over tables of queries."""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recengine.operators.candidates import fuse_rrf, label, pivot_ranks
from recengine.operators.order import percentiles


def hits_at(recs: DataFrame, queries: DataFrame, ks: tuple[int, ...], key: str = "query_id") -> DataFrame:
    """key, k, hits, returned, relevant for every query and k, also where nothing was recommended."""
    # rows beyond the largest k count at none of them; the rest is dealt out by key once
    best = recs.where(F.col("rank") <= max(ks)).select(key, "candidate_id", "rank").repartition(key).groupBy(key, "candidate_id").agg(F.min("rank").alias("rank"))
    marked = label(best, queries, key).withColumn("hit", F.when(F.col("label") == 1, F.lit(1)))
    per_k = [F.struct(F.lit(k).alias("k"), F.count_if((F.col("rank") <= k) & F.col("hit").isNotNull()).alias("hits"), F.count_if(F.col("rank") <= k).alias("returned")) for k in ks]
    counted = marked.groupBy(key).agg(F.array(*per_k).alias("m"))
    none = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("returned")) for k in ks])
    rows = queries.select(key, F.size(F.array_distinct("truth")).alias("relevant")).join(counted, key, "left")
    return rows.select(key, "relevant", F.explode(F.coalesce("m", none)).alias("x")).select(key, "x.k", "x.hits", "x.returned", "relevant")


def retrieval_metrics(recs: DataFrame, queries: DataFrame, ks: tuple[int, ...], key: str = "query_id") -> DataFrame:
    """key, k, recall, hit_rate, precision per query. Precision divides by k even for short lists."""
    h = hits_at(recs, queries, ks, key)
    return h.select(key, "k", F.when(F.col("relevant") > 0, F.col("hits") / F.col("relevant")).otherwise(0.0).alias("recall"), (F.col("hits") > 0).cast("double").alias("hit_rate"), (F.col("hits") / F.col("k")).alias("precision"))


def evaluate(recs: DataFrame, queries: DataFrame, ks: tuple[int, ...], catalog_size: int | None = None, key: str = "query_id") -> DataFrame:
    """k, queries, recall, hit_rate, precision, catalog_coverage, user_coverage: means over all queries, those without results included."""
    means = retrieval_metrics(recs, queries, ks, key).groupBy("k").agg(F.count(F.lit(1)).alias("queries"), F.avg("recall").alias("recall"), F.avg("hit_rate").alias("hit_rate"), F.avg("precision").alias("precision"))
    # one row per item: the best rank at which any query shows it
    shown = recs.where(F.col("rank") <= max(ks)).join(queries.select(key), key, "left_semi").groupBy("candidate_id").agg(F.min("rank").alias("rank"))
    items = shown.agg(F.array(*[F.struct(F.lit(k).alias("k"), F.count_if(F.col("rank") <= k).alias("items")) for k in ks]).alias("m")).select(F.explode("m").alias("x")).select("x.*")
    users = queries.select(key).join(recs.select(key).distinct().withColumn("has", F.lit(1.0)), key, "left").agg(F.avg(F.coalesce("has", F.lit(0.0))).alias("user_coverage"))
    out = means.join(F.broadcast(items), "k").join(F.broadcast(users))
    size = F.lit(catalog_size) if catalog_size else F.lit(None).cast("long")
    return out.select("k", "queries", "recall", "hit_rate", "precision", (F.col("items") / size).alias("catalog_coverage"), "user_coverage")


def _ideal(positives: Column, k: int) -> Column:
    """The best possible discounted gain of so many positives in the first k."""
    prefix = [0.0]
    for r in range(1, k + 1):
        prefix.append(prefix[-1] + 1 / log2(r + 1))
    return F.get(F.array(*[F.lit(x) for x in prefix]), positives.cast("int"))


def ranking_metrics(ranked: DataFrame, ks: tuple[int, ...], by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """by..., k, ndcg, map, mrr of rows with (rank, label); normalised by the positives inside the first k, 0 without any."""
    w = Window.partitionBy(*by).orderBy("rank")
    rows = ranked.withColumn("seen", F.sum("label").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    gain, precision = F.col("label") / F.log2(F.col("rank") + 1.0), F.col("label") * F.col("seen") / F.col("rank")
    cells = []
    for k in ks:
        inside = F.col("rank") <= k
        total = lambda x, i=inside: F.coalesce(F.sum(F.when(i, x)), F.lit(0.0))
        n = F.coalesce(F.sum(F.when(inside, F.col("label"))), F.lit(0))
        first = F.min(F.when(inside & (F.col("label") == 1), F.col("rank")))
        cells.append(
            F.struct(
                F.lit(k).alias("k"),
                F.when(n > 0, total(gain) / _ideal(n, k)).otherwise(0.0).alias("ndcg"),
                F.when(n > 0, total(precision) / n).otherwise(0.0).alias("map"),
                F.coalesce(F.lit(1.0) / first, F.lit(0.0)).alias("mrr"),
            )
        )
    return rows.groupBy(*by).agg(F.array(*cells).alias("m")).select(*by, F.explode("m").alias("x")).select(*by, "x.*")


def order_by_score(rows: DataFrame, score: str, key: str = "query_id", top: int | None = None) -> DataFrame:
    """``rows`` with rank by (score desc, candidate id), cut at ``top``."""
    w = Window.partitionBy(key).orderBy(F.desc(F.round(score, 9)), "candidate_id")
    out = rows.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top) if top else out


def ranking_report(features: DataFrame, scores: dict[str, Column], ks: tuple[int, ...] = (5, 10), key: str = "query_id") -> DataFrame:
    """ordering, k, queries, ndcg, map, mrr: means over query groups for each ordering of the same candidates."""
    scored = features.select(key, "candidate_id", "label", *[x.cast("double").alias(f"_s{i}") for i, x in enumerate(scores.values())]).repartition(key)  # once, for all orderings
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("ordering"), F.col(f"_s{i}").alias("s")) for i, n in enumerate(scores)]))
    rows = scored.select(key, "candidate_id", "label", each.alias("o")).select(key, "candidate_id", "label", "o.ordering", "o.s")
    w = Window.partitionBy("ordering", key).orderBy(F.desc(F.round("s", 9)), "candidate_id")
    per_query = ranking_metrics(rows.withColumn("rank", F.row_number().over(w)), ks, ("ordering", key))
    return per_query.groupBy("ordering", "k").agg(F.count(F.lit(1)).alias("queries"), F.avg("ndcg").alias("ndcg"), F.avg("map").alias("map"), F.avg("mrr").alias("mrr"))


def _marked(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The distinct pairs of both tables with in_a and in_b."""
    left = a.select(key, "candidate_id", F.lit(1).alias("in_a"), F.lit(0).alias("in_b"))
    right = b.select(key, "candidate_id", F.lit(0).alias("in_a"), F.lit(1).alias("in_b"))
    return left.unionByName(right).repartition(key).groupBy(key, "candidate_id").agg(F.max("in_a").alias("in_a"), F.max("in_b").alias("in_b"))


def marked_sources(ranks: DataFrame, a: str, b: str, key: str = "query_id") -> DataFrame:
    """The distinct pairs of two sources of ``ranks`` (key, source, candidate_id) with in_a and in_b; ranks that lie by key aren't shuffled."""
    there = lambda s: F.max((F.col("source") == s).cast("int"))
    return ranks.where(F.col("source").isin(a, b)).groupBy(key, "candidate_id").agg(there(a).alias("in_a"), there(b).alias("in_b"))


def candidate_overlap(a: DataFrame, b: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """One row: queries, mean_jaccard (0 for empty unions), shared_rate, mean_shared, mean_a_unique, mean_b_unique, a_unique_relevant, b_unique_relevant."""
    return overlap_of(_marked(a, b, key), queries, key)


def overlap_of(marked: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """The row of ``candidate_overlap`` for marked pairs."""
    rows = label(marked, queries, key)
    shared, a_only, b_only = (F.col("in_a") == 1) & (F.col("in_b") == 1), F.col("in_b") == 0, F.col("in_a") == 0
    hit = F.col("label") == 1
    counts = rows.groupBy(key).agg(F.count_if(shared).alias("s"), F.count_if(a_only).alias("ua"), F.count_if(b_only).alias("ub"), F.count_if(a_only & hit).alias("ra"), F.count_if(b_only & hit).alias("rb"))
    all_queries = queries.select(key).join(counts, key, "left").fillna(0)
    union = F.col("s") + F.col("ua") + F.col("ub")
    return all_queries.agg(
        F.count(F.lit(1)).alias("queries"),
        F.avg(F.when(union > 0, F.col("s") / union).otherwise(0.0)).alias("mean_jaccard"),
        F.avg((F.col("s") > 0).cast("double")).alias("shared_rate"),
        F.avg("s").alias("mean_shared"),
        F.avg("ua").alias("mean_a_unique"),
        F.avg("ub").alias("mean_b_unique"),
        F.sum("ra").alias("a_unique_relevant"),
        F.sum("rb").alias("b_unique_relevant"),
    )


def fusion_evaluation(ranks: DataFrame, queries: DataFrame, a: str, b: str, ks: tuple[int, ...] = (10,), depth: int = 30, key: str = "query_id") -> DataFrame:
    """system, k, recall, precision, shared_rate, mean_jaccard: both sources of ``ranks`` (source, candidate_id, rank), their fusion, and the overlap of their first ``depth`` on each row."""
    own = {x: ranks.where(F.col("source") == x) for x in (a, b)}
    fused = fuse_rrf(pivot_ranks(ranks, (a, b), key), (a, b), limit=None, key=key).select(key, "candidate_id", F.col("fused_rank").alias("rank"))
    overlap = candidate_overlap(own[a].where(F.col("rank") <= depth), own[b].where(F.col("rank") <= depth), queries, key).select("shared_rate", "mean_jaccard")
    out = None
    for name, recs in ((a, own[a]), (b, own[b]), ("fused", fused)):
        one = retrieval_metrics(recs, queries, ks, key).groupBy("k").agg(F.avg("recall").alias("recall"), F.avg("precision").alias("precision")).select(F.lit(name).alias("system"), "k", "recall", "precision")
        out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(overlap))  # one row


def lineup_overlap(a: DataFrame, b: DataFrame, limits: tuple[int, ...], queries: DataFrame, key: str = "query_id") -> DataFrame:
    """key, top, overlap, jaccard (1 if both are empty), a_count, b_count at each cut-off."""
    ranks = a.select(key, "candidate_id", F.col("rank").alias("ra"), F.lit(None).cast("int").alias("rb")).unionByName(b.select(key, "candidate_id", F.lit(None).cast("int").alias("ra"), F.col("rank").alias("rb")))
    return _lineups_met(ranks.groupBy(key, "candidate_id").agg(F.min("ra").alias("ra"), F.min("rb").alias("rb")), limits, queries, key)


def source_lineup_overlap(ranks: DataFrame, a: str, b: str, limits: tuple[int, ...], queries: DataFrame, key: str = "query_id") -> DataFrame:
    """``lineup_overlap`` of two sources of ``ranks`` (key, source, candidate_id, rank); ranks that lie by key aren't shuffled."""
    of = lambda s: F.min(F.when(F.col("source") == s, F.col("rank")))
    return _lineups_met(ranks.groupBy(key, "candidate_id").agg(of(a).alias("ra"), of(b).alias("rb")), limits, queries, key)


def _lineups_met(pairs: DataFrame, limits: tuple[int, ...], queries: DataFrame, key: str) -> DataFrame:
    cells = [F.struct(F.lit(n).alias("top"), F.count_if((F.col("ra") <= n) & (F.col("rb") <= n)).alias("overlap"), F.count_if(F.col("ra") <= n).alias("a_count"), F.count_if(F.col("rb") <= n).alias("b_count")) for n in limits]
    none = F.array(*[F.struct(F.lit(n).alias("top"), *(F.lit(0).cast("long").alias(x) for x in ("overlap", "a_count", "b_count"))) for n in limits])
    rows = queries.select(key).distinct().join(pairs.groupBy(key).agg(F.array(*cells).alias("m")), key, "left").select(key, F.explode(F.coalesce("m", none)).alias("x")).select(key, "x.*")
    union = F.col("a_count") + F.col("b_count") - F.col("overlap")
    return rows.withColumn("jaccard", F.when(union > 0, F.col("overlap") / union).otherwise(1.0))


def latency_summary(rows: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., n, mean, max, p50, p95, p99 (exact, linear interpolation), whatever the size of a group."""
    sums = rows.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.max(value).alias("max"))
    found = percentiles(rows, value, [0.5, 0.95, 0.99], list(by))
    found = found.select(*[F.col(c).alias(f"_{c}") for c in by], *[F.col(f"p{k}").alias(n) for k, n in enumerate(("p50", "p95", "p99"))])
    same = F.lit(True)
    for c in by:
        same = same & sums[c].eqNullSafe(found[f"_{c}"])
    return sums.join(found, same, "left").select(*by, "n", "mean", "max", "p50", "p95", "p99")


def component_sizes(parts: dict[str, tuple[DataFrame, int, int]]) -> DataFrame:
    """component, rows, bytes for (table, values per row, bits per value), and the row ``total``."""
    rows = None
    for name, (df, values, bits) in parts.items():
        one = df.agg(F.lit(name).alias("component"), F.count(F.lit(1)).alias("rows")).withColumn("bytes", F.ceil(F.col("rows") * values * bits / 8))
        rows = one if rows is None else rows.unionByName(one)
    return rows.unionByName(rows.agg(F.lit("total").alias("component"), F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes")))
