"""From queries and neighbor tables to labelled, capped candidates.

The unit is a table of queries; no step looks at one query in Python. Queries are
(query_id, seeds, truth, ...), neighbor tables as in ``neighbors``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recengine.functions.scalars import clean_seeds, rrf_score
from recengine.operators.neighbors import narrow, neighbor_lists
from recengine.schemas import ContractError

SOURCES = ("als", "item_graph", "two_tower", "content")

#: Neighbors that a task ranks at a time, about.
STEP_NEIGHBORS = 1 << 18
_FOUND = "array<struct<candidate_id: bigint, support: bigint, best_rank: int, rank: int>>"


def query_seeds(queries: DataFrame, key: str = "query_id") -> DataFrame:
    """key, position (from 1), seed_id: the clean seeds, one row each."""
    return queries.select(key, F.posexplode(clean_seeds(F.col("seeds"))).alias("position", "seed_id")).withColumn("position", F.col("position") + 1)


def known_seeds(seeds: DataFrame, items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """Seeds that ``items`` holds."""
    return seeds.join(items.select(F.col(id_col).alias("seed_id")).distinct(), "seed_id", "left_semi")


def _lists(queries: DataFrame, column: str, name: str, key: str) -> DataFrame:
    """key, name: one row a key with the distinct values of an array column."""
    return queries.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_list(column))).alias(name))


def _looked_up(queries: DataFrame, neighbors: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """key, seed_id, source, near: the neighbors of each seed of a query, dealt out by key; and key, own: its seeds."""
    parts = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a set number: the lists are short, what comes of them isn't
    near = neighbors if "near" in neighbors.columns else neighbor_lists(neighbors.where("candidate_id > 0"))
    near = near.select("source", "seed_id", F.array_distinct(F.filter("near", lambda x: x > 0)).alias("near"))
    own = _lists(queries.select(key, clean_seeds(F.col("seeds")).alias("seeds")), "seeds", "own", key)
    return own.select(key, F.explode("own").alias("seed_id")).join(near, "seed_id").repartition(parts, key), own


def seed_candidates(queries: DataFrame, neighbors: DataFrame, k: int = 200, key: str = "query_id") -> DataFrame:
    """key, source, seed_id, candidate_id, rank: each seed's neighbors without seeds of the query, ranked anew, at most k.

    A seed without neighbors gives nothing. A seed's neighbors travel as one list to the
    query, so the only shuffle of what is looked up is of a row per (key, source, seed);
    the rows that come of it lie by key, and later steps that group by it need no other.
    ``neighbors`` may also be such lists already (source, seed_id, near).
    """
    looked_up, own = _looked_up(queries, neighbors, key)
    left = F.filter("near", lambda x: ~F.array_contains("own", x))
    allowed = looked_up.join(own, key).select(key, "source", "seed_id", F.slice(left, 1, k).alias("near"))
    return allowed.select(key, "source", "seed_id", F.posexplode("near").alias("rank", "candidate_id")).select(key, "source", "seed_id", F.col("candidate_id").cast("long").alias("candidate_id"), (F.col("rank") + 1).alias("rank"))


def narrowed(lists: DataFrame) -> DataFrame:
    """Lists of neighbors as short numbers, if all are: what travels to the queries is little else."""
    ends = lists.agg(F.min(F.array_min("near")).alias("least"), F.max(F.array_max("near")).alias("most")).first()
    return lists.withColumn("near", F.col("near").cast(f"array<{narrow(ends['least'], ends['most'])}>"))


def source_ranks(per_seed: DataFrame, k: int = 200, key: str = "query_id") -> DataFrame:
    """key, source, candidate_id, support, best_rank, rank: by (support desc, best rank, id), at most k.

    ``per_seed`` has one row per (key, source, seed_id, candidate_id), as seed_candidates gives them.
    """
    merged = per_seed.groupBy(key, "source", "candidate_id").agg(F.count("seed_id").alias("support"), F.min("rank").alias("best_rank"))
    w = Window.partitionBy(key, "source").orderBy(F.desc("support"), "best_rank", "candidate_id")
    return merged.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def flat_lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The row of each entry of a column of lists, and the entries."""
    return np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)), lists.flatten()


def coded_ids(ids: np.ndarray, others: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Codes in the order of the ids, those of ``others`` (-1: not among them), their number, which times ``most`` is a long, and the ids by code where they aren't a range from its only entry on."""
    low, high = (int(ids.min()), int(ids.max())) if len(ids) else (0, 0)
    if (high - low + 1) * most < 1 << 62:
        return ids - low, np.where((others >= low) & (others <= high), np.clip(others, low, high) - low, -1), high - low + 1, np.array([low])
    values, codes = np.unique(ids, return_inverse=True)
    at = np.minimum(np.searchsorted(values, others), len(values) - 1)
    return codes, np.where(values[at] == others, at, -1), len(values), values


def _begins(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]) if len(sorted_keys) else np.zeros(0, np.int64)


def _places(groups: np.ndarray) -> np.ndarray:
    """The place of each row, from 1, in its group; rows of a group lie next to each other."""
    begin = _begins(groups)
    return np.arange(1, len(groups) + 1) - np.repeat(begin, np.diff(np.r_[begin, len(groups)]))


def _ranked_seeds(at: pa.Array, own: pa.Array, per_seed: int, per_source: int) -> pa.Array:
    """For each query, from its lists (source, near) and seeds, an entry a source: its candidates with support, best rank and rank."""
    query, entries = flat_lists(at)
    source = entries.field("source").dictionary_encode()
    n_sources = max(1, len(source.dictionary))
    group = query * n_sources + source.indices.to_numpy(zero_copy_only=False)
    entry, ids = flat_lists(entries.field("near"))
    ids = ids.to_numpy(zero_copy_only=False).astype(np.int64)
    owner, seeds = flat_lists(own)
    ids, seeds, span, values = coded_ids(ids, seeds.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(at)) * n_sources)
    seeds = np.sort((owner * span + seeds)[seeds >= 0])
    if len(seeds):  # the query's own seeds go before its lists are ranked
        cell = query[entry] * span + ids
        left = seeds[np.minimum(np.searchsorted(seeds, cell), len(seeds) - 1)] != cell
        entry, ids = entry[left], ids[left]
    rank = _places(entry)
    if len(rank) and rank.max() > per_seed:
        entry, ids, rank = (x[rank <= per_seed] for x in (entry, ids, rank))
    cell = group[entry] * span + ids
    order = np.argsort(cell)
    cell, begin = cell[order], _begins(cell[order])
    support = np.diff(np.r_[begin, len(cell)])
    best = np.minimum.reduceat(rank[order], begin) if len(begin) else rank
    group, ids = np.divmod(cell[begin], span)
    order = np.lexsort((best, -support, group))  # stable: ids stay in order
    group, ids, support, best = (x[order] for x in (group, ids, support, best))
    place = _places(group)
    group, ids, support, best, place = (x[place <= per_source] for x in (group, ids, support, best, place))
    begin = _begins(group)
    ids = ids + values[0] if len(values) == 1 else values[ids]
    rows = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.array(support, pa.int64()), pa.array(best, pa.int32()), pa.array(place, pa.int32())], ["candidate_id", "support", "best_rank", "rank"])
    found = pa.ListArray.from_arrays(pa.array(np.r_[begin, len(group)].astype(np.int32)), rows)
    named = pa.StructArray.from_arrays([source.dictionary.take(pa.array(group[begin] % n_sources)), found], ["source", "found"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(group[begin] // n_sources, np.arange(len(at) + 1)).astype(np.int32)), named)


def rank_lists(queries: DataFrame, neighbors: DataFrame, per_seed: int = 200, per_source: int = 200, key: str = "query_id", beside: DataFrame | None = None) -> DataFrame:
    """key, lists: what ``source_ranks`` makes of ``seed_candidates``, a row a query with an entry (source, found) a source.

    A query's lists of neighbors meet in one row, and are ranked by arrays in the task
    that has them. Spark doesn't know any more how the rows are dealt out, so what needs
    all of a query is best made of its row; ``beside`` (key, ...) adds columns to it.
    """

    @F.arrow_udf(f"array<struct<source: string, found: {_FOUND}>>")
    def ranked_lists(at: pa.Array, own: pa.Array) -> pa.Array:
        row, entries = flat_lists(at)
        size = np.cumsum(np.bincount(row, pc.list_value_length(entries.field("near")).to_numpy(zero_copy_only=False), len(at)))
        cuts = np.unique(np.r_[0, np.flatnonzero(np.diff(size // STEP_NEIGHBORS)) + 1, len(at)])
        return pa.concat_arrays([_ranked_seeds(at.slice(a, b - a), own.slice(a, b - a), per_seed, per_source) for a, b in zip(cuts[:-1], cuts[1:], strict=True)] or [_ranked_seeds(at, own, per_seed, per_source)])

    looked_up, own = _looked_up(queries, neighbors, key)
    at = looked_up.groupBy(key).agg(F.collect_list(F.struct("source", "near")).alias("at")).join(own, key)
    at, kept = (at, []) if beside is None else (at.join(beside, key, "left"), [c for c in beside.columns if c != key])
    return at.select(key, ranked_lists("at", "own").alias("lists"), *kept)


def seed_ranks(queries: DataFrame, neighbors: DataFrame, per_seed: int = 200, per_source: int = 200, key: str = "query_id") -> DataFrame:
    """key, source, candidate_id, support, best_rank, rank: ``source_ranks`` of ``seed_candidates``, by ``rank_lists``."""
    return rank_lists(queries, neighbors, per_seed, per_source, key).select(key, F.inline("lists")).select(key, "source", F.inline("found"))


def fused_lists(lists: DataFrame, sources: tuple[str, ...] = SOURCES, constant: int = 60, limit: int | None = 300) -> DataFrame:
    """``lists`` with ``fused`` instead of ``lists``: the rows that ``fuse_rrf`` makes of ``pivot_ranks``, by fused_rank."""
    ranks = [f"{s}_rank" for s in sources]

    @F.arrow_udf(f"array<struct<candidate_id: bigint, {', '.join(f'`{r}`: int' for r in ranks)}, source_count: int, rrf_score: double, fused_rank: int>>")
    def fused(lists: pa.Array) -> pa.Array:
        query, entries = flat_lists(lists)
        source = pc.fill_null(pc.index_in(entries.field("source"), value_set=pa.array(sources, pa.string())), -1).to_numpy(zero_copy_only=False)
        entry, rows = flat_lists(entries.field("found"))
        ids, _, span, values = coded_ids(rows.field("candidate_id").to_numpy(zero_copy_only=False), np.zeros(0, np.int64), max(1, len(lists)))
        cell = query[entry] * span + ids
        order = np.argsort(cell)
        begin, cell = _begins(cell[order]), cell[order]
        count = np.diff(np.r_[begin, len(cell)])
        table = np.zeros((len(sources) + 1, len(begin)), np.int32)  # the last row: sources that aren't asked for
        table[source[entry][order], np.repeat(np.arange(len(begin)), count)] = rows.field("rank").to_numpy(zero_copy_only=False)[order]
        query, ids = np.divmod(cell[begin], span)
        score = np.zeros(len(begin))
        for own in table[:-1]:
            score = score + np.where(own > 0, 1.0 / (float(constant) + own), 0.0)
        order = np.lexsort((-np.round(score, 12), query))  # stable: ids stay in order
        place = _places(query[order])
        if limit:
            order, place = order[place <= limit], place[place <= limit]
        ids = ids[order] + values[0] if len(values) == 1 else values[ids[order]]
        columns = [pa.array(ids, pa.int64()), *(pa.array(own[order], pa.int32()) for own in table[:-1]), pa.array(count[order], pa.int32()), pa.array(score[order]), pa.array(place, pa.int32())]
        offsets = np.searchsorted(query[order], np.arange(len(lists) + 1)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, ["candidate_id", *ranks, "source_count", "rrf_score", "fused_rank"]))

    return lists.withColumn("fused", fused("lists")).drop("lists")


def pivot_ranks(ranks: DataFrame, sources: tuple[str, ...] = SOURCES, key: str = "query_id") -> DataFrame:
    """key, candidate_id, <source>_rank for each source (0: absent), source_count."""
    out = ranks.groupBy(key, "candidate_id").agg(
        *[F.coalesce(F.max(F.when(F.col("source") == s, F.col("rank"))), F.lit(0)).cast("int").alias(f"{s}_rank") for s in sources], F.count_distinct("source").cast("int").alias("source_count")
    )
    return out


def fuse_rrf(pivoted: DataFrame, sources: tuple[str, ...] = SOURCES, constant: int = 60, limit: int | None = 300, key: str = "query_id") -> DataFrame:
    """``pivoted`` with rrf_score and fused_rank by (score desc, id), at most ``limit``."""
    rows = pivoted.withColumn("rrf_score", rrf_score([F.col(f"{s}_rank") for s in sources], constant))
    w = Window.partitionBy(key).orderBy(F.desc(F.round("rrf_score", 12)), "candidate_id")
    rows = rows.withColumn("fused_rank", F.row_number().over(w))
    return rows.where(F.col("fused_rank") <= limit) if limit else rows


def cap_candidates(pivoted: DataFrame, limit: int = 300, sources: tuple[str, ...] = SOURCES, constant: int = 60, key: str = "query_id") -> DataFrame:
    """At most ``limit`` candidates of a query by fused ranks alone; labels have no part in it."""
    return fuse_rrf(pivoted, sources, constant, limit, key).drop("rrf_score", "fused_rank")


def label(candidates: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """``candidates`` with label: 1 if the query's truth has the candidate, else 0."""
    rows = candidates.join(_lists(queries, "truth", "_truth", key), key, "left")  # by key alone: candidates already lie by it
    return _labelled(rows)


def _labelled(rows: DataFrame) -> DataFrame:
    return rows.withColumn("label", F.coalesce(F.array_contains("_truth", F.col("candidate_id")).cast("int"), F.lit(0))).drop("_truth")


def candidate_stats(labelled: DataFrame, queries: DataFrame, key: str = "query_id") -> DataFrame:
    """One row: queries, candidates, positives, unretrieved, zero_candidate_queries, zero_positive_queries."""
    per_query = labelled.groupBy(key).agg(F.count(F.lit(1)).alias("c"), F.sum("label").alias("p"))
    rows = queries.select(key, F.size(F.array_distinct("truth")).alias("t")).join(per_query, key, "left").fillna(0, ["c", "p"])
    return rows.agg(
        F.count(F.lit(1)).alias("queries"),
        F.coalesce(F.sum("c"), F.lit(0)).alias("candidates"),
        F.coalesce(F.sum("p"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum(F.col("t") - F.col("p")), F.lit(0)).alias("unretrieved"),
        F.count_if(F.col("c") == 0).alias("zero_candidate_queries"),
        F.count_if(F.col("p") == 0).alias("zero_positive_queries"),
    )


def build_candidates(queries: DataFrame, neighbors: DataFrame, sources: tuple[str, ...] = SOURCES, per_seed: int = 200, per_source: int = 200, limit: int = 300, exclude: DataFrame | None = None, key: str = "query_id") -> DataFrame:
    """key, candidate_id, <source>_rank..., source_count, label.

    ``exclude`` (key, candidate_id) takes more items out, say the whole history;
    without it only seeds are taken out, so older items may come back with label 0.
    """
    if exclude is not None:
        ranks = source_ranks(seed_candidates(queries, neighbors, per_seed, key), per_source, key).join(exclude.select(key, "candidate_id").distinct(), [key, "candidate_id"], "left_anti")
        return label(cap_candidates(pivot_ranks(ranks, sources, key), limit, sources, key=key), queries, key)
    lists = rank_lists(queries, neighbors, per_seed, per_source, key, _lists(queries, "truth", "_truth", key))
    return _labelled(fused_lists(lists, sources, limit=limit).select(key, "_truth", F.inline("fused"))).drop("rrf_score", "fused_rank")


def union_candidates(a: DataFrame, b: DataFrame, key: str = "query_id") -> DataFrame:
    """The distinct (key, candidate_id) of both."""
    return a.select(key, "candidate_id").unionByName(b.select(key, "candidate_id")).distinct()


def align(history: DataFrame, targets: DataFrame, key: str = "user_id") -> DataFrame:
    """Both tables joined on the key; a key that only one of them has is an error."""
    alone = history.select(key).join(targets.select(key), key, "left_anti").limit(1).unionByName(targets.select(key).join(history.select(key), key, "left_anti").limit(1))
    if alone.take(1):
        raise ContractError(f"history and targets differ in {key}")
    return history.join(targets, key)


def group_sizes(features: DataFrame, key: str = "query_id") -> DataFrame:
    """key, rows: the query groups of a feature table."""
    return features.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
