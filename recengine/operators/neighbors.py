"""Neighbor tables: co-occurrence graph, nearest vectors, quantisation.

Every function gives the neighbor-table contract: source, seed_id, candidate_id,
score, rank (from 1, by score descending and id ascending, the score rounded to 9
digits so that ties don't hang on the order of sums).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recengine.sources.scratch import discard, scratch_path, shuffles_deleted, written

#: Vectors of a block of the exact search, about, most blocks, and least query vectors of a chunk where there are enough tasks.
BLOCK_ROWS, MOST_BLOCKS, LEAST_QUERY_ROWS = 4096, 1024, 512
#: Query vectors and vectors that a task of the search beyond the own blocks meets at most, about, and products it makes at a time.
CHUNK_QUERIES, CHUNK_ROWS, STEP_PRODUCTS = 32_768, 1 << 19, 1 << 22
#: Vectors that a round of that search may shuffle at least; with more of them and of queries than that, about as many as there are.
ROUND_ROWS = 1 << 20
#: Items of one user in a row of the graph's tiles, about, pairs of a tile, about, and pairs that a task makes at a time.
LIST_ITEMS, BLOCK_PAIRS, TILE_PAIRS = 4096, 1 << 21, 1 << 21
_DIGITS = 9


def ranked(edges: DataFrame, source: str, k: int) -> DataFrame:
    """The best k candidates of each seed."""
    rows = edges.withColumn("score", F.round("score", _DIGITS))
    w = Window.partitionBy("seed_id").orderBy(F.desc("score"), "candidate_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.lit(source).alias("source"), "seed_id", "candidate_id", "score", "rank")


def bm25_weights(interactions: DataFrame, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """user_id, item_id, weight of the distinct (user, item) cells.

    idf of a user: ln(items) - ln(1 + items of the user); a weight is (k1 + 1) /
    (k1 * norm + 1) * idf with norm = 1 - b + b * users of the item / average.
    """
    norm = F.lit(1.0 - b) + F.lit(b) * F.col("users") / (F.col("n_cells") / F.col("n_items"))
    return _counted(interactions).select("user_id", "item_id", (F.lit(k1 + 1.0) / (F.lit(k1) * norm + 1.0) * F.col("idf")).alias("weight"))


def _counted(interactions: DataFrame) -> DataFrame:
    """What the weights of the distinct (user, item) cells are made of: users of the item, items and idf of the user, and n_items and n_cells of all."""
    cells = interactions.select("user_id", "item_id").repartition("user_id").distinct()  # by user: no further shuffle for the counts of users
    per_item = cells.groupBy("item_id").agg(F.count(F.lit(1)).alias("users"))
    per_user = cells.groupBy("user_id").agg(F.count(F.lit(1)).alias("items"))
    total = per_item.agg(F.count(F.lit(1)).alias("n_items"), F.sum("users").alias("n_cells"))
    user = per_user.join(F.broadcast(total)).select("user_id", "items", (F.ln(F.col("n_items").cast("double")) - F.ln(1.0 + F.col("items"))).alias("idf"), "n_items", "n_cells")
    return cells.join(user, "user_id").join(per_item, "item_id").select("user_id", "item_id", "users", "items", "idf", "n_items", "n_cells")


def _tile_sums(seed: np.ndarray, seed_weight: np.ndarray, first: np.ndarray, n: np.ndarray, item: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """seed, candidate and sum of weight products of each pair that occurs; seed k meets the n[k] items from first[k] on."""
    seeds, s = np.unique(seed, return_inverse=True)
    items, c = np.unique(item, return_inverse=True)
    total = int(n.sum())
    place = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(total)
    key = np.repeat(s * len(items), n) + c[place]
    value = np.repeat(seed_weight, n) * weight[place]
    cells = len(seeds) * len(items)
    if cells <= 4 * total + (1 << 16):  # most pairs of the tile occur
        there = np.flatnonzero(np.bincount(key, minlength=cells))
        sums = np.bincount(key, value, cells)[there]
    else:
        order = np.argsort(key, kind="stable")
        key, value = key[order], value[order]
        begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if total else np.zeros(0, np.int64)
        there, sums = key[begin], np.add.reduceat(value, begin) if total else value
    return seeds[there // max(1, len(items))], items[there % max(1, len(items))] if len(items) else there, sums


class _Tile:
    """The summed pairs of one (seed block, item block)."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, seeds: pa.Array, seed_users: pa.Array, items: pa.Array, users: pa.Array, idf: np.ndarray, factor: Callable[[np.ndarray], np.ndarray]) -> None:
        """Rows of (seeds, items, both with their numbers of users, idf) of one user each; their pairs are made TILE_PAIRS at a time. A weight is ``factor`` of the users times idf."""
        n_seeds, n_items = np.diff(seeds.offsets.to_numpy()), np.diff(items.offsets.to_numpy()).astype(np.int64)
        seed, seed_weight, item, weight = (x.flatten().to_numpy(zero_copy_only=False) for x in (seeds, seed_users, items, users))
        seed, item = seed.astype(np.int64), item.astype(np.int64)
        seed_weight, weight = factor(seed_weight) * np.repeat(idf, n_seeds), factor(weight) * np.repeat(idf, n_items)
        first, n = np.repeat(np.cumsum(n_items) - n_items, n_seeds), np.repeat(n_items, n_seeds)
        piece = np.cumsum(n) // TILE_PAIRS
        cuts = np.r_[0, np.flatnonzero(np.diff(piece)) + 1, len(n)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if a < b:
                lo, hi = int(first[a]), int(first[b - 1] + n[b - 1])
                self.parts.append(_tile_sums(seed[a:b], seed_weight[a:b], first[a:b] - lo, n[a:b], item[lo:hi], weight[lo:hi]))
                if sum(len(x[0]) for x in self.parts[1:]) > TILE_PAIRS:
                    self.fold()

    def fold(self) -> None:
        seed, item, value = (np.concatenate([p[k] for p in self.parts]) for k in range(3))
        order = np.lexsort((item, seed))
        seed, item, value = seed[order], item[order], value[order]
        begin = np.flatnonzero(np.r_[True, (seed[1:] != seed[:-1]) | (item[1:] != item[:-1])])
        self.parts = [(seed[begin], item[begin], np.add.reduceat(value, begin))]

    def best(self, k: int) -> pa.RecordBatch:
        if len(self.parts) > 1:
            self.fold()
        seed, item, value = self.parts[0] if self.parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        own = seed != item
        seed, item, value = seed[own], item[own], np.round(value[own], _DIGITS)
        order = np.lexsort((item, -value, seed))
        ordered = seed[order]
        place = np.arange(len(order)) - np.searchsorted(ordered, ordered)  # within each seed
        order, place = order[place < k], place[place < k]
        return pa.RecordBatch.from_arrays([pa.array(seed[order], pa.int64()), pa.array(item[order], pa.int64()), pa.array(value[order], pa.float64()), pa.array(place + 1, pa.int32())], ["seed_id", "candidate_id", "score", "rank"])

    def best_lists(self, k: int) -> pa.RecordBatch:
        """One row a seed: its candidates of ``best`` in their order."""
        rows = self.best(k)
        seed = rows.column(0).to_numpy()
        begin = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]]) if len(seed) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(seed[begin], pa.int64()), pa.ListArray.from_arrays(pa.array(np.r_[begin, len(seed)].astype(np.int32)), rows.column(1))], ["seed_id", "near"])


def graph_tiles(asked: DataFrame, weights: DataFrame, seed_blocks: int, item_blocks: int) -> DataFrame:
    """seed_block, item_block, seeds, seed_weights, items, weights: of both tables (user_id, item_id, weight) the items of a user in a pair of blocks, one row each. With a column idf of the second: also idf, one value of the user."""
    idf = [c for c in ("idf",) if c in weights.columns]

    def segments(rows: DataFrame, n: int, block: str, item: str, weight: str, *more: str) -> DataFrame:
        place = F.pmod(F.xxhash64(F.lit(block), F.col("item_id").cast("long")), F.lit(n)).cast("int")
        lists = rows.repartition("user_id").groupBy("user_id", place.alias(block)).agg(F.collect_list(F.struct("item_id", "weight")).alias("own"), *[F.max(c).alias(c) for c in more])
        return lists.select("user_id", block, F.col("own.item_id").alias(item), F.col("own.weight").alias(weight), *more)

    both = segments(asked, seed_blocks, "seed_block", "seeds", "seed_weights").join(segments(weights, item_blocks, "item_block", "items", "weights", *idf), "user_id")
    return both.select("seed_block", "item_block", "seeds", "seed_weights", "items", "weights", *idf)


def narrow(least: int | None, most: int | None) -> str:
    """The shortest type of whole numbers that holds all from least to most."""
    size = max(abs(least or 0), abs(most or 0))
    return "smallint" if size < 1 << 15 else "int" if size < 1 << 31 else "bigint"


def item_graph(interactions: DataFrame, k: int = 200, k1: float = 1.2, b: float = 0.75, seeds: DataFrame | None = None, blocks: tuple[int, int] | None = None, lists: bool = False) -> DataFrame:
    """Items by the sum over common users of the products of their BM25 weights; co-occurring items stay at score 0.

    The product of the users x items table with itself, in tiles: items are hashed into
    ``blocks`` of seeds and of candidates, a user is one row for each pair of blocks in
    which it has items, and a task makes the pairs of a tile, sums them up in a stream
    and gives the best k candidates of each seed. A history of h items thus is at most
    (seed blocks x item blocks) rows, each with the two short lists, dealt out to as
    many tasks, instead of h * h rows of one user. There are as many tiles as the pairs
    need, and several blocks of candidates only for histories of over LIST_ITEMS; with
    one block a tile holds all of a seed and ranks it. A tile gets the numbers of users
    of its items and the user's idf, and makes the weights of them. ``seeds`` (seed_id)
    limits the seeds. ``lists``: source, seed_id, near, a row a seed with its candidates
    by rank, written, instead of a row each.
    """
    w = written(_counted(interactions), "bm25")
    spark = w.sparkSession
    n = w.agg(
        F.coalesce(F.sum("items"), F.lit(0)).alias("pairs"), F.coalesce(F.max("items"), F.lit(1)).alias("longest"), F.approx_count_distinct("item_id").alias("items"),
        F.min("item_id").alias("least"), F.max("item_id").alias("most"), F.max("users").alias("users"), F.max("n_cells").alias("n_cells"), F.max("n_items").alias("n_items"),
    ).first()
    if blocks is None:
        wide = -(-n["longest"] // LIST_ITEMS)
        wanted = max(-(-n["pairs"] // BLOCK_PAIRS), 4 * spark.sparkContext.defaultParallelism)
        blocks = max(1, min(-(-wanted // wide), n["items"])), wide
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    average = n["n_cells"] / n["n_items"] if n["n_items"] else 1.0
    factor = lambda users: (k1 + 1.0) / (k1 * ((1.0 - b) + b * users.astype(np.float64) / average) + 1.0)
    bm25, w = w, w.select("user_id", F.col("item_id").cast(narrow(n["least"], n["most"])).alias("item_id"), F.col("users").cast(narrow(0, n["users"])).alias("weight"), "idf")

    asked = w if seeds is None else w.join(seeds.select(F.col("seed_id").alias("item_id")).distinct(), "item_id", "left_semi")
    tiles = graph_tiles(asked, w, *blocks).repartition(parts, "seed_block", "item_block").sortWithinPartitions("seed_block", "item_block")

    listed = lists and blocks[1] == 1
    found = lambda tile: tile.best_lists(k) if listed else tile.best(k)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, _Tile()
        for batch in batches:
            one, two = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.r_[0, np.flatnonzero((np.diff(one) != 0) | (np.diff(two) != 0)) + 1, len(one)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a < b and (one[a], two[a]) != key:
                    if key is not None:
                        yield found(tile)
                    key, tile = (one[a], two[a]), _Tile()
                tile.add(*(batch.column(c).slice(a, b - a) for c in range(2, 6)), batch.column(6).to_numpy()[a:b], factor)
        if key is not None:
            yield found(tile)

    best = tiles.mapInArrow(fold, "seed_id long, near array<long>" if listed else "seed_id long, candidate_id long, score double, rank int")
    if lists:
        near = best.select(F.lit("item_graph").alias("source"), "seed_id", "near") if listed else neighbor_lists(ranked(best.drop("rank"), "item_graph", k))
        near = written(near, "graph-lists")
        discard(bm25)
        return near
    if blocks[1] == 1:
        return best.select(F.lit("item_graph").alias("source"), "seed_id", "candidate_id", "score", "rank")
    return ranked(best.drop("rank"), "item_graph", k)


def neighbor_lists(neighbors: DataFrame) -> DataFrame:
    """source, seed_id, near: a row a seed of a neighbor table, its candidates by rank."""
    near = neighbors.groupBy("source", "seed_id").agg(F.array_sort(F.collect_list(F.struct("rank", "candidate_id"))).alias("near"))
    return near.select("source", "seed_id", F.transform("near", lambda x: x["candidate_id"].cast("long")).alias("near"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalize(v: Column) -> Column:
    """Unit length as doubles; a zero vector stays as it is."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(x.cast("double")))


def _best_pairs(placed: DataFrame, k: int) -> DataFrame:
    """seed_id, candidate_id, score: for each (block, chunk) the k best of its rows for each of its queries, one matrix product."""

    def search(group: pa.Table) -> pa.Table:
        is_query = group["query"].to_numpy(zero_copy_only=False)
        ids = group["id"].to_numpy()
        matrix = group["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), -1)
        q_ids, b_ids, items, asked = ids[is_query], ids[~is_query], matrix[~is_query].T, matrix[is_query]
        out_q, out_b, out_s = [], [], []
        for a in range(0, len(q_ids), 512):
            scores = np.round(asked[a : a + 512] @ items, _DIGITS) if len(b_ids) else np.zeros((len(q_ids[a : a + 512]), 0))
            for i, row in enumerate(scores):
                best = np.lexsort((b_ids, -row)) if len(row) <= 2 * k + 2 else None
                if best is None:  # all at least as good as the (k + 1)-th, then in order
                    floor = np.partition(row, len(row) - k - 1)[len(row) - k - 1]
                    near = np.flatnonzero(row >= floor)
                    best = near[np.lexsort((b_ids[near], -row[near]))]
                best = best[b_ids[best] != q_ids[a + i]][:k]
                out_q.append(np.full(len(best), q_ids[a + i])), out_b.append(b_ids[best]), out_s.append(row[best])
        flat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0), t)
        return pa.table({"seed_id": flat(out_q, pa.int64()), "candidate_id": flat(out_b, pa.int64()), "score": flat(out_s, pa.float64())})

    return placed.groupBy("block", "chunk").applyInArrow(search, "seed_id long, candidate_id long, score double")


def _met(visitors: DataFrame, base: DataFrame, per_chunk: int) -> DataFrame:
    """Rows of ``base`` and visitors of their blocks (block, id, v each), these in chunks, each of them with all rows of the block."""
    chunks = visitors.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / per_chunk).cast("int").alias("chunks"))
    plan = written(chunks.join(base.select("block").distinct(), "block"), "search-blocks")  # one row a block
    there = base.join(plan, "block").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    here = visitors.join(plan, "block").withColumn("chunk", F.pmod(F.xxhash64(F.lit(3), "id"), F.col("chunks")).cast("int"))
    columns = lambda d, query: d.select("block", "chunk", F.lit(query).alias("query"), "id", "v")
    return columns(here, True).unionByName(columns(there, False))


def _small_blocks(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``rows`` with blocks of more than 4 * BLOCK_ROWS vectors cut by a hash of the id; first: block, first, parts, where that has any vector."""
    cut = F.coalesce(F.col("first") + F.pmod(F.xxhash64(F.lit(2), "id"), F.col("parts")), F.lit(-1)).cast("int")
    return rows.join(F.broadcast(first), "block", "left").withColumn("block", cut).drop("first", "parts")


def nearest(
    vectors: DataFrame,
    k: int,
    source: str,
    metric: str = "cosine",
    queries: DataFrame | None = None,
    id_col: str = "item_id",
    vector_col: str = "vector",
    work: list[DataFrame] | None = None,
) -> DataFrame:
    """Exact k nearest vectors of each query vector (all by default), the vector itself left out.

    Vectors lie in blocks around pivots, at most MOST_BLOCKS of them; a block has a
    radius, and a large one is cut into several with the same pivot. A query first searches the block of its own pivot. Its product with any
    vector of another block is at most that with the pivot and its length times the
    radius, so it then visits only blocks that may beat, or tie with, the k-th score
    it has. Queries do so in chunks, by which the vectors of the blocks they visit stream,
    and rows and queries of a task are bounded. So many chunks at a time make a round that
    it shuffles about as many vectors as there are, which go before the next. Vectors in
    clusters are so compared with few others; with none, all pairs are computed, as an
    exact search then has to. ``metric`` is cosine or inner (product). ``work`` gets two
    tables (block, queries, rows): the visits of either step.
    """

    def prepared(d: DataFrame) -> DataFrame:
        v = F.col(vector_col)
        single = d.select(v).dtypes[0][1] == "array<float>"  # half as much to move; products are made of doubles
        v = l2_normalize(v.cast("array<double>")) if metric == "cosine" else v if single else v.cast("array<double>")
        return d.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))

    base = prepared(vectors)
    asked = base if queries is None else prepared(queries)
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    n = vectors.count()
    blocks = max(1, min(MOST_BLOCKS, n // BLOCK_ROWS))
    if blocks > 1:
        plain = base = written(base, "search-vectors")
        if queries is None:
            asked = base
        some = base.orderBy(F.xxhash64(F.lit(5), "id"), "id").select("v").limit(4 * blocks).collect()  # 4 * MOST_BLOCKS at most
        pivots = _apart(np.array([r["v"] for r in some]), blocks)
        base = written(_assigned(base, pivots), "search-base")
        asked = base if queries is None else written(_assigned(asked, pivots), "search-queries")
        discard(plain)
        stored = [base] if queries is None else [base, asked]
        starts, around = [], []
        for r in sorted(base.groupBy("block").agg(F.count(F.lit(1)).alias("n")).collect()):  # MOST_BLOCKS at most
            parts = -(-r["n"] // (4 * BLOCK_ROWS))
            starts.append((r["block"], len(around), parts))
            around += [pivots[r["block"]]] * parts
        pivots = np.array(around)
        starts = vectors.sparkSession.createDataFrame(starts, "block int, first int, parts int")
        base, asked = _small_blocks(base, starts), _small_blocks(asked, starts)
    else:
        base, asked = (d.select(F.lit(0).alias("block"), F.lit(0.0).alias("away"), "id", "v") for d in (base, asked))
    stats = written(base.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("radius")), "search-sizes")
    base, asked = base.select("block", "id", "v"), asked.select("block", "id", "v")
    per_chunk = max(LEAST_QUERY_ROWS, min(4 * BLOCK_ROWS, n // max(1, tasks)))
    first = _best_pairs(_met(asked, base, per_chunk), k)
    if work is not None:
        counted = lambda d: d.groupBy("block").agg(F.count(F.lit(1)).alias("queries")).join(stats.select("block", F.col("n").alias("rows")), "block")
        work.append(written(counted(asked), "search-work"))
    if blocks == 1:
        return ranked(first, source, k)
    first = written(ranked(first, source, k), "search-own")
    floors = first.groupBy(F.col("seed_id").alias("id")).agg(F.count(F.lit(1)).alias("found"), F.min("score").alias("floor"))
    floors = floors.select("id", F.when(F.col("found") >= k, F.col("floor")).alias("floor"))
    radii = np.full(len(pivots), -1.0)
    for r in stats.collect():  # a row a block
        radii[r["block"]] = r["radius"]
    asked = asked.join(floors, "id", "left")
    more, visits = _elsewhere(asked, base, stats, pivots, radii, k, tasks)
    discard(*stored)
    if work is not None:
        work.append(visits.groupBy("block").agg(F.sum("queries").alias("queries")).join(stats.select("block", F.col("n").alias("rows")), "block"))
    return ranked(first.select("seed_id", "candidate_id", "score").unionByName(more), source, k)


def _matrix_of(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(batch.num_rows, -1)


def _apart(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` of the points, each the one farthest from those before."""
    chosen, away = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < min(n, len(points)):
        chosen.append(int(np.argmax(away)))
        away = np.minimum(away, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """block, away, id, v: the nearest pivot of each vector and its distance."""
    squares = (pivots**2).sum(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                v = _matrix_of(batch, "v")
                block = np.argmin(squares - 2 * (v @ pivots.T), axis=1)
                away = np.linalg.norm(v - pivots[block], axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(away), *(batch.column(batch.schema.get_field_index(c)) for c in ("id", "v"))], ["block", "away", "id", "v"])

    return rows.select("id", "v").mapInArrow(run, f"block int, away double, id long, v {rows.schema['v'].dataType.simpleString()}")


def _able(v: np.ndarray, length: np.ndarray, floor: np.ndarray, pivots: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Rows x blocks: whether a block may hold a product of at least the row's floor; a radius below 0: an empty block."""
    most = v @ pivots.T + length[:, None] * np.maximum(radii, 0)
    return (np.maximum(most * (1 + 1e-9), most) + 1e-7 >= floor[:, None]) & (radii >= 0)


def _visits(asked: DataFrame, pivots: np.ndarray, radii: np.ndarray) -> DataFrame:
    """chunk, block, queries: how many queries of a chunk may have one of their best in a block that isn't their own; floor null: in any that holds some."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                v, own, chunk = _matrix_of(batch, "v"), batch.column(1).to_numpy(), batch.column(0).to_numpy()
                floor = np.nan_to_num(batch.column(3).to_numpy(zero_copy_only=False), nan=-np.inf)
                able = _able(v, np.linalg.norm(v, axis=1), floor, pivots, radii)
                able[np.arange(len(own)), own] = False
                chunks, place = np.unique(chunk, return_inverse=True)
                sums = np.zeros((len(chunks), len(radii)), np.int64)
                np.add.at(sums, place, able)
                c, b = np.nonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array(chunks[c]), pa.array(b.astype(np.int32)), pa.array(sums[c, b])], ["chunk", "block", "queries"])

    rows = asked.select("chunk", "block", "v", "floor").mapInArrow(run, "chunk int, block int, queries long")
    return written(rows.groupBy("chunk", "block").agg(F.sum("queries").alias("queries")), "search-visits")  # chunks x blocks at most


class _Chunk:
    """Some queries in a task and the best of each so far, while vectors stream by."""

    def __init__(self, k: int, pivots: np.ndarray, radii: np.ndarray):
        self.k, self.pivots, self.radii = k, pivots, radii
        self.held: list[tuple[np.ndarray, ...]] = []
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.found: list[tuple[np.ndarray, ...]] = []
        self.n_found, self.v = 0, None

    def hold(self, own: np.ndarray, ids: np.ndarray, v: np.ndarray, floor: np.ndarray) -> None:
        self.held.append((own, ids, v, np.nan_to_num(floor, nan=-np.inf)))

    def meet(self, block: int, ids: np.ndarray, rows: np.ndarray) -> None:
        """The products of rows of one block with the queries of other blocks that it may serve; single precision only sorts out those that can't count."""
        if self.v is None:
            self.own, self.ids, self.v, self.floor = (np.concatenate(x) for x in zip(*self.held, strict=True))
            self.held, self.length, self.single = [], np.linalg.norm(self.v, axis=1), self.v.astype(np.float32)
        asked = np.flatnonzero(_able(self.v, self.length, self.floor, self.pivots[block : block + 1], self.radii[block : block + 1])[:, 0] & (self.own != block))
        single, slack = rows.astype(np.float32).T, 1e-5 * float(np.linalg.norm(rows, axis=1).max(initial=0))
        step = max(16, STEP_PRODUCTS // max(1, len(ids)))
        for a in range(0, len(asked), step):
            q = asked[a : a + step]
            scores, margin = self.single[q] @ single, slack * self.length[q] + 1e-7
            least = self.floor[q]
            if len(ids) > self.k + 1 and np.isinf(least).any():  # the (k + 1)-th of these rows: one of them may be the query itself
                least = np.maximum(least, np.partition(scores, len(ids) - self.k - 1, axis=1)[:, len(ids) - self.k - 1] - margin)
            least = (least - margin).astype(np.float32)
            hot = np.flatnonzero(~(scores.max(axis=1, initial=-np.inf) < least))  # most queries have none of these rows
            at = np.flatnonzero(~(scores[hot] < least[hot, None]))
            for c in range(0, len(at), 1 << 18):
                i, y = np.divmod(at[c : c + (1 << 18)], len(ids))
                x = q[hot[i]]
                exact = np.round(np.einsum("ij,ij->i", self.v[x], rows[y]), _DIGITS)
                kept = ~(exact < self.floor[x]) & (self.ids[x] != ids[y])
                self.found.append((x[kept], ids[y[kept]], exact[kept]))
                self.n_found += int(kept.sum())
                if self.n_found > max(1 << 20, len(self.v) * self.k // 4):
                    self.fold()

    def fold(self) -> None:
        x, ids, score = (np.concatenate(c) for c in zip(self.best, *self.found, strict=True))
        order = np.lexsort((ids, -score, x))
        x, ids, score = x[order], ids[order], score[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)  # within each query
        last = place == self.k - 1
        self.floor[x[last]] = np.fmax(self.floor[x[last]], score[last])
        self.best = tuple(c[place < self.k] for c in (x, ids, score))
        self.found, self.n_found = [], 0

    def rows(self) -> Iterator[pa.RecordBatch]:
        if self.v is not None:
            self.fold()
            x, ids, score = self.best
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[x]), pa.array(ids), pa.array(score)], ["seed_id", "candidate_id", "score"])


def _rounds(moved: dict[int, int], per_chunk: int, n: int, n_asked: int, tasks: int) -> list[tuple[list[int], int]]:
    """Chunks of each round and how many tasks each is; moved: vectors that stream by each chunk.

    A round shuffles ROUND_ROWS or n + n_asked vectors at most, if it isn't a single chunk.
    """
    most, rounds = max(ROUND_ROWS, n + n_asked), []
    parts_of = lambda c: max(-(-2 * tasks // len(c)), -(-n // CHUNK_ROWS))
    rows = lambda c: sum(moved[x] for x in c) + parts_of(c) * len(c) * per_chunk
    for chunk in sorted(moved):
        if rounds and rows([*rounds[-1], chunk]) <= most:
            rounds[-1].append(chunk)
        else:
            rounds.append([chunk])
    return [(c, parts_of(c)) for c in rounds]


def _elsewhere(asked: DataFrame, base: DataFrame, stats: DataFrame, pivots: np.ndarray, radii: np.ndarray, k: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """seed_id, candidate_id, score of the best of each query (block, id, v, floor) beyond its own block, and the visits.

    A chunk of queries, of one block or of blocks next to each other, lies in a task and
    the vectors of the blocks that any of them asks for stream by, so a vector moves once
    for each chunk instead of once for each query. A chunk may be several tasks, each with
    a part of the blocks' vectors: few chunks of few vectors give enough tasks, and many
    vectors are never too many for one. Chunks take turns: a round's best are written, and
    what it shuffled is deleted before the next one.
    """
    sizes = {r["block"]: r["queries"] for r in asked.groupBy("block").agg(F.count(F.lit(1)).alias("queries")).collect()}  # a row a block
    n_asked, n = sum(sizes.values()), stats.agg(F.sum("n")).first()[0]
    parts_of = lambda c: max(-(-2 * tasks // c), -(-n // CHUNK_ROWS))
    fewest = max(1, -(-n_asked // CHUNK_QUERIES))
    chunks = min(range(fewest, max(fewest, min(2 * tasks, n_asked // LEAST_QUERY_ROWS)) + 1), key=lambda c: c * n + parts_of(c) * n_asked * (1 + k / 20))
    per_chunk = max(1, -(-n_asked // chunks))
    starts, at = [], 0
    for block in sorted(sizes):
        starts.append((block, at, sizes[block]))
        at += sizes[block]
    spark = asked.sparkSession
    start = F.broadcast(spark.createDataFrame(starts, "block int, start long, queries long"))
    place = ((F.col("start") + F.pmod(F.xxhash64(F.lit(3), "id"), F.col("queries"))) / per_chunk).cast("int")
    asked = written(asked.join(start, "block").select(place.alias("chunk"), "block", "id", "v", "floor"), "search-asked")
    visits = _visits(asked, pivots, radii)
    moved = visits.join(F.broadcast(stats.select("block", F.col("n").alias("rows"))), "block").groupBy("chunk").agg(F.sum("rows").alias("rows"))
    moved = {r["chunk"]: r["rows"] for r in moved.collect()}  # a row a chunk
    columns = lambda d, task, kind, floor: d.select(task.cast("int").alias("task"), F.lit(kind).alias("kind"), "block", "id", "v", floor.alias("floor"))

    def dealt(own: list[int], parts: int) -> DataFrame:
        chunk, part = F.col("chunk") - own[0], F.pmod(F.xxhash64(F.lit(2), "id"), F.lit(parts)).cast("int")
        of = lambda d: d.where(F.col("chunk").between(own[0], own[-1]))
        here = columns(of(asked).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), chunk * parts + F.col("part"), 0, F.col("floor"))
        there = columns(base.join(F.broadcast(of(visits).select("chunk", "block")), "block"), chunk * parts + part, 1, F.lit(None).cast("double"))
        return here.unionByName(there).repartitionById((own[-1] - own[0] + 1) * parts, F.col("task")).sortWithinPartitions("task", "kind", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            task, kind, block, ids = (batch.column(c).to_numpy() for c in range(4))
            cuts = np.r_[0, np.flatnonzero((np.diff(task) != 0) | (np.diff(kind) != 0) | ((np.diff(block) != 0) & (kind[1:] == 1))) + 1, len(task)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if task[a] != key:
                    if state is not None:
                        yield from state.rows()
                    key, state = task[a], _Chunk(k, pivots, radii)
                part = batch.slice(a, b - a)
                if kind[a] == 0:
                    state.hold(block[a:b], ids[a:b], _matrix_of(part, "v"), part.column(5).to_numpy(zero_copy_only=False))
                elif state.held or state.v is not None:
                    state.meet(int(block[a]), ids[a:b], _matrix_of(part, "v"))
        if state is not None:
            yield from state.rows()

    best = "seed_id long, candidate_id long, score double"
    path = scratch_path(spark, "search-more")
    spark.createDataFrame([], best).write.parquet(path)
    for own, parts in _rounds(moved, per_chunk, n, n_asked, tasks):
        with shuffles_deleted(spark):
            ranked(dealt(own, parts).mapInArrow(run, best), "", k).select("seed_id", "candidate_id", "score").write.mode("append").parquet(path)
    discard(asked)
    return spark.read.schema(best).parquet(path), visits


def truncate(neighbors: DataFrame, depth: int) -> DataFrame:
    """The neighbor table cut at a smaller depth."""
    return neighbors.where(F.col("rank") <= depth)


def ranges(vectors: DataFrame, vector_col: str = "vector") -> DataFrame:
    """dim, low, high of each dimension."""
    x = vectors.select(F.posexplode(vector_col).alias("dim", "x"))
    return x.groupBy("dim").agg(F.min(F.col("x").cast("double")).alias("low"), F.max(F.col("x").cast("double")).alias("high"))


def quantize(vectors: DataFrame, bits: int, id_col: str = "item_id", vector_col: str = "vector") -> DataFrame:
    """id_col, codes, low, high: integer codes of ``bits`` bits on each dimension's range; a constant dimension is 0."""
    per_dim = ranges(vectors, vector_col).agg(F.array_sort(F.collect_list(F.struct("dim", "low", "high"))).alias("r"))  # one row, one entry per dimension
    bounds = per_dim.select(F.transform("r", lambda x: x["low"]).alias("low"), F.transform("r", lambda x: x["high"]).alias("high"))
    top = float(2**bits - 1)
    code = lambda x, i: F.when(F.get("high", i) > F.get("low", i), F.round((x.cast("double") - F.get("low", i)) / (F.get("high", i) - F.get("low", i)) * top)).otherwise(0.0).cast("int")
    return vectors.join(F.broadcast(bounds)).select(id_col, F.transform(vector_col, code).alias("codes"), "low", "high")


def dequantize(coded: DataFrame, bits: int, id_col: str = "item_id") -> DataFrame:
    """id_col, vector: the middle of what each code stands for."""
    top = float(2**bits - 1)
    value = lambda c, i: F.get("low", i) + c / top * (F.get("high", i) - F.get("low", i))
    return coded.select(id_col, F.transform("codes", value).alias("vector"))


def to_half(vectors: DataFrame, id_col: str = "item_id", vector_col: str = "vector") -> DataFrame:
    """Vectors rounded to half precision."""

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float16).astype(np.float64)
            offsets = pa.array(np.r_[0, np.cumsum(pa.compute.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False))].astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(values))], [id_col, "vector"])

    return vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(vector_col).cast("array<double>").alias("vector")).mapInArrow(half, f"{id_col} long, vector array<double>")


def squared_error(a: DataFrame, b: DataFrame, id_col: str = "item_id") -> DataFrame:
    """One row: vectors, mean_squared_error between two versions of the same vectors."""
    pairs = a.select(id_col, F.col("vector").alias("a")).join(b.select(id_col, F.col("vector").alias("b")), id_col)
    error = F.aggregate(F.zip_with("a", "b", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda s, x: s + x) / F.size("a")
    return pairs.agg(F.count(F.lit(1)).alias("vectors"), F.avg(error).alias("mean_squared_error"))
