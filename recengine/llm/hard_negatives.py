"""Hard negatives by exact integer products in a residue number system.

1. Components become integers floor(scale * x). Integer matrices are multiplied
   modulo several small primes, as float32 matrices of residues around zero: with
   primes this small a sum over STRIP components stays below 2 ** 24, where float32
   is exact; longer vectors are cut into strips. The primes are as many as the
   largest possible product needs, which follows from the largest norms.
2. The digits of each product in the mixed radix of the primes are found from its
   residues one after the other (Chinese remaindering), and give the exact, signed
   score.
3. Anchors lie in blocks of ANCHORS, all other rows are dealt out to parts. Every
   (block, part) is a stream in one task: the anchors first, then rows, of which only
   the best few for each anchor are kept. So memory is bounded by a block of anchors
   and a batch of rows, however many rows there are, and what leaves a task by the
   anchors. A row is copied once for each block of anchors.
4. The first pass finds each anchor's positives, multiplying rows of its own label
   only. In the second one each positive's score opens a window, in which the best
   rows of other labels are kept. Windows over (anchor) and (anchor, positive) fold
   the parts together.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recengine.llm._scratch import materialize

#: Components of one float32 product, and the largest modulus.
STRIP, MOST_PRIME = 128, 4096
#: Anchors of a block and their bytes at most; rows of a part at least (where there are enough tasks) and at most.
ANCHORS, ANCHOR_BYTES, LEAST_ROWS, MOST_ROWS = 2048, 64 << 20, 2048, 1 << 20
#: Entries of one matrix of scores.
TILE = 1 << 21
#: Scores have to stay below this size.
MOST_SCORE = 1 << 62


@lru_cache(maxsize=64)
def primes_for(dim: int, most: int) -> tuple[int, ...]:
    """Descending primes, whose residues allow exact float32 products of a strip, and whose product holds -most to most."""
    p = min(MOST_PRIME, 2 * isqrt(((1 << 24) - 1) // max(1, min(dim, STRIP))) + 1)
    out, product = [], 1
    while product < 2 * most + 1:
        while p > 2 and any(p % d == 0 for d in range(2, isqrt(p) + 1)):
            p -= 1
        if p <= 2:
            raise ValueError("not enough primes")
        out.append(p)
        product *= p
        p -= 1
    return tuple(out) or (3,)


def centred(x: np.ndarray, p: int) -> np.ndarray:
    """float32 integers below 2 ** 24 to their residues from -(p - 1) / 2 to (p - 1) / 2, in place."""
    for _ in range(2):  # the first quotient may be one off
        x -= np.rint(x * np.float32(1 / p)) * np.float32(p)
    return x


def residues(x: np.ndarray, primes: tuple[int, ...]) -> list[np.ndarray]:
    """The residues of an integer matrix modulo each prime, around zero, as float32."""
    out = []
    for p in primes:
        r = np.remainder(x, p)
        out.append(np.where(r > p // 2, r - p, r).astype(np.float32))
    return out


def product(left: list[np.ndarray], right: list[np.ndarray], primes: tuple[int, ...]) -> np.ndarray:
    """The exact int64 product of two integer matrices (rows by components) from their residues."""
    digits: list[np.ndarray] = []
    for a, b, p in zip(left, right, primes, strict=True):
        total = None
        for k in range(0, max(1, a.shape[1]), STRIP):
            part = centred(a[:, k : k + STRIP] @ b[:, k : k + STRIP].T, p)
            total = part if total is None else centred(total + part, p)
        for d, q in zip(digits, primes, strict=False):  # take off the digits so far
            inverse = pow(q, -1, p)
            total = centred(centred(total - d, p) * np.float32(inverse if inverse <= p // 2 else inverse - p), p)
        digits.append(total)
    out = digits[-1].astype(np.int64)
    for k in range(len(digits) - 2, -1, -1):
        out *= primes[k]
        out += digits[k].astype(np.int64)
    return out


def first_of(score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the first k by score descending, ident ascending."""
    at = np.arange(len(score))
    if len(at) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((ident[at], -score[at]))][:k]


def _matrix(column: pa.Array, dim: int, scale: float) -> np.ndarray:
    """Vectors as rows of floor(scale * x); shorter ones end in zeros."""
    sizes = pa.compute.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(column.flatten().to_numpy(zero_copy_only=False).astype(np.float64) * scale).astype(np.int64)
    out = np.zeros((len(column), dim), np.int64)
    out[np.arange(dim) < sizes[:, None]] = flat
    return out


class _Found:
    """For keys in a row, the first k pairs (score, ident) of each so far."""

    def __init__(self, keys: int, k: int):
        self.k = k
        self.score = [np.zeros(0, np.int64)] * keys
        self.ident = [np.zeros(0, np.int64)] * keys

    def floor(self, key: int) -> int | None:
        return int(self.score[key][-1]) if len(self.score[key]) == self.k else None

    def add(self, key: int, score: np.ndarray, ident: np.ndarray) -> None:
        if len(score):
            s, i = np.r_[self.score[key], score], np.r_[self.ident[key], ident]
            at = first_of(s, i, self.k)
            self.score[key], self.ident[key] = s[at], i[at]


def _streamed(placed: DataFrame, begin, meet, names: list[str], schema: str) -> DataFrame:
    """begin(anchors) for the anchors of each (block, part), then meet(state, rows) for its rows; the state's rows() leave at the end."""
    placed = placed.repartition("block", "part").sortWithinPartitions("block", "part", "is_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, anchors, state = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if state is not None:
                yield from state.rows(names)

        for batch in batches:
            block, part, is_row = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            cuts = np.r_[0, np.flatnonzero((np.diff(block) != 0) | (np.diff(part) != 0) | (np.diff(is_row.astype(np.int8)) != 0)) + 1, len(block)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if (block[a], part[a]) != key:
                    yield from done()
                    key, anchors, state = (block[a], part[a]), [], None
                if not is_row[a]:
                    anchors.append(batch.slice(a, b - a))
                elif anchors:
                    if state is None:
                        state = begin(pa.Table.from_batches(anchors).combine_chunks().to_batches()[0])
                    meet(state, batch.slice(a, b - a))
        yield from done()

    return placed.mapInArrow(run, schema)


def mine(
    vectors: DataFrame,
    anchors: DataFrame,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: float = 256.0,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for the ``anchors``, a selection of the rows of ``vectors``.

    A score is the integer product of floor(scale * component) with the anchor; higher
    ones come first, ties by smaller id. An anchor's positives are its first
    ``positives`` other rows of the same label; for each of them come the first
    ``negatives`` rows of other labels with low * positive_score <= 100 *
    negative_score <= high * positive_score. An anchor without positives, or a
    positive without such rows, gives no rows.

    Rows with a null id, label or vector, or a null, NaN or infinite component take no
    part. A shorter vector counts as if it ended in zeros. Rows with the anchor's id are
    neither its positives nor its negatives; other repeated rows count each, and
    anchors that repeat id, label and vector count once. Other columns may have any
    names. Scores that 2 ** 62 doesn't bound are an error. An empty table gives no rows.
    """

    def fit(rows: DataFrame) -> DataFrame:
        own = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
        finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
        return own.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & finite)

    spark = vectors.sparkSession
    rows, asked = fit(vectors), materialize(fit(anchors).dropDuplicates(), "anchors")
    whole = lambda x: F.floor(x.cast("double") * scale).cast("double")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + whole(x) * whole(x)))
    bounds = lambda d: d.agg(F.count(F.lit(1)), F.coalesce(F.max(norm), F.lit(0.0)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    (n, norm_all, dim), (n_asked, norm_asked, dim_asked) = bounds(rows), bounds(asked)
    dim = max(1, dim, dim_asked)
    most = norm_all * norm_asked * (1 + 1e-6) + 1
    if not most < MOST_SCORE:
        raise ValueError("scores may not fit into 64 bits: use a smaller scale")
    primes = primes_for(dim, int(most))

    tasks = spark.sparkContext.defaultParallelism
    per_block = max(1, min(ANCHORS, ANCHOR_BYTES // (4 * dim * len(primes))))
    blocks = max(1, -(-n_asked // per_block))
    parts = max(1, -(-n // MOST_ROWS), min(-(-2 * tasks // blocks), n // LEAST_ROWS))
    deal = lambda n, *salt: F.pmod(F.xxhash64(*map(F.lit, salt), "id", "label"), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    there = rows.withColumn("block", copies(blocks)).select("block", deal(parts, 1).alias("part"), F.lit(True).alias("is_row"), "id", "label", "v", F.lit(None).cast("long").alias("key"), F.lit(None).cast("array<long>").alias("wanted"))
    asked = asked.withColumn("key", F.xxhash64("id", "label", "v"))

    def placed(here: DataFrame) -> DataFrame:
        here = here.withColumn("part", copies(parts)).select(deal(blocks, 2).alias("block"), "part", F.lit(False).alias("is_row"), "id", "label", "v", "key", "wanted")
        return here.unionByName(there)

    step = max(1, TILE // 8192)

    class Block:
        """The anchors of a block, in order of their labels, and what was found for them."""

        def __init__(self, batch: pa.RecordBatch, wanted: bool):
            order = np.argsort(batch.column(4).to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            self.id, self.label, self.key = (batch.column(k).to_numpy() for k in (3, 4, 6))
            self.parts = residues(_matrix(batch.column(5), dim, scale), primes)
            self.wanted = batch.column(7).to_pylist() if wanted else None
            self.first = np.r_[0, np.cumsum([len(w) for w in self.wanted])] if wanted else None
            self.found = _Found(int(self.first[-1]), negatives) if wanted else _Found(len(self.id), positives)

        def rows(self, names: list[str]) -> Iterator[pa.RecordBatch]:
            n = [len(s) for s in self.found.score]
            if not sum(n):
                return
            if self.wanted is None:
                own, extra = np.arange(len(self.id)), []
            else:
                own = np.repeat(np.arange(len(self.id)), np.diff(self.first))
                extra = [pa.array(np.repeat(np.arange(len(own)) - self.first[own], n).astype(np.int32))]
            own = np.repeat(own, n)
            yield pa.RecordBatch.from_arrays([pa.array(self.key[own]), pa.array(self.id[own]), *extra, pa.array(np.concatenate(self.found.ident)), pa.array(np.concatenate(self.found.score))], names)

    def near(state: Block, batch: pa.RecordBatch) -> None:
        order = np.argsort(batch.column(4).to_numpy(), kind="stable")
        ids, labels = batch.column(3).to_numpy()[order], batch.column(4).to_numpy()[order]
        matrix = None
        for label in np.intersect1d(state.label, labels):
            lo, hi = np.searchsorted(labels, [label, label + 1])
            if matrix is None:
                matrix = residues(_matrix(batch.column(5), dim, scale)[order], primes)
            first, last = np.searchsorted(state.label, [label, label + 1])
            for a in range(first, last, step):
                b = min(last, a + step)
                scores = product([x[a:b] for x in state.parts], [x[lo:hi] for x in matrix], primes)
                for k in range(a, b):
                    floor = state.found.floor(k)
                    hit = ids[lo:hi] != state.id[k]
                    if floor is not None:
                        hit &= scores[k - a] >= floor
                    state.found.add(k, scores[k - a][hit], ids[lo:hi][hit])

    def negative(state: Block, batch: pa.RecordBatch) -> None:
        ids, labels = batch.column(3).to_numpy(), batch.column(4).to_numpy()
        matrix = residues(_matrix(batch.column(5), dim, scale), primes)
        for a in range(0, len(state.id), step):
            b = min(len(state.id), a + step)
            scores = product([x[a:b] for x in state.parts], matrix, primes)
            for k in range(a, b):
                # whole-number bounds of the window of each positive
                windows = [(-(-low * w // 100), high * w // 100) for w in state.wanted[k]]
                least, greatest = min(x[0] for x in windows), max(x[1] for x in windows)
                at = np.flatnonzero((scores[k - a] >= least) & (scores[k - a] <= greatest) & (labels != state.label[k]) & (ids != state.id[k]))
                s, i = scores[k - a][at], ids[at]
                for j, (lo, hi) in enumerate(windows):
                    floor = state.found.floor(int(state.first[k]) + j)
                    hit = (s >= (lo if floor is None else max(lo, floor))) & (s <= hi)
                    state.found.add(int(state.first[k]) + j, s[hit], i[hit])

    best = _streamed(placed(asked.withColumn("wanted", F.lit(None).cast("array<long>"))), lambda b: Block(b, False), near, ["key", "id", "positive_id", "positive_score"], "key long, id long, positive_id long, positive_score long")
    w = Window.partitionBy("key", "id").orderBy(F.desc("positive_score"), "positive_id")
    best = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= positives)
    lists = best.groupBy("key", "id").agg(F.array_sort(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))  # ``positives`` entries at most
    lists = materialize(lists, "positives")
    wanted = lists.select("key", "id", F.transform("p", lambda x: x["positive_score"]).alias("wanted"))
    found = _streamed(placed(asked.join(wanted, ["key", "id"])), lambda b: Block(b, True), negative, ["key", "id", "j", "negative_id", "negative_score"], "key long, id long, j int, negative_id long, negative_score long")
    w = Window.partitionBy("key", "id", "j").orderBy(F.desc("negative_score"), "negative_id")
    ranked = found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= negatives)
    of = F.get("p", F.col("j"))
    return ranked.join(lists, ["key", "id"]).select(F.col("id").alias("anchor_id"), of["positive_id"].alias("positive_id"), "rank", "negative_id", of["positive_score"].alias("positive_score"), "negative_score")
