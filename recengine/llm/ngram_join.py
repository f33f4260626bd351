"""Jaccard self-join of word-shingle sets with count-vector R-trees.

1. Every text becomes a set of hashed shingles. Equal sets are one class from
   here on. The same pass counts how often each of ``GROUPS`` hash groups occurs.
2. Two sets that link share a shingle among the first ``n - ceil(t n) + 1`` of each
   in any one order of all shingles. The order taken is by the rank of the count of
   the shingle's group, so shingles that many texts hold come last. Shingles that
   only one class has so early are dropped.
3. An early shingle of more than ``HOT`` classes says little. Classes that have one
   are ordered anew with all such shingles last: two of them that link and share
   only such ones so far share an early one in the new order too. This goes on, in
   ``ORDERS`` orders at most, while new common shingles turn up. What is still early
   and common then stays as it is, and so do at once the shingles of large groups of
   near copies: those whose classes have mostly common shingles among the early ones.
4. A class lives in the leaf named by its most common early shingle and visits the
   other leaves of the classes that it shares one with. In a leaf the group
   counts of the residents are points of an R-tree; the overlap of a visitor with
   a subtree is at most the sum of the coordinate minima of its counts and the
   subtree's upper corner. Up to here a class is its count vector; only the texts
   of classes in a surviving pair are read again to verify it on the shingles.
5. Leaves are cut into blocks. A pair that other links have already joined need
   not be verified: components are found after each round, and only pairs of
   blocks that still hold different components go on to the next one. So the work
   on a group of near copies grows with its size; only unlinked sets that are made
   of common shingles but for less than 1 - t of each still meet in pairs of blocks.

No pair is lost. Shingles are compared by 64-bit hashes of their words: among m
distinct ones about m * m / 2 ** 65 pairs agree by chance, and each of them changes
one overlap by one. Classes are told apart by 128 bits, and named by 64 of these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm._arrow import ASCII_LOWER, mix, steps, text_bytes, word_hashes, words
from recengine.llm._bitmap import Bitmap, broadcast_if_small
from recengine.llm._scratch import materialize
from recengine.llm.components import components

#: Hash groups whose counts order the shingles, and those of one written block; a task's counts are at most 4 MB.
GROUPS, GROUP_BLOCK = 1 << 20, 1 << 16
#: An early shingle of more classes than a block holds comes last in the next order, and the number of orders.
HOT, ORDERS = 256, 4
#: Bits of the filter over such shingles that tasks receive (a fixed 1 MB); others that it holds by chance come last with them.
HOT_BITS = 23
#: Least and most dimensions of a point; between, a power of two of about one for four shingles.
LEAST_DIMENSIONS, MOST_DIMENSIONS = 32, 1024
#: Classes of one block of a leaf, and children of a node of an R-tree.
BLOCK, FANOUT = 256, 16

#: Set in the key of a shingle that comes last.
_LAST = 1 << 62

_FACTORS = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """The distinct hashes, sorted, of each text's shingles of ``size`` words; of fewer words, the one of all words."""
    data, offs = text_bytes(column)
    data = ASCII_LOWER[data]
    start, end, doc = words(data, offs)
    h = word_hashes(data, start, end)
    bounds = np.searchsorted(doc, np.arange(len(column) + 1))
    n = max(0, len(h) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += h[k : k + n] * _FACTORS[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix((h[a:b] * _FACTORS[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def identity(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set; equal sets have equal ones."""
    with np.errstate(over="ignore"):
        return int(s.sum(dtype=np.uint64).view(np.int64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


def overlap_needed(n: int, percent: int) -> int:
    """The least overlap of a set of n shingles with any set that it links with."""
    return (percent * n + 99) // 100


def early(s: np.ndarray, ranks: np.ndarray, hot: np.ndarray | None, percent: int) -> np.ndarray:
    """The first shingles of a set in the common order, as keys that sort in it: hot ones last, then by the rank of their group."""
    keys = (ranks[(s >> np.uint64(40)).astype(np.int64) % len(ranks)].astype(np.uint64) << np.uint64(40)) | (s & np.uint64((1 << 40) - 1))
    if hot is not None:
        bit = keys & np.uint64((1 << HOT_BITS) - 1)
        keys |= (((hot[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1)) * np.uint64(_LAST))
    n = len(keys) - overlap_needed(len(keys), percent) + 1
    return np.sort(np.partition(keys, n - 1)[:n]) if n < len(keys) else np.sort(keys)


class RTree:
    """A packed R-tree over count vectors; a node keeps the upper corner and the least set size below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # neighbours in (size, leading counts) share a node
        self.order = np.lexsort((points[:, 1] if points.shape[1] > 1 else sizes, points[:, 0], sizes))
        upper, least = points[self.order], sizes[self.order]
        self.levels = [(upper, least)]
        while len(upper) > FANOUT:
            cuts = np.arange(0, len(upper), FANOUT)
            upper, least = np.maximum.reduceat(upper, cuts, axis=0), np.minimum.reduceat(least, cuts)
            self.levels.append((upper, least))

    def search(self, point: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Points whose bound allows a link with this one."""
        at = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            upper, least = self.levels[depth]
            bound = np.minimum(upper[at], point).sum(1)
            at = at[(100 + percent) * bound >= percent * (least[at] + size)]
            if depth:
                at = (at[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                at = at[at < len(self.levels[depth - 1][0])]
        return self.order[at]


def group_counts(s: np.ndarray) -> np.ndarray:
    """The point of a set: how many of its shingles fall into each hash group. Half the groups are two of these folded together."""
    d = 1 << int(np.clip(len(s) // 4, LEAST_DIMENSIONS, MOST_DIMENSIONS)).bit_length() - 1
    return np.bincount((s >> np.uint64(20)).astype(np.int64) % d, minlength=d)


def leaf_candidates(points: list[np.ndarray], resident: np.ndarray, among: bool, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each visitor (and resident, if ``among``) the residents (before it) that the R-trees leave.

    Residents of one dimension share a tree. Sets that link differ by less than two
    in size, so by one step of dimension at most; then both are taken at the lesser one.
    """
    homes: dict[int, list[int]] = {}
    for k in np.flatnonzero(resident):
        homes.setdefault(len(points[k]), []).append(k)
    trees: dict[tuple[int, int], RTree] = {}
    for q in range(len(points)):
        if resident[q] and not among:
            continue
        own, size, found = len(points[q]), int(points[q].sum()), []
        for d in (own // 2, own, own * 2):
            if d in homes:
                dim = min(d, own)
                if (d, dim) not in trees:
                    flat = np.stack([points[k].reshape(-1, dim).sum(0) for k in homes[d]])
                    trees[d, dim] = RTree(flat, flat.sum(1))
                found.append(np.array(homes[d])[trees[d, dim].search(points[q].reshape(-1, dim).sum(0), size, percent)])
        near = np.concatenate(found) if found else np.zeros(0, np.int64)
        near = near[near < q] if resident[q] else near
        if len(near):
            yield q, near


def leaf_links(ids: np.ndarray, sets: list[np.ndarray], resident: np.ndarray, among: bool, percent: int) -> list[tuple[int, int]]:
    """Links that join what the leaf joins: residents with visitors, and, if ``among``, with each other."""
    root = np.arange(len(ids))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for q, found in leaf_candidates([group_counts(s) for s in sets], resident, among, percent):
        for other in found:
            a, b = find(q), find(int(other))
            if a != b:
                common = len(np.intersect1d(sets[q], sets[other], assume_unique=True))
                if (100 + percent) * common >= percent * (len(sets[q]) + len(sets[other])):
                    root[max(a, b)] = min(a, b)
    return [(int(ids[x]), int(ids[r])) for x in range(len(ids)) if (r := find(x)) != x]


_PLACE = ["leaf", "block", "chunk", "sid", "resident"]
_PLACE_SCHEMA = "leaf long, block int, chunk int, sid long, resident boolean"
_PLACE_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_()]


def _by_leaf(rows: DataFrame, payload: str, work, names: list[str], types: list, schema: str) -> DataFrame:
    """work(key, ids, payloads, resident) for each (leaf, block, chunk), residents first; it gives rows of ``schema``.

    A group holds BLOCK residents and BLOCK visitors on average, and groups are
    streamed one after the other.
    """
    rows = rows.select(*_PLACE, payload).repartition("leaf", "block", "chunk").sortWithinPartitions("leaf", "block", "chunk", F.col("resident").desc(), "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, payloads, resident, out = None, [], [], [], []
        table = lambda: pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate(types)], names)
        for batch in batches:
            leaf, block, chunk, sid, own = (batch.column(k).to_pylist() for k in range(5))
            lists = batch.column(5)
            offs, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            for k in range(batch.num_rows):
                if (now := (leaf[k], block[k], chunk[k])) != key:
                    if len(ids) > 1:
                        out += work(key, np.array(ids), payloads, np.array(resident))
                    key, ids, payloads, resident = now, [], [], []
                if not (ids and ids[-1] == sid[k]):
                    ids.append(sid[k]), payloads.append(values[offs[k] : offs[k + 1]].copy()), resident.append(own[k])
            if out:
                yield table()
                out = []
        if len(ids) > 1:
            out += work(key, np.array(ids), payloads, np.array(resident))
        if out:
            yield table()

    return rows.mapInArrow(run, schema)


def _of_classes(rows: DataFrame, wanted: DataFrame, size: int, work, schema: str) -> DataFrame:
    """work(sids, sets) as arrays of ``schema``, for the wanted classes (sid, rep), from the texts of their representatives.

    Texts are shuffled only if a bitmap of the wanted ids may hold theirs.
    """
    near = Bitmap(wanted, "rep", "text-bitmap").near(rows, F.col("id"))
    texts = near.join(wanted, F.col("id").eqNullSafe(F.col("rep"))).select("text", "sid")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                of = part.column(1).to_numpy()
                sets = shingle_sets(part.column(0), size)
                at = [k for k, s in enumerate(sets) if identity(s)[0] == of[k]]  # an id may be repeated with another text
                yield pa.RecordBatch.from_arrays(work(of[at], [sets[k] for k in at]), names)

    return texts.mapInArrow(run, schema)


def _as_lists(sids: np.ndarray, sets: list[np.ndarray]) -> list[pa.Array]:
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    offs = np.r_[0, np.cumsum([len(s) for s in sets])].astype(np.int32)
    return [pa.array(sids), pa.ListArray.from_arrays(pa.array(offs), pa.array(flat.view(np.int64)))]


def _shared(cells: DataFrame, order: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of the early shingles (key, sid): those of keys of 2 to HOT classes, with ``held``; those of more; and the latter keys.

    A common key is never one task's: cells are counted with partial sums, and joined
    with the few common keys by broadcast.
    """
    cells = materialize(cells, "early-shingles")
    if order == 0:  # of all classes: the many shingles of one class alone go first
        several = cells.groupBy("key").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("low < high").select("key")
        several = materialize(several, "shared-keys")
        cells = materialize(Bitmap(several, "key", "shared-keys-bitmap").near(cells, F.col("key")).distinct(), "shared-cells")
    held = materialize(cells.groupBy("key").agg(F.count(F.lit(1)).alias("held")).where("held > 1"), "held-keys")
    common = held.where(F.col("held") > HOT)
    few = broadcast_if_small(common)
    rare = cells.join(few.select("key"), "key", "left_anti").join(held, "key")
    return rare, cells.join(few, "key"), common


def _fresh(hot: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The common keys that are to come last: those whose classes have, on average, fewer common early shingles than others."""
    hot = hot.select("key", "sid")
    mine = hot.groupBy("sid").agg(F.count(F.lit(1)).alias("common")).join(classes.select("sid", "n"), "sid")
    early_ones = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    share = hot.join(mine.select("sid", (F.col("common") / early_ones).alias("share")), "sid")
    return materialize(share.groupBy("key").agg(F.avg("share").alias("share")).where("share < 0.5").select("key"), "fresh-keys")


def _round(residents: DataFrame, visitors: DataFrame, owners: DataFrame, arrays, among: bool, percent: int) -> DataFrame:
    """Links (leaf, block, u, v) found between residents and visitors of each (leaf, block); both are (leaf, block, sid).

    Visitors of a block are dealt out to chunks, each with the residents of the block.
    ``arrays`` gives a table (sid, shingles) that has all of the classes (sid).
    """
    chunks = visitors.groupBy("leaf", "block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("chunks"))
    here = residents.join(chunks, ["leaf", "block"], "left").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    there = visitors.join(chunks, ["leaf", "block"]).withColumn("chunk", F.pmod(F.xxhash64("sid"), F.col("chunks")).cast("int"))
    placed = here.select("leaf", "block", "chunk", "sid", F.lit(True).alias("resident")).unionByName(there.select("leaf", "block", "chunk", "sid", F.lit(False).alias("resident")))

    def candidates(key, ids, points, resident) -> list[tuple]:
        hit = np.zeros(len(ids), bool)
        for q, found in leaf_candidates(points, resident, among and key[2] == 0, percent):
            hit[q] = True
            hit[found] = True
        return [(*key, int(ids[k]), bool(resident[k])) for k in np.flatnonzero(hit)]

    near = _by_leaf(placed.join(owners.select("sid", "point"), "sid"), "point", candidates, _PLACE, _PLACE_TYPES, _PLACE_SCHEMA)
    near = materialize(near, "candidates")
    own = arrays(near.select("sid"))

    def links(key, ids, sets, resident) -> list[tuple]:
        return [(*key[:2], u, v) for u, v in leaf_links(ids, [s.view(np.uint64) for s in sets], resident, among and key[2] == 0, percent)]

    return materialize(_by_leaf(near.join(own, "sid"), "shingles", links, ["leaf", "block", "u", "v"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()], "leaf long, block int, u long, v long"), "links")


def _summed_counts(blocks: DataFrame) -> np.ndarray:
    """The counts of all groups from the tasks' blocks (group, counts); each block is summed up as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        give = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["group", "counts"])
        for batch in batches:
            for group, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(zlib.decompress(counts), np.int32)
                if group != now:
                    if now is not None:
                        yield give()
                    now, total = group, own.astype(np.int64)
                else:
                    total += own
        if now is not None:
            yield give()

    out = np.zeros(GROUPS, np.int64)
    for r in blocks.repartition("group").sortWithinPartitions("group").mapInArrow(run, "group int, counts binary").collect():  # GROUPS numbers
        own = np.frombuffer(r["counts"], np.int64)
        out[r["group"] : r["group"] + len(own)] = own
    return out


def _hot_bits(common: DataFrame) -> np.ndarray:
    """The filter over the common keys as words of 64 bits; its size is fixed."""
    place = F.col("key").bitwiseAND(F.lit((1 << HOT_BITS) - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    out = np.zeros(1 << HOT_BITS - 6, np.int64)
    found = common.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()  # 2 ** (HOT_BITS - 6) rows at most
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint64)


def _labelled(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, hashed: bool) -> DataFrame:
    """id, hash (of the text; null unless ``hashed``), n, component (a number of its own, null without shingles), component_id: one row per row of ``docs``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    text_hash = F.xxhash64("text") if hashed else F.lit(None).cast("long")
    kind = rows.schema["id"].dataType
    spark = docs.sparkSession

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, empty = np.zeros(GROUPS, np.int32), None
        names = [f.name for f in fields]
        for batch in batches:
            for part in steps(batch):
                sets = shingle_sets(part.column(2), size)
                sums = [identity(s) for s in sets]
                n = len(sets)
                empty = part.column(0).slice(0, 0)
                counts += np.bincount((np.concatenate(sets) >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([x[0] for x in sums], pa.int64()), pa.array([x[1] for x in sums], pa.int64()), pa.array([group_counts(s) for s in sets], pa.list_(pa.int32())), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if empty is not None:
            at = list(range(0, GROUPS, GROUP_BLOCK))
            none = pa.nulls(len(at), pa.int64())
            own = [zlib.compress(counts[k : k + GROUP_BLOCK].tobytes(), 1) for k in at]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), empty.type), none, none, none, none, pa.nulls(len(at), pa.list_(pa.int32())), pa.array(at, pa.int32()), pa.array(own, pa.binary())], names)

    fields = [T.StructField("id", kind), *(T.StructField(x, T.LongType()) for x in ("hash", "n", "s1", "s2")), T.StructField("point", T.ArrayType(T.IntegerType())), T.StructField("group", T.IntegerType()), T.StructField("counts", T.BinaryType())]
    described = materialize(rows.select("id", text_hash.alias("hash"), "text").mapInArrow(describe, T.StructType(fields)), "shingle-sets")
    known = described.where("group is null").select("id", "hash", "n", "s1", "s2", "point")
    # one class has one point and one representative; copies are folded together
    classes = known.where("n > 0").groupBy(F.col("s1").alias("sid"), "s2").agg(F.min("id").alias("rep"), F.max("n").alias("n"), F.max("point").alias("point"))
    classes = materialize(classes, "classes")

    weights = _summed_counts(described.where("group is not null").select("group", "counts"))
    ranks = np.empty(len(weights), np.uint32)
    ranks[np.argsort(weights, kind="stable")] = np.arange(len(weights), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(ranks)
    sent = [shared]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        for batch in batches:
            for part in steps(batch):
                key, sid = [], []
                for s in shingle_sets(part.column(0), size):
                    if len(s) and (own := identity(s)[0]) not in seen:
                        if len(seen) > 1_000_000:  # copies that are met again are dropped below
                            seen.clear()
                        seen.add(own)
                        key.append(early(s, order, None, percent).view(np.int64))
                        sid.append(np.full(len(key[-1]), own, np.int64))
                if key:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(key)), pa.array(np.concatenate(sid))], ["key", "sid"])

    parts, hot_words = [], np.zeros(1 << HOT_BITS - 6, np.uint64)
    early_ones = rows.select("text").mapInArrow(keys, "key long, sid long")
    for order in range(ORDERS):
        rare, hot, common = _shared(early_ones, order)
        parts.append(rare)
        fresh = _fresh(hot.where(F.col("key") < _LAST), classes, percent) if order < ORDERS - 1 and common.where(F.col("key") < _LAST).take(1) else None
        if fresh is None or not fresh.take(1):
            parts.append(hot)
            break
        few = broadcast_if_small(fresh)
        parts.append(hot.join(few, "key", "left_anti"))
        wanted = classes.select("sid", "rep").join(hot.join(few, "key", "left_semi").select("sid").distinct(), "sid", "left_semi")
        wanted = materialize(wanted, "common-representatives")
        hot_words |= _hot_bits(fresh)
        late = spark.sparkContext.broadcast(hot_words.copy())
        sent.append(late)

        def keys_again(sids: np.ndarray, sets: list[np.ndarray], late=late) -> list[pa.Array]:
            key = [early(s, shared.value, late.value, percent).view(np.int64) for s in sets]
            return [pa.array(np.concatenate([np.zeros(0, np.int64), *key])), pa.array(np.repeat(sids, [len(k) for k in key]))]

        early_ones = _of_classes(rows, wanted, size, keys_again, "key long, sid long")
    cells = parts[0]
    for part in parts[1:]:
        cells = cells.unionByName(part)
    cells = materialize(cells.groupBy("key", "sid").agg(F.max("held").alias("held")) if len(parts) > 1 else cells, "all-cells")
    for b in sent:  # the early shingles are written
        b.destroy()

    # a class lives with the most others: copies of one text have few leaves between them
    owners = materialize(cells.groupBy("sid").agg(F.max(F.struct("held", "key")).alias("o")).select("sid", F.col("o.key").alias("owner"), F.col("o.held").alias("size")), "owners")
    owners = materialize(classes.drop("s2").join(owners, "sid"), "leaf-classes")
    large = materialize(owners.groupBy(F.col("owner").alias("leaf")).agg(F.count(F.lit(1)).alias("residents")).where(F.col("residents") > BLOCK), "large-leaves")
    large = broadcast_if_small(large)

    # the fewer come to the more: of two classes that share a shingle the one of the less common leaf visits the other's
    cells = materialize(cells.join(owners.select("sid", "owner", "size", "n"), "sid"), "cells")
    homes = cells.groupBy("key", "held", F.col("owner").alias("leaf"), F.col("size").alias("leaf_size")).agg(F.min("n").alias("least"), F.max("n").alias("most"))
    several = cells.groupBy("key").agg(F.min("owner").alias("one"), F.max("owner").alias("other")).where("one < other").select("key")
    homes = materialize(homes.join(several, "key", "left_semi"), "homes")
    larger = (F.col("leaf_size") > F.col("size")) | ((F.col("leaf_size") == F.col("size")) & (F.col("leaf") < F.col("owner")))
    alike = (F.col("n") * percent <= F.col("most") * 100) & (F.col("least") * percent <= F.col("n") * 100)
    meet = lambda own, other: own.drop("held").join(other.drop("held"), "key").where(larger & alike).select("leaf", "sid")
    visits = meet(cells.where(F.col("held") <= HOT), homes.where(F.col("held") <= HOT))
    visits = visits.unionByName(meet(cells.where(F.col("held") > HOT), broadcast_if_small(homes.where(F.col("held") > HOT)))).distinct()

    # round 1: each resident in its own block, each visitor in one block of the leaf
    blocks = F.coalesce(F.ceil(F.col("residents") / BLOCK), F.lit(1)).cast("int")
    deal = lambda name: F.pmod(F.xxhash64(F.lit(name), "sid"), F.col("blocks")).cast("int")
    dealt = lambda d, name: d.join(large, "leaf", "left").select("leaf", "sid", blocks.alias("blocks")).withColumn("block", deal(name))
    residents = dealt(owners.select(F.col("owner").alias("leaf"), "sid"), "r")
    visitors = materialize(dealt(visits, "v"), "visitors")
    many = residents.where("blocks > 1")
    later = many.select("sid").unionByName(visitors.where("blocks > 1").select("sid"))  # they come again, and are read once

    def shingles(found: DataFrame) -> DataFrame:
        wanted = found.unionByName(later).distinct().join(owners.select("sid", "rep"), "sid")
        return materialize(_of_classes(rows, materialize(wanted, "candidate-classes"), size, _as_lists, "sid long, shingles array<long>"), "shingle-arrays")

    kept: list[DataFrame] = []
    arrays = lambda found: kept[0] if kept else kept.append(shingles(found)) or kept[0]
    links = _round(residents.select("leaf", "block", "sid"), visitors.select("leaf", "block", "sid"), owners, arrays, True, percent)
    if not many.take(1):
        joined = components(links)
    else:
        # round 2: what is left of each block after round 1, one of each group, visits the blocks before
        many, guests = materialize(many, "residents"), visitors.where("blocks > 1")
        places = broadcast_if_small(materialize(many.select("leaf", F.col("block").alias("other")).distinct(), "places"))  # one row a block
        tied = links.select("leaf", "block", F.col("u").alias("sid")).distinct()
        come = many.join(tied, ["leaf", "block", "sid"], "left_anti").join(places, "leaf").where("other < block")
        links = links.unionByName(_round(many.select("leaf", "block", "sid"), come.select("leaf", F.col("other").alias("block"), "sid"), owners, arrays, False, percent))
        joined = components(links)

        # round 3: whoever may still join two components visits the blocks it hasn't been in
        label = lambda d: d.join(joined.select(F.col("node").alias("sid"), "component"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
        here = label(many)
        held = here.groupBy("leaf", F.col("block").alias("other")).agg(F.min("component").alias("low"), F.max("component").alias("high"))
        held = broadcast_if_small(materialize(held, "block-components"))
        come = here.select("leaf", "block", "sid", "component", F.lit(True).alias("lives")).unionByName(label(guests).select("leaf", "block", "sid", "component", F.lit(False).alias("lives")))
        apart = (F.col("low") != F.col("component")) | (F.col("high") != F.col("component"))
        new = (F.col("other") < F.col("block")) | (~F.col("lives") & (F.col("other") != F.col("block")))
        more = materialize(come.join(held, "leaf").where(apart & new).select("leaf", F.col("other").alias("block"), "sid").distinct(), "more-visits")
        if more.take(1):
            found = _round(many.select("leaf", "block", "sid"), more, owners, arrays, False, percent)
            stars = joined.select(F.col("node").alias("u"), F.col("component").alias("v"))
            joined = components(stars.unionByName(found.select("u", "v")))

    by_class = classes.select(F.col("sid").alias("s1"), "s2", "rep").join(joined.select(F.col("node").alias("s1"), "component"), "s1", "left").withColumn("component", F.coalesce("component", "s1"))
    least = by_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_class = materialize(by_class.join(least, "component").select("s1", "s2", "component", "component_id"), "class-components")
    return known.drop("point").join(by_class, ["s1", "s2"], "left").select(
        "id", "hash", "n", F.when(F.col("n") > 0, F.col("component")).alias("component"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id")
    )

def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: id_col, n_shingles, component_id.

    Texts are lower-cased in A-Z and split at white space (space, 0x09-0x0D). Two
    texts link when 100 * common >= percent * united of their distinct shingles of
    ``size`` words; a text of fewer words is one shingle. A null text or one
    without words has no shingle and links with nothing, and its component is its
    own id. ``component_id`` is the smallest id (nulls left out) that links reach.
    Rows with equal texts are always together, also when they repeat an id; ids may
    be null. An empty table gives no rows.
    """
    return _labelled(docs, id_col, text_col, size, percent, False).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component of jaccard_components: the first by (id, hash of the text), null ids last.

    Rows are told apart by id and text, as ids may be null or repeated. Of rows that
    repeat both, the one whose columns in order are least stays, so columns must be
    orderable. Rows without shingles all stay.
    """
    labelled = materialize(_labelled(docs, id_col, text_col, size, percent, True).where("n > 0").select("id", "hash", "component"), "labelled")
    place = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    rows = labelled.groupBy("id", "hash", "component").agg(F.count(F.lit(1)).alias("rows"))
    first = labelled.groupBy("component").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("all")).where("all > 1")
    marked = rows.join(first, "component").select(F.col("id").alias("_nj_id"), F.col("hash").alias("_nj_hash"), (place == F.col("first")).alias("_nj_first"), "rows")
    marked = materialize(marked.where("not _nj_first or rows > 1").drop("rows"), "marked-documents")
    same = F.col(id_col).eqNullSafe(F.col("_nj_id")) & (F.xxhash64(text_col) == F.col("_nj_hash"))
    left = docs.join(marked, same, "left_anti")
    repeated = marked.where("_nj_first")
    if not repeated.take(1):
        return left
    copies = docs.join(repeated, same, "left_semi")
    least = copies.groupBy(F.col(id_col).alias("_nj_id"), F.xxhash64(text_col).alias("_nj_hash")).agg(F.min(F.struct(*docs.columns)).alias("_nj_row"))
    return left.unionByName(least.select("_nj_row.*"))
