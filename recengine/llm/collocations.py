"""Phrase collocations from count streams in prefix and suffix order.

1. Tasks count the phrases of their texts in arrays and send partial counts. First
   single words and pairs; then triples, but only those whose two pairs may be
   frequent, as a bitmap of the frequent pairs (of fixed size) tells.
2. Phrases below the least count can be no part of a frequent one and go. What is
   left is one stream of counts of all lengths. In suffix order (last word first)
   every phrase directly follows its own endings: reading the stream once, the counts
   of the last word and of the last two words are those of the latest shorter rows,
   and a pair's largest extension to the left is the largest of the rows after it. The
   annotated stream is then sorted in prefix order and read again, for the counts of
   beginnings and the extensions to the right.
3. Streams are sorted by ranges of the whole phrase, so one very common word spreads
   over many tasks. A range that begins in the middle of a word's or pair's rows lacks
   its count; every task leaves one row about its two ends, and these rows, one a
   task, are folded on the driver and complete the first and last rows of each range.
4. Scores are exact integers: the products are decimals of 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recengine.llm._arrow import ASCII_LOWER, mix, steps, text_bytes, word_codes, word_hashes, words
from recengine.llm._scratch import materialize

#: Bits of the filter over frequent pairs that tasks receive (a fixed 4 MB); beyond, more triples are counted, not less.
FILTER_BITS = 25
#: Most words and phrases that a task counts before it sends them on, and phrases that wait to be counted.
WORDS, PHRASES, WAITING = 120_000, 400_000, 300_000

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[*b".,;:!?", 0x0A, 0x0B, 0x0C, 0x0D]] = True
_APART = _BREAK.copy()
_APART[[0x20, 0x09]] = True
_BITS, _MASK = 21, (1 << 21) - 1
_FACTORS = mix(np.arange(501, 504, dtype=np.uint64)) | np.uint64(1)


class _Words:
    """Words and pieces of a step: per word its language, its place in ``distinct`` and whether the next word follows in its piece."""

    def __init__(self, part: pa.RecordBatch):
        data, offs = text_bytes(part.column(1))
        data = ASCII_LOWER[data]
        start, end, doc = words(data, offs, _APART)
        langs = part.column(0).dictionary_encode()
        self.langs = langs.dictionary.to_pylist()
        self.lang = langs.indices.to_numpy()[doc].astype(np.int64)
        self.code, self.distinct = word_codes(data, start, end)
        breaks = np.cumsum(_BREAK[data], dtype=np.int64)[start]
        self.follows = (breaks[1:] == breaks[:-1]) & (doc[1:] == doc[:-1]) if len(start) else np.zeros(0, bool)
        self.first_byte, self.last_byte, self.data = start, end, data


class _Counts:
    """Counts of phrases of up to three words, by numbers of (language, word)."""

    def __init__(self, size: int):
        self.size = size
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, dict[bytes, int]] = {}  # by language, in order of their numbers
        self.words: list[bytes] = []
        self.langs: list[str] = []
        self.key, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.waits = 0
        self.single = np.zeros(0, np.int64)

    def number(self, w: _Words, at: np.ndarray) -> np.ndarray:
        """Numbers of the words at these places (all others get 0)."""
        size = max(1, len(w.distinct))
        distinct, back = np.unique(w.lang[at] * size + w.code[at], return_inverse=True)
        own = np.empty(len(distinct), np.int64)
        for k, (lang, code) in enumerate(zip((distinct // size).tolist(), (distinct % size).tolist(), strict=True)):
            known, word = self.numbers.setdefault(w.langs[lang], {}), w.distinct[code]
            own[k] = known.setdefault(word, len(self.words))
            if own[k] == len(self.words):
                self.words.append(word)
                self.langs.append(w.langs[lang])
        out = np.zeros(len(w.code), np.int64)
        out[at] = own[back]
        return out

    def add_single(self, number: np.ndarray) -> None:
        new = np.bincount(number, minlength=len(self.words))
        new[: len(self.single)] += self.single
        self.single = new

    def add(self, key: np.ndarray) -> None:
        self.waiting.append(key)
        self.waits += len(key)
        if self.waits > WAITING:
            self.fold()

    def fold(self) -> None:
        new, n = np.unique(np.concatenate([np.zeros(0, np.int64), *self.waiting]), return_counts=True)
        self.waiting, self.waits = [], 0
        key = np.concatenate([self.key, new])
        order = np.argsort(key, kind="stable")
        key, n = key[order], np.concatenate([self.n, n])[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.key, self.n = key[first], np.add.reduceat(n, first) if len(first) else n

    @property
    def full(self) -> bool:
        return len(self.words) > WORDS or len(self.key) > PHRASES

    def rows(self) -> Iterator[pa.RecordBatch]:
        """lang, w1, w2, w3, n of everything so far; then it is forgotten."""
        self.fold()
        langs, texts = pa.array(self.langs, pa.string()), pa.array(self.words, pa.binary()).cast(pa.string())
        at = np.flatnonzero(self.single)
        for own, n, size in ((at, self.single[at], 1), (self.key, self.n, self.size)):
            for a in range(0, len(own), 20_000):
                part = own[a : a + 20_000]
                place = [pa.array((part >> (_BITS * (size - 1 - k))) & _MASK) for k in range(size)]
                columns = [texts.take(p) for p in place] + [pa.nulls(len(part), pa.string())] * (3 - size)
                yield pa.RecordBatch.from_arrays([langs.take(place[0]), *columns, pa.array(n[a : a + 20_000])], _NAMES)
        self.clear()
        pa.default_memory_pool().release_unused()


_NAMES, _SCHEMA = ["lang", "w1", "w2", "w3", "n"], "lang string, w1 string, w2 string, w3 string, n long"


def _counted(texts: DataFrame, take, size: int) -> DataFrame:
    """Partial counts: take(words, counts) of each step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = _Counts(size)
        for batch in batches:
            for part in steps(batch):
                take(_Words(part), counts)
                if counts.full:
                    yield from counts.rows()
        yield from counts.rows()

    return texts.mapInArrow(run, _SCHEMA)


def _words_and_pairs(w: _Words, counts: _Counts) -> None:
    number = counts.number(w, np.arange(len(w.code)))
    counts.add_single(number)
    at = np.flatnonzero(w.follows)
    counts.add(number[at] << _BITS | number[at + 1])


def _pair_hash(lang: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return mix(lang * _FACTORS[0] + one * _FACTORS[1] + two * _FACTORS[2]) >> np.uint64(64 - FILTER_BITS)


def _hashes(texts: list[bytes]) -> np.ndarray:
    """Hashes of texts, by their bytes alone."""
    offs = np.r_[0, np.cumsum([len(t) for t in texts])].astype(np.int64)
    out = np.zeros(len(texts), np.uint64)
    there = np.flatnonzero(np.diff(offs))
    out[there] = word_hashes(np.frombuffer(b"".join(texts), np.uint8), offs[:-1][there], offs[1:][there])
    return out


def _filter_of(pairs: DataFrame) -> bytes:
    """The bitmap of frequent pairs (lang, w1, w2); its size is fixed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS - 3, np.uint8)
        for batch in batches:
            place = _pair_hash(*(_hashes([x.encode() for x in batch.column(k).to_pylist()]) for k in range(3)))
            np.bitwise_or.at(bits, (place >> np.uint64(3)).astype(np.int64), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        long = bits.view(np.int64)
        at = np.flatnonzero(long)
        for a in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 50_000]), pa.array(long[at[a : a + 50_000]])], ["word", "bits"])

    found = pairs.select("lang", "w1", "w2").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def _triples(bits) -> object:
    """A taker of the triples whose two pairs the bitmap may hold."""

    def take(w: _Words, counts: _Counts) -> None:
        wanted = np.frombuffer(bits.value, np.uint8)
        lang, hashes = _hashes([x.encode() for x in w.langs])[w.lang], _hashes(w.distinct)[w.code]
        at = np.flatnonzero(w.follows)
        place = _pair_hash(lang[at], hashes[at], hashes[at + 1])
        ok = np.zeros(len(w.code) + 1, bool)
        ok[at] = wanted[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
        at = np.flatnonzero(ok[:-1] & ok[1:])
        used = np.zeros(len(w.code) + 2, bool)
        used[at] = used[at + 1] = used[at + 2] = True
        number = counts.number(w, np.flatnonzero(used))
        counts.add(number[at] << 2 * _BITS | number[at + 1] << _BITS | number[at + 2])

    return take


def phrase_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, w1, w2, w3, n) of all phrases of one to three words with n >= least, and (lang, words): how many words there are."""
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    total = lambda rows: rows.groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))
    all_of = materialize(total(_counted(texts, _words_and_pairs, 2)).where((F.col("n") >= least) | F.col("w2").isNull()), "phrases")
    frequent = all_of.where(F.col("n") >= least)
    bits = docs.sparkSession.sparkContext.broadcast(_filter_of(frequent.where("w2 is not null")))
    triples = materialize(total(_counted(texts, _triples(bits), 3)).where(F.col("n") >= least), "triples")
    bits.destroy()
    return frequent.unionByName(triples), all_of.where("w2 is null").groupBy("lang").agg(F.sum("n").alias("words"))


def lockstep(rows: DataFrame, order: list[str], names: list[str]) -> DataFrame:
    """``rows`` with three more columns, ``names``: counts of the first word and of the first two words of each phrase, and the largest count of the longer phrases that begin with it (of pairs; else 0).

    ``order``: the columns of the first, second and third word; rows have all
    beginnings of their phrases, too, each once. "First" is in this order, which may be from the end.
    """
    one, two, three = order
    rest = [c for c in rows.columns if c not in ("lang", *order, "n")]
    sorted_rows = rows.select("lang", *order, "n", *rest).repartitionByRange("lang", *order).sortWithinPartitions("lang", *order)
    extra = ["first", "second", "longest", "range", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        here = TaskContext.get().partitionId()
        first = second = pending = None
        longest = head = 0
        seen = None

        def give(batch: pa.RecordBatch, first, second, longest, kind) -> pa.RecordBatch:
            size = batch.num_rows
            own = [pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(longest, pa.int64()), pa.array(np.full(size, here, np.int32)), pa.array(kind, pa.int32())]
            return pa.RecordBatch.from_arrays([*batch.columns, *own], [*batch.schema.names, *extra])

        for batch in batches:
            if not batch.num_rows:
                continue
            seen = batch
            n = batch.column(4).to_numpy().astype(np.int64)
            pair = ~np.asarray(batch.column(2).is_null()) & np.asarray(batch.column(3).is_null())
            single, triple = np.asarray(batch.column(2).is_null()), ~np.asarray(batch.column(3).is_null())
            places = np.arange(len(n))
            last_single = np.maximum.accumulate(np.where(single, places, -1))
            last_pair = np.maximum.accumulate(np.where(pair, places, -1))
            above = np.zeros(len(n), np.int64)  # the largest triple after each pair
            np.maximum.at(above, last_pair[triple & (last_pair >= 0)], n[triple & (last_pair >= 0)])
            early = n[triple & (last_pair < 0)]
            if len(early):
                if pending is not None:
                    longest = max(longest, int(early.max()))
                else:
                    head = max(head, int(early.max()))
            at_first, at_second = n[np.maximum(last_single, 0)], n[np.maximum(last_pair, 0)]
            no_first, no_second = last_single < 0, last_pair < 0
            firsts = pa.array(np.where(no_first, first or 0, at_first), mask=no_first & (first is None))
            seconds = pa.array(np.where(no_second, second or 0, at_second), mask=no_second & (second is None))
            held = int(last_pair[-1])  # the last pair waits for the end of its triples
            go = np.flatnonzero(places != held)
            if held >= 0 and pending is not None:
                yield give(pending[0], pending[1], pending[2], [longest], [1])
            yield give(batch.take(pa.array(go)), firsts.take(pa.array(go)), seconds.take(pa.array(go)), above[go], np.ones(len(go), np.int32))
            if held >= 0:
                pending = batch.slice(held, 1), firsts.slice(held, 1), seconds.slice(held, 1)
                longest = int(above[held])
            if last_single[-1] >= 0:
                first = int(n[last_single[-1]])
            if held >= 0:
                second = int(n[held])
        if pending is not None:
            yield give(pending[0], pending[1], pending[2], [longest], [2])  # its triples may go on in the next range
        if seen is not None:  # about this range: the last single's and pair's counts, the largest triple before any pair
            none = pa.RecordBatch.from_arrays([pa.nulls(1, c.type) for c in seen.columns], seen.schema.names)
            yield give(none, [first], [second], [head], [0])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_rows.schema.fields)
    read = materialize(sorted_rows.mapInArrow(run, f"{kinds}, first long, second long, longest long, range int, kind int"), "stream")
    ends = read.where("kind = 0").select("range", "first", "second", "longest").toArrow().sort_by("range").to_pylist()  # one row a task
    first = second = None
    after = 0
    fixes = []
    for e in ends:
        fixes.append([e["range"], first, second, 0])
        first, second = e["first"] if e["first"] is not None else first, e["second"] if e["second"] is not None else second
    for fix, e in zip(reversed(fixes), reversed(ends), strict=True):
        fix[3] = after
        after = e["longest"] if e["second"] is not None else max(e["longest"], after)
    fix = rows.sparkSession.createDataFrame(fixes, "range int, f1 long, f2 long, after long")
    out = read.where("kind > 0").join(F.broadcast(fix), "range")  # one row a task
    longest = F.when(F.col("kind") == 2, F.greatest("longest", "after")).otherwise(F.col("longest"))
    return out.select("lang", *order, "n", *rest, F.coalesce("first", "f1").alias(names[0]), F.coalesce("second", "f2").alias(names[1]), longest.alias(names[2]))


def collocations(docs: DataFrame, least: int = 10, share: int = 50, top: int = 2000, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The first ``top`` phrases of two and three words of each language: lang, rank, phrase, a, l, r, n, score, cut.

    Texts are lower-cased in A-Z, split at ``.,;:!?`` and line ends (0x0A-0x0D) into
    pieces and those at spaces and tabs into words; phrases lie within a piece. n are
    all words of the language, a the occurrences of the phrase, l and r those of its
    two parts at the cut with the lowest score, score = floor(10 ** 6 a a / (l r));
    ties go to the earlier cut. Phrases occur ``least`` times or more. A pair goes if
    a triple that is one with it has ``share`` percent of its occurrences or more. Order:
    score and a descending, phrase ascending by its bytes.

    A null language is ``und``; null and empty texts have no words; repeated rows count
    each. Only the two columns are read. An empty table gives no rows.
    """
    counts, words_of = phrase_counts(docs, least, text_col, lang_col)
    ends = lambda d: d.select("lang", F.coalesce("w3", "w2", "w1").alias("e1"), F.when(F.col("w3").isNotNull(), F.col("w2")).otherwise(F.when(F.col("w2").isNotNull(), F.col("w1"))).alias("e2"), F.when(F.col("w3").isNotNull(), F.col("w1")).alias("e3"), "n")
    back = lockstep(ends(counts), ["e1", "e2", "e3"], ["last", "last_two", "longest_left"])
    back = back.select("lang", F.coalesce("e3", "e2", "e1").alias("w1"), F.when(F.col("e3").isNotNull(), F.col("e2")).otherwise(F.when(F.col("e2").isNotNull(), F.col("e1"))).alias("w2"), F.when(F.col("e3").isNotNull(), F.col("e1")).alias("w3"), "n", "last", "last_two", "longest_left")
    both = lockstep(back, ["w1", "w2", "w3"], ["begin", "begin_two", "longest_right"]).where("w2 is not null")
    whole = lambda c: F.col(c).cast("decimal(19,0)")

    def score(left: str, right: str) -> Column:
        return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * whole("n") * whole("n"), (whole(left) * whole(right)).cast("decimal(38,0)"))

    three = F.col("w3").isNotNull()
    one, two = F.when(three, score("begin", "last_two")).otherwise(score("begin", "last")), F.when(three, score("begin_two", "last"))
    both = both.withColumn("one", one).withColumn("two", two).withColumn("second", F.coalesce(F.col("two") < F.col("one"), F.lit(False)))
    kept = both.where(three | (100 * F.greatest("longest_left", "longest_right") < share * F.col("n")))
    left, right = F.when(F.col("second"), F.col("begin_two")).otherwise(F.col("begin")), F.when(F.col("second") | ~three, F.col("last")).otherwise(F.col("last_two"))
    rows = kept.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), F.col("n").alias("a"), left.alias("l"), right.alias("r"), F.when(F.col("second"), F.col("two")).otherwise(F.col("one")).cast("long").alias("score"), F.when(F.col("second"), 2).otherwise(1).alias("cut"))
    # places are counted per range of the order, so no task sees all phrases of a language
    best = [F.desc("score"), F.desc("a"), F.col("phrase")]
    ranges = materialize(rows.repartitionByRange("lang", *best).withColumn("range", F.spark_partition_id()), "ordered")
    sums = ranges.groupBy("lang", "range").agg(F.count(F.lit(1)).alias("own"))
    before = F.coalesce(F.sum("own").over(Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select("lang", "range", before.alias("before")).where(F.col("before") < top)
    place = F.col("before") + F.row_number().over(Window.partitionBy("lang", "range").orderBy(*best))
    rows = ranges.join(sums, ["lang", "range"]).withColumn("rank", place).where(F.col("rank") <= top)
    return rows.join(words_of, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score", "cut")
