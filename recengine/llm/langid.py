"""Language identification by prediction by partial matching.

Each language has a context tree of the byte contexts of 0 to ``ORDER`` bytes seen
in its training texts. A byte costs -log2 of its share in the longest known
context; where it is new there, the escape of that context (method C: distinct /
(seen + distinct)) is paid and the next shorter context is asked, down to 8 bits
for a byte never seen. Statistics are frozen after training and symbols aren't
excluded after an escape, so a byte's cost depends on the ``ORDER`` bytes before
it alone; the distinct windows of a step are looked up once in each language's
tables. A text goes to the language with the least total code length.

A language's tables hold what its own sample has, so a model grows with the number
of languages, by some MB for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm._arrow import steps, text_bytes
from recengine.llm._scratch import materialize

ORDER = 4
#: Bounds of the training sample for one language: whole texts, picked by a hash of the id.
SAMPLE_ROWS, SAMPLE_BYTES = 2000, 600_000
#: Longer texts aren't taken into the sample, unless a language has no other.
SAMPLE_TEXT_BYTES = SAMPLE_BYTES // 8
_CHUNK = 1 << 19
_FREE = np.uint64(2**64 - 1)


def padded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ORDER line ends before each text, which bytes are text, and where the texts (with line ends) begin."""
    data, offs = text_bytes(column)
    n = len(column)
    out = np.full(len(data) + ORDER * n, 10, np.uint8)
    real = np.ones(len(out), bool)
    begins = offs[:-1] + ORDER * np.arange(n)
    real[(begins[:, None] + np.arange(ORDER)).ravel()] = False
    out[real] = data
    return out, real, begins


def windows(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """For positions a to b the byte and the ORDER bytes before it as one number; a is at least ORDER or is padding."""
    code = np.zeros(b - a, np.uint64)
    for back in range(ORDER, -1, -1):
        part = data[max(0, a - back) : b - back]
        code <<= np.uint64(8)
        code[len(code) - len(part) :] |= part.astype(np.uint64)
    return code


def low(code: np.ndarray, n: int) -> np.ndarray:
    """The last n bytes of the windows."""
    return code & np.uint64((1 << 8 * n) - 1)


class Rows:
    """A hash table from windows to row numbers, probed for many windows at once."""

    def __init__(self, codes: np.ndarray):
        self.bits = max(4, int(len(codes) * 2).bit_length())
        self.keys = np.full(1 << self.bits, _FREE)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left, at = np.arange(len(codes)), self._home(codes)
        while len(left):
            at_left = at[left]
            free = self.keys[at_left] == _FREE
            slots, first = np.unique(at_left[free], return_index=True)
            won = left[free][first]
            self.keys[slots], self.rows[slots] = codes[won], won
            left = np.setdiff1d(left, won, assume_unique=True)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _home(self, codes: np.ndarray) -> np.ndarray:
        return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, codes: np.ndarray) -> np.ndarray:
        at = self._home(codes)
        keys = self.keys[at]
        out = np.where(keys == codes, self.rows[at], -1)
        open_ = np.flatnonzero((keys != codes) & (keys != _FREE))
        at = at[open_]
        while len(open_):
            at = (at + 1) & ((1 << self.bits) - 1)
            keys, wanted = self.keys[at], codes[open_]
            hit = keys == wanted
            out[open_[hit]] = self.rows[at[hit]]
            on = ~hit & (keys != _FREE)
            open_, at = open_[on], at[on]
        return out


@dataclass
class ContextTree:
    """The frozen statistics of one language: by order the known windows with their costs, and the known contexts with their escapes."""

    symbols: list[tuple[Rows, np.ndarray]]
    escapes: list[tuple[Rows, np.ndarray]]

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits of each window's last byte."""
        out = np.zeros(len(code), np.float32)
        left = np.arange(len(code))
        for k in range(ORDER, -1, -1):
            table, bits = self.symbols[k]
            row = table.find(low(code[left], k + 1))
            known = row >= 0
            out[left[known]] += bits[row[known]]
            left = left[~known]
            if not len(left):
                return out
            table, bits = self.escapes[k]
            row = table.find(low(code[left] >> np.uint64(8), k))
            out[left[row >= 0]] += bits[row[row >= 0]]
        out[left] += 8
        return out


@dataclass
class PpmModel:
    """One context tree for each language."""

    langs: list[str]
    trees: list[ContextTree]

    def costs(self, code: np.ndarray) -> np.ndarray:
        """Bits of each window's last byte in each language, one row per language."""
        return np.stack([tree.costs(code) for tree in self.trees])


def fit_tree(counts: list[tuple[np.ndarray, np.ndarray]]) -> ContextTree:
    """The tree of counted windows: counts[k] are the distinct (k + 1)-byte windows, ascending, and how often each was seen."""
    tree = ContextTree([], [])
    for codes, n in counts:
        contexts, of = np.unique(codes >> np.uint64(8), return_inverse=True)
        total, distinct = np.bincount(of, weights=n, minlength=len(contexts)), np.bincount(of, minlength=len(contexts))
        tree.symbols.append((Rows(codes), -np.log2(n / (total + distinct)[of]).astype(np.float32)))
        tree.escapes.append((Rows(contexts), -np.log2(distinct / (total + distinct)).astype(np.float32)))
    return tree


def pick_sample(labelled: DataFrame) -> DataFrame:
    """id, lang, size of the training texts among the rows (id, lang, size), a written table.

    One pass counts the texts of each language, and a hash of the id lets about twice
    SAMPLE_ROWS of them through, which are then ordered; no task sorts a language.
    """
    share = lambda c: F.shiftrightunsigned(F.xxhash64(c), 11) / F.lit(float(1 << 53))
    order = F.struct(F.xxhash64("id").alias("h"), "id", "size")
    fits = F.col("size") <= SAMPLE_TEXT_BYTES
    per_lang = labelled.groupBy("lang").agg(F.count_if(fits).alias("n"), F.min(F.when(fits, order)).alias("first"), F.min(F.struct("size", order.alias("row"))).alias("least"))
    per_lang = materialize(per_lang, "langid-languages")
    near = labelled.where(fits).join(per_lang.select("lang", "n"), "lang").where(share("id") * F.col("n") <= 2 * SAMPLE_ROWS).select("id", "lang", "size").distinct()
    one = F.coalesce("first", F.col("least")["row"])  # a language is never without a text
    near = near.unionByName(per_lang.select(one["id"].alias("id"), "lang", one["size"].alias("size"))).distinct()
    place = Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "size")
    near = near.withColumn("place", F.row_number().over(place)).withColumn("until", F.sum("size").over(place.rowsBetween(Window.unboundedPreceding, 0)))
    taken = (F.col("place") <= SAMPLE_ROWS) & ((F.col("until") <= SAMPLE_BYTES) | (F.col("place") == 1))
    return materialize(near.where(taken).select("id", "lang", "size"), "langid-sample")


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> PpmModel | None:
    """Learn from a bounded sample of the labelled rows; None where there are none.

    Per language, rows are taken in the order of a hash of the id, at most
    SAMPLE_ROWS, and of these whole texts up to SAMPLE_BYTES together; texts over
    SAMPLE_TEXT_BYTES are left out unless a language has no other. Of rows that repeat
    an id, a language and a size one text counts; null ids count like others. Windows
    are counted in Spark; the driver receives one row per distinct window and language.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null and lang is not null")
    picked = pick_sample(materialize(rows.select("id", "lang", F.octet_length("text").cast("long").alias("size")), "langid-sizes"))
    picked = F.broadcast(picked.select(F.col("id").alias("p_id"), F.col("lang").alias("p_lang"), F.col("size").alias("p_size")))  # SAMPLE_ROWS per language
    same = F.col("id").eqNullSafe(F.col("p_id")) & (F.col("lang") == F.col("p_lang")) & (F.octet_length("text") == F.col("p_size"))
    sample = rows.join(picked, same).groupBy("id", "lang", "p_size").agg(F.min("text").alias("text")).select("text", "lang")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                column, names = part.column(0), part.column(1)
                for name in names.unique().to_pylist():
                    own = column.filter(pa.compute.equal(names, name))
                    data, real, _ = padded(own)
                    for a in range(0, len(data), _CHUNK):
                        b = min(len(data), a + _CHUNK)
                        code = windows(data, a, b)[real[a:b]]
                        for k in range(ORDER + 1):
                            codes, n = np.unique(low(code, k + 1), return_counts=True)
                            m = len(codes)
                            yield pa.RecordBatch.from_arrays([pa.array([name] * m), pa.array(np.full(m, k, np.int32)), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "k", "code", "n"])

    counted = sample.mapInArrow(count, "lang string, k int, code long, n long").groupBy("lang", "k", "code").agg(F.sum("n").alias("n")).toArrow()
    if not counted.num_rows:
        return None
    lang, k = counted["lang"].combine_chunks(), counted["k"].to_numpy()
    code, n = counted["code"].to_numpy().astype(np.uint64), counted["n"].to_numpy()
    coded = lang.dictionary_encode()
    found = coded.dictionary.to_pylist()
    at = np.lexsort((code, k, coded.indices.to_numpy()))
    cuts = np.searchsorted(coded.indices.to_numpy()[at] * (ORDER + 1) + k[at], np.arange(len(found) * (ORDER + 1) + 1))
    trees = [fit_tree([(code[own], n[own]) for own in (at[cuts[i] : cuts[i + 1]] for i in range(j * (ORDER + 1), (j + 1) * (ORDER + 1)))]) for j in range(len(found))]
    langs = sorted(found)
    return PpmModel(langs, [trees[found.index(x)] for x in langs])


def predict(docs: DataFrame, model: PpmModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, lang_pred, score, bits_per_byte.

    ``score`` is the posterior of the language under equal priors. A null text,
    one without a letter, or any text where no language was learned, is ``und``
    with score 0. Ties go to the first language in alphabetical order. Rows with null
    or repeated ids keep a row each; an empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(F.col(text_col).rlike("\\p{L}"), F.lit(False)).alias("letters"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frozen = shared.value
        for batch in batches:
            for part in steps(batch):
                n = part.num_rows
                letters = part.column(2).to_numpy(zero_copy_only=False)
                names, score, rate = np.full(n, "und", object), np.zeros(n), np.zeros(n)
                if frozen is not None:
                    data, real, begins = padded(part.column(1))
                    total = np.zeros((n, len(frozen.langs)))
                    for a in range(0, len(data), _CHUNK):
                        b = min(len(data), a + _CHUNK)
                        place, distinct = pd.factorize(windows(data, a, b))
                        first = int(np.searchsorted(begins, a, side="right")) - 1
                        beyond = int(np.searchsorted(begins, b))
                        cuts = np.maximum(begins[first:beyond], a) - a
                        for i, tree in enumerate(frozen.trees):
                            bits = tree.costs(distinct)[place]
                            bits[~real[a:b]] = 0
                            total[first:beyond, i] += np.add.reduceat(bits, cuts, dtype=np.float64)
                    best = total.argmin(1)
                    least = total[np.arange(n), best]
                    posterior = 1 / np.exp2(np.maximum(least[:, None] - total, -1000)).sum(1)
                    names[letters] = np.array(frozen.langs, object)[best[letters]]
                    score[letters] = posterior[letters]
                    size = np.maximum(1, np.diff(np.r_[begins, len(data)]) - ORDER)
                    rate[letters] = (least / size)[letters]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rate)], ["id", "lang_pred", "score", "bits_per_byte"])

    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the row's id falls into the part that isn't learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == part, F.lit(False))
