"""Bitmaps of key hashes: which rows may have a key of a small table, before anything large is shuffled.

A bitmap never misses a key. Its size follows the number of keys, BITS_PER_KEY for
each, up to 2 ** MOST_WORDS_LOG2 words of 64 bits (4 MB of bits, broadcast as rows
of two longs). With so many keys that it fills up, more rows pass it, and in the
end all do: the exact join that always follows it is then an ordinary one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.llm._scratch import materialize

BITS_PER_KEY = 8
LEAST_WORDS_LOG2, MOST_WORDS_LOG2 = 10, 19


def _place(value: Column, words_log2: int) -> tuple[Column, Column]:
    """The word and the bit of a value."""
    h = F.xxhash64(value)
    return F.shiftrightunsigned(h, 64 - words_log2), F.shiftrightunsigned(h, 64 - words_log2 - 6).bitwiseAND(F.lit(63)).cast("int")


class Bitmap:
    """The keys of ``column`` in ``rows``, a written table."""

    def __init__(self, rows: DataFrame, column: str, name: str):
        wanted = max(1, rows.count() * BITS_PER_KEY // 64)  # counted from the footers of the files
        self.words_log2 = min(MOST_WORDS_LOG2, max(LEAST_WORDS_LOG2, (wanted - 1).bit_length()))
        word, bit = _place(F.col(column), self.words_log2)
        one = F.call_function("shiftleft", F.lit(1).cast("long"), bit)
        self.table = materialize(rows.groupBy(word.alias("_bm_word")).agg(F.bit_or(one).alias("_bm_bits")), name)

    def _there(self, value: Column) -> tuple[Column, Column]:
        word, bit = _place(value, self.words_log2)
        return word == F.col("_bm_word"), F.call_function("shiftrightunsigned", F.col("_bm_bits"), bit).bitwiseAND(F.lit(1)) == 1

    def mark(self, rows: DataFrame, value: Column, flag: str) -> DataFrame:
        """``rows`` with ``flag``: false only where the value is no key."""
        word, held = self._there(value)
        joined = rows.join(F.broadcast(self.table), word, "left")  # at most 2 ** MOST_WORDS_LOG2 rows
        return joined.withColumn(flag, F.coalesce(held, F.lit(False))).drop("_bm_word", "_bm_bits")

    def near(self, rows: DataFrame, value: Column) -> DataFrame:
        """The rows whose value may be a key."""
        word, held = self._there(value)
        return rows.join(F.broadcast(self.table), word & held).drop("_bm_word", "_bm_bits")


def broadcast_if_small(table: DataFrame, most_rows: int = 200_000) -> DataFrame:
    """A written table of few columns, with a broadcast hint if it has at most ``most_rows`` rows; else as it is."""
    return F.broadcast(table) if table.count() <= most_rows else table
