"""Packing token sequences: shortest-pack-first over the length histogram.

1. Every text is tokenized once; its ids and the end id are cut into pieces of at
   most ``max_len`` ids, and the pieces (not the ids) are written as a scratch table.
2. The histogram of piece lengths, at most ``max_len`` rows, goes to the driver.
   Lengths are placed longest first, each into the packing pattern with the most
   space left, and only the counts of the patterns are updated.
3. Pieces of a length are ranked in Spark and the patterns are joined back by
   rank: the k-th use of a length in the patterns takes the piece of rank k.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm._arrow import steps, text_bytes, word_codes, words
from recengine.llm._scratch import materialize
from recengine.llm.token_counts import tokenizer_file

#: Bounds of what a worker remembers, distinct parts of texts and their bytes; then it starts afresh.
REMEMBERED, REMEMBERED_BYTES = 300_000, 16 << 20


@lru_cache(maxsize=2)
def word_ids(name: str) -> WordIds:
    """One per worker process, so that tasks after each other share what they know."""
    return WordIds(name)


@lru_cache(maxsize=2)
def word_tokenizer(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file(name))


# Normaliser, pre-tokenizer and model of the tokenizers that texts may be cut for.
RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "BPE",
)

#: A character that is a token of its own.
MARK = b"\x01"
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
#: Signs that texts are cut at beside an ASCII letter, but for those of added tokens.
STOPS = '.,!"#$%&()*+/:;=?@'
#: Parts of letters of Latin-1 alone: each is one piece to the RULES, and lower case is all that they change.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_END = "</w>"


class WordIds:
    """Ids of texts by way of their distinct parts.

    A tokenizer with the RULES drops white space before it merges, and none of its
    rules looks across white space, or merges an ASCII letter with one of the STOPS.
    So a text's ids are those of its parts in a row, and each distinct part is
    encoded once; its ids lie in one array, found by the part's number. Parts of
    Latin-1 letters, in lower case, are merged without normaliser and regular expressions.
    Any other tokenizer encodes whole texts.
    """

    def __init__(self, name: str):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = word_tokenizer(name)
        described = json.loads(self.tokenizer.to_str())
        self.by_parts = (described["normalizer"], described["pre_tokenizer"], described["model"]["type"]) == RULES
        added = "".join(x["content"] for x in described["added_tokens"])
        self.stop = np.zeros(256, bool)
        self.stop[[ord(x) for x in STOPS if x not in added]] = True
        self.merges = None
        if self.by_parts and described["model"]["end_of_word_suffix"] == _END and not any(_LETTERS.fullmatch(x["content"].encode()) for x in described["added_tokens"]):
            self.merges = Tokenizer.from_file(tokenizer_file(name))
            self.merges.normalizer = normalizers.Sequence([])
            self.merges.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            vocabulary = self.merges.get_vocab()
            self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
            self.ends[[k for x, k in vocabulary.items() if x.endswith(_END)]] = True
        self.forget()

    def forget(self) -> None:
        self.bytes = 0
        self.known: dict[bytes, int] = {}
        self.flat, self.size = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts in a row, and how many each has."""
        if any(MARK in w for w in parts):
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch([w.decode() for w in parts], add_special_tokens=False)]
            return np.concatenate(each), np.array([len(x) for x in each], np.int64)
        # one text is encoded much faster than many: the mark between parts has one id, which no part has
        text = b" %s " % MARK
        ids = np.array(self.tokenizer.encode_batch_fast([text.join(parts).decode()], add_special_tokens=False)[0].ids, np.uint32)
        (mark,) = self.tokenizer.encode(MARK.decode(), add_special_tokens=False).ids
        between = np.flatnonzero(ids == mark)
        return np.delete(ids, between), np.diff(np.r_[-1, between, len(ids)]) - 1

    def encode_letters(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The same for parts of Latin-1 letters in lower case: the last id of each is known by its suffix."""
        ids = np.array(self.merges.encode_batch_fast([b" ".join(parts).decode()], add_special_tokens=False)[0].ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(parts) or last[-1] != len(ids) - 1:  # a letter that has no id at the end of a word
            return self.encode(parts)
        return ids, np.diff(np.r_[-1, last])

    def of(self, distinct: list[bytes]) -> np.ndarray:
        """Numbers of the parts; new ones are encoded."""
        if len(self.known) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.forget()
        known = self.known
        new = [w for w in distinct if w not in known]
        self.bytes += sum(map(len, new))
        letters = {w: w.decode().lower().encode() for w in new if _LETTERS.fullmatch(w)} if self.merges else {}
        lower = [w for w in dict.fromkeys(letters.values()) if w not in known]
        flats, sizes = [self.flat], [self.size]
        for encode, parts in ((self.encode_letters, lower), (self.encode, [w for w in new if w not in letters])):
            for k in range(0, len(parts), 20_000):
                ids, size = encode(parts[k : k + 20_000])
                flats.append(ids)
                sizes.append(size)
            n = sum(map(len, sizes))
            known.update(zip(parts, range(n - len(parts), n), strict=True))
        known.update((w, known[x]) for w, x in letters.items())
        if new:
            self.flat, self.size = np.concatenate(flats), np.concatenate(sizes)
        return np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and the n + 1 offsets of the texts."""
        if not self.by_parts:
            each = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch(column.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.zeros(0, np.uint32), *each]), np.r_[0, np.cumsum([len(x) for x in each], dtype=np.int64)]
        data, offs = text_bytes(column)
        start, end, doc = words(data, offs)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(column) + 1, np.int64)
        letter, stop = _LETTER[data], self.stop[data]
        at = np.flatnonzero((letter[:-1] & stop[1:]) | (stop[:-1] & letter[1:])) + 1
        at = np.setdiff1d(at, start, assume_unique=True)  # a text may begin there
        start, end = np.sort(np.concatenate([start, at])), np.sort(np.concatenate([end, at]))
        doc = np.searchsorted(offs, start, side="right") - 1
        codes, distinct = word_codes(data, start, end)
        part = self.of(distinct)[codes]
        begin = np.cumsum(self.size) - self.size
        per_part = self.size[part]
        out_begin = np.cumsum(per_part) - per_part
        where = np.repeat(begin[part] - out_begin, per_part) + np.arange(int(per_part.sum()))
        ends = np.r_[0, np.cumsum(np.bincount(doc, weights=per_part, minlength=len(column)).astype(np.int64))]
        return self.flat[where], ends


def cut(docs: DataFrame, tokenizer: str, max_len: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """Pieces of at most ``max_len`` ids: id, start, length, ids_crc32, doc_tokens."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        for batch in batches:
            for part in steps(batch, most=2_000_000):
                ids, ends = encoder.texts(part.column(part.schema.get_field_index("text")))
                row, start, length, crc, tokens = [], [], [], [], []
                for k in range(part.num_rows):
                    own = np.append(ids[ends[k] : ends[k + 1]], np.uint32(end_id)).astype("<u4")
                    for s in range(0, len(own), max_len):
                        piece = own[s : s + max_len]
                        row.append(k), start.append(s), length.append(len(piece)), crc.append(zlib.crc32(piece.tobytes())), tokens.append(len(own))
                taken = part.column(part.schema.get_field_index("id")).take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([taken, *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))], ["id", "start", "length", "ids_crc32", "doc_tokens"])

    fields = [T.StructField("id", rows.schema["id"].dataType), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32", "doc_tokens"))]
    return rows.mapInArrow(run, T.StructType(fields))


def pack_histogram(counts: dict[int, int], max_len: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order, how often) that use up the histogram; their number is bounded by the lengths."""
    room: dict[int, dict[tuple[int, ...], int]] = {}

    def put(space: int, pattern: tuple[int, ...], n: int) -> None:
        own = room.setdefault(space, {})
        own[pattern] = own.get(pattern, 0) + n

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            space = max((s for s, own in room.items() if own and s >= length), default=None)
            if space is None:  # no pattern has room: open new ones, filled with this length alone
                each = max_len // length
                packs, rest = divmod(left, each)
                if packs:
                    put(max_len - each * length, (length,) * each, packs)
                if rest:
                    put(max_len - rest * length, (length,) * rest, 1)
                break
            pattern, n = next(iter(room[space].items()))
            used = min(n, left)
            if used == n:
                del room[space][pattern]
            else:
                room[space][pattern] = n - used
            put(space - length, (*pattern, length), used)
            left -= used
    return [(p, n) for _, own in sorted(room.items()) for p, n in own.items()]


def pack(
    docs: DataFrame,
    tokenizer: str,
    max_len: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts count as empty and give one piece of the end id alone. Rows with
    null or repeated ids are packed like others. An empty table gives no rows.
    """
    pieces = materialize(cut(docs, tokenizer, max_len, end_id, id_col, text_col), "pieces")
    counted = materialize(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")), "piece-lengths")
    histogram = {r["length"]: r["n"] for r in counted.collect()}  # at most max_len rows

    # slots by length: ranks [first, first + n) of the length go to sequences seq.. at this offset
    slots: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    sequence = 0
    for pattern, n in pack_histogram(histogram, max_len):
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((used.get(length, 0), sequence, offset))
            used[length] = used.get(length, 0) + n
            offset += length
        sequence += n
    by_length = {k: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for k, v in slots.items()}

    # rank within a length, without one task per length: by salt, each salt starting after those before it
    # about as many salts as rows of a salt: neither the rows of one nor the salts of a length are many
    salts = F.broadcast(counted.select("length", F.ceil(F.sqrt("n")).alias("salts")))  # at most max_len rows
    salted = pieces.join(salts, "length").withColumn("salt", F.pmod(F.xxhash64("id", "start", "ids_crc32"), F.col("salts"))).drop("salts")
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "salt").orderBy("id", "start", "ids_crc32")
    ranked = salted.join(starts, ["length", "salt"]).withColumn("rank", F.col("base") + F.row_number().over(order) - 1)
    ranked = ranked.select("id", "start", "length", "ids_crc32", "doc_tokens", F.col("rank").cast("long").alias("rank"))

    names = [*ranked.columns[:5], "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column(2).to_numpy(), batch.column(5).to_numpy()
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for x in np.unique(length):
                at = np.flatnonzero(length == x)
                first, to, where = by_length[int(x)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                seq[at], off[at] = to[k] + rank[at] - first[k], where[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(5)), pa.array(seq), pa.array(off)], names)

    fields = [*ranked.schema.fields[:5], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    return ranked.mapInArrow(place, T.StructType(fields)).withColumnRenamed("id", id_col)
