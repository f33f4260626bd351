"""SentencePiece encoding that keeps the source alignment, and decoding.

1. Normalisation is done here: the compiled character map of the model is unpacked
   once, and at each position of a text its longest prefix is replaced. Every
   normalised byte remembers the byte of the text that it came from.
2. The normalised text is cut into words before their space marks. No piece of the
   vocabulary holds a pair of characters that meets at such a cut (this is looked up;
   where it doesn't hold, a text is one word), so no merge crosses it, and the ids of
   a text are those of its words. Distinct words are encoded by the library once in
   a step and remembered, with a model whose own normalisation is off.
3. The end of each piece in normalised bytes goes through the alignment, so each
   piece has a span of bytes of the text as it was given. Spans follow one another
   without overlaps; the pieces of one replaced prefix share its span: all but the
   last have an empty one at its start. Bytes that normalisation drops at the very
   start or end, or in a run of white space, lie in no span or in the one before them.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm._arrow import steps, word_codes
from recengine.llm.token_counts import SPACE_MARK, tokenizer_file

_MARK = np.frombuffer(SPACE_MARK.encode(), np.uint8)
#: Bytes of the words that a task remembers; then it starts afresh.
REMEMBERED_BYTES = 16 << 20


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        out, shift = 0, 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at : at + size]
            at += size


def character_map(compiled: bytes) -> dict[str, str]:
    """The prefixes and replacements of a compiled character map: a double-array trie, then the replacements, ended by zeros."""
    if not compiled:
        return {}
    (size,) = struct.unpack_from("<I", compiled)
    units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
    texts = compiled[4 + size :]
    out: dict[str, str] = {}
    below = lambda unit: (unit >> 10) << ((unit & (1 << 9)) >> 6)
    open_ = [(b"", below(units[0]))]
    while open_:
        prefix, place = open_.pop()
        for label in range(1, 256):
            k = place ^ label
            if k < len(units) and units[k] & 0x800000FF == label:
                longer, child = prefix + bytes([label]), k ^ below(units[k])
                if units[k] >> 8 & 1:
                    begin = units[child] & 0x7FFFFFFF
                    out[longer.decode()] = texts[begin : texts.index(0, begin)].decode()
                open_.append((longer, child))
    return out


@dataclass
class Normaliser:
    """The normalisation that a model asks for, with the source of every byte."""

    replaced: dict[str, str]
    dummy_prefix: bool
    squeeze: bool
    escape: bool
    suffix: bool
    whole: frozenset[str] = frozenset()

    def __post_init__(self):
        known = sorted({*self.replaced, *self.whole}, key=len, reverse=True)  # longest first
        self.any_prefix = re.compile("|".join(map(re.escape, known))) if known else None

    def parts(self, text: str) -> list[tuple[str, int]]:
        """Replacements and stretches that stay, each with its bytes in the text (0 for stretches: as long as they are)."""
        out, at = [], 0
        for m in self.any_prefix.finditer(text) if self.any_prefix else ():
            if m.start() > at:
                out.append((text[at : m.start()], 0))
            out.append((m[0] if m[0] in self.whole else self.replaced[m[0]], len(m[0].encode())))
            at = m.end()
        out.append((text[at:], 0))
        return out

    def apply(self, text: str) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them, and the end, the byte of ``text`` where it begins."""
        blocks, sources, at = [], [], 0
        for part, taken in self.parts(text):
            raw = np.frombuffer(part.encode(), np.uint8)
            blocks.append(raw)
            sources.append(np.arange(at, at + len(raw)) if not taken else np.full(len(raw), at))
            at += taken or len(raw)
        data, source = np.concatenate(blocks), np.concatenate(sources)
        end = at
        if self.squeeze and len(data):  # one space of each run, none at the start
            space = data == 32
            keep = ~space
            keep[1:] |= space[1:] & ~space[:-1]
            data, source = data[keep], source[keep]
        if self.dummy_prefix and text:
            k = len(data) if self.suffix else 0
            data, source = np.insert(data, k, 32), np.insert(source, k, end if self.suffix or not k < len(source) else source[0])
        if self.escape and (data == 32).any():
            wide = np.where(data == 32, 3, 1)
            first = np.cumsum(wide) - wide
            source, marks = np.repeat(source, wide), first[data == 32]
            data = np.repeat(data, wide)
            data[marks[:, None] + np.arange(3)] = _MARK
        done, mark = data.tobytes(), SPACE_MARK.encode() if self.escape else b" "
        while self.squeeze and done.endswith(mark):  # none at the end, also of those that stood in the text as marks
            done = done[: -len(mark)]
            end = int(source[len(done)])
        return done, np.r_[source[: len(done)], end]


class PieceCodec:
    """Encodes whole texts to ids with spans of their bytes, as the library does; decodes ids."""

    def __init__(self, name_or_bytes: str | bytes):
        import sentencepiece

        if isinstance(name_or_bytes, bytes):
            proto = name_or_bytes
        else:
            with open(tokenizer_file(name_or_bytes), "rb") as f:
                proto = f.read()
        spec: dict[int, int | bytes] = {}
        whole, suffix = set(), False
        for field, value in _fields(proto):
            if field == 3:  # how to normalise; repeated messages are merged
                spec |= dict(_fields(value))
            elif field == 2:
                suffix = bool(dict(_fields(value)).get(24, suffix))
            elif field == 1 and (piece := dict(_fields(value))).get(3) == 4:  # defined by the user: never changed
                whole.add(piece[1].decode())
        replaced = character_map(spec.get(2, b""))
        self.normaliser = Normaliser(replaced, bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1)), suffix, frozenset(whole))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=proto)
        # the same pieces with a normalisation that changes nothing: a later message replaces the fields of an earlier one
        self.plain = sentencepiece.SentencePieceProcessor(model_proto=proto + b"\x1a\x08\x12\x00\x18\x00\x20\x00\x28\x00")
        pieces = [self.plain.id_to_piece(i) for i in range(self.plain.get_piece_size())]
        real = [p for i, p in enumerate(pieces) if not (self.plain.is_byte(i) or self.plain.is_control(i) or self.plain.is_unknown(i))]
        self.cut = not any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in real) and self.normaliser.escape
        self.sizes = np.array([1 if self.plain.is_byte(i) else len(p.encode()) for i, p in enumerate(pieces)], np.int32)
        self.unknown = self.plain.unk_id()
        self._forget()

    def _forget(self) -> None:
        """The words that are known by number; a number's pieces are ``n`` entries of the two pools from ``first`` on."""
        self.known: dict[bytes, int] = {}
        self.first, self.n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool, self.pool_sizes = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.held = 0

    def _numbers(self, words: list[bytes]) -> np.ndarray:
        """The numbers of distinct words; new ones are encoded."""
        new = [w for w in words if w not in self.known]
        if new:
            found = self.plain.encode([w.decode() for w in new], num_threads=1)
            n = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(chain.from_iterable(found), np.int32, int(n.sum()))
            sizes = self.sizes[ids]
            first = np.cumsum(n) - n
            if self.unknown >= 0 and (ids == self.unknown).any():  # a piece without bytes of its own: sizes from the text
                for k in np.unique(np.searchsorted(first, np.flatnonzero(ids == self.unknown), side="right") - 1):
                    pieces = self.plain.encode(new[k].decode(), out_type="immutable_proto").pieces
                    sizes[first[k] : first[k] + n[k]] = [len(x.surface.encode()) for x in pieces]
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.first, self.n = np.r_[self.first, first + len(self.pool)], np.r_[self.n, n]
            self.pool, self.pool_sizes = np.r_[self.pool, ids], np.r_[self.pool_sizes, sizes]
            self.held += sum(map(len, new)) + 8 * len(ids)
        return np.array([self.known[w] for w in words], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, first and last byte (exclusive) of each piece in its text, and the number of pieces up to each text (from 0)."""
        if self.held > REMEMBERED_BYTES:
            self._forget()
        done = [self.normaliser.apply(t) for t in texts]
        offs = np.r_[0, np.cumsum([len(d) for d, _ in done])].astype(np.int64)
        data = np.frombuffer(b"".join(d for d, _ in done), np.uint8)
        first = np.zeros(len(data) + 1, bool)
        first[offs[:-1]] = True
        if self.cut and len(data) > 2:
            mark = np.zeros(len(data), bool)
            mark[:-2] = (data[:-2] == _MARK[0]) & (data[1:-1] == _MARK[1]) & (data[2:] == _MARK[2])
            first[3:-1] |= mark[3:] & ~mark[:-3]
            first[1:3] |= mark[1:3]
        start = np.flatnonzero(first[:-1])
        end = np.r_[start[1:], len(data)][: len(start)]
        codes, distinct = word_codes(data, start, end)
        number = self._numbers(distinct)[codes]
        per = self.n[number]
        stop = np.cumsum(per)
        take = np.repeat(self.first[number] - (stop - per), per) + np.arange(int(stop[-1]) if len(stop) else 0)
        ids, sizes = self.pool[take], self.pool_sizes[take].astype(np.int64)
        ends = np.cumsum(sizes)
        counts = np.r_[0, stop][np.searchsorted(start, offs)]
        # normalised bytes to bytes of the text: each text has one entry more than bytes
        source = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
        shift = np.repeat(np.arange(len(texts)), np.diff(counts))
        return ids, source[ends - sizes + shift], source[ends + shift], counts

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids) if ids else []


@lru_cache(maxsize=2)
def codec(name: str) -> PieceCodec:
    return PieceCodec(name)


def _texts(part: pa.RecordBatch) -> list[str]:
    return part.column(part.schema.get_field_index("text")).to_pylist()


def encode_pieces(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, ids, starts, ends: the ids of its pieces and their spans of UTF-8 bytes in the text.

    Null texts count as empty and have no pieces. Texts are encoded whole, however
    long. Rows with null or repeated ids keep a row each. Only the two columns are
    read, so others may have any names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    names = ["id", "ids", "starts", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for part in steps(batch):
                ids, begin, end, counts = own.encode(_texts(part))
                lists = lambda x: pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), pa.array(x.astype(np.int32)))  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), lists(ids), lists(begin), lists(end)], names)

    ints = T.ArrayType(T.IntegerType())
    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, ints) for n in names[1:])])
    return rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def decode_pieces(rows: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``rows``: id_col, text: its ids (array<int>) decoded. Null arrays give null, empty ones the empty text."""
    own_rows = rows.select(F.col(id_col).alias("id"), F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                lists = part.column(1).to_pylist()
                text = iter(own.decode([x for x in lists if x is not None]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else next(text) for x in lists], pa.string())], ["id", "text"])

    out = T.StructType([T.StructField("id", own_rows.schema["id"].dataType), T.StructField("text", T.StringType())])
    return own_rows.mapInArrow(run, out).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_tokens, ids_sha256, decoded_sha256, n_bytes, covered_bytes, spans_crc32.

    The digests of encode_pieces and decode_pieces, made in the task that encodes, so
    neither ids nor texts leave it: SHA-256 of the decimal ids joined by commas and of
    the decoded text. ``covered_bytes`` are the bytes of the text that lie in the span
    of a piece, ``spans_crc32`` is over the spans as little-endian pairs of 32 bits.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kinds = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType(), "n_bytes": T.LongType(), "covered_bytes": T.LongType(), "spans_crc32": T.LongType()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        decimal = [str(i) for i in range(len(own.sizes))]
        for batch in batches:
            for part in steps(batch):
                texts = _texts(part)
                ids, begin, end, counts = own.encode(texts)
                spans = np.stack([begin, end], 1).astype("<u4")
                covered = np.r_[0, np.cumsum(end - begin)]
                out: list[list] = [[] for _ in kinds]
                for text, a, b in zip(texts, counts[:-1], counts[1:], strict=True):
                    mine = ids[a:b].tolist()
                    joined = ",".join([decimal[i] for i in mine])
                    back = own.decode([mine])[0]
                    row = b - a, hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), len(text.encode()), covered[b] - covered[a], zlib.crc32(spans[a:b].tobytes())
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                types = [pa.string() if isinstance(t, T.StringType) else pa.int64() for t in kinds.values()]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), *(pa.array(x, t) for x, t in zip(out, types, strict=True))], ["id", *kinds])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(n, t) for n, t in kinds.items())])
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)
