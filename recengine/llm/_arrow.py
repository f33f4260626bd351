"""Byte-level views of Arrow text columns for vectorised work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one vectorised step handles; a longer text is one step of its own.
STEP_BYTES = 500_000

#: True for the bytes that separate words: space and 0x09-0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: Lower-cases A-Z and leaves all other bytes.
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32


def steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batch whose texts come to about ``most`` bytes each; nulls in ``text`` become empty."""
    if batch.num_rows == 0:
        return
    k = batch.schema.get_field_index(text)
    sizes = pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    if batch.column(k).null_count:  # else the texts aren't copied
        filled = pc.fill_null(batch.column(k), "")
        batch = batch.set_column(k, pa.field(text, filled.type), filled)
    part = (np.cumsum(sizes) - sizes) // most
    cuts = np.flatnonzero(np.diff(part)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(sizes)], strict=True):
        yield batch.slice(int(a), int(b - a))
    pa.default_memory_pool().release_unused()  # workers live on between tasks


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and the n + 1 offsets of the texts."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), offs - offs[0]
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def words(data: np.ndarray, offs: np.ndarray, space: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and text indexes of the words (runs of bytes that aren't white space, or whatever ``space`` says)."""
    solid = ~space[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    begins = offs[:-1][offs[:-1] < offs[1:]]
    first[begins] = solid[begins]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = offs[1:][offs[:-1] < offs[1:]] - 1
    last[ends] = solid[ends]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(offs, start, side="right") - 1


def word_codes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each word its place in the list of distinct words."""
    if not len(start):
        return np.zeros(0, np.int64), []
    keep = np.zeros(len(data) + 1, np.int8)
    keep[start] += 1
    keep[end] -= 1
    packed = np.ascontiguousarray(data[np.cumsum(keep[:-1], dtype=np.int8).astype(bool)])
    offsets = np.r_[0, np.cumsum(end - start)].astype(np.int64)
    column = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(packed.tobytes())])
    coded = column.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising rounds of splitmix64: every input bit reaches every output bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_ROW = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word from its bytes alone, so equal words agree in every task."""
    if not len(start):
        return np.zeros(0, np.uint64)
    size = end - start
    where = np.repeat(start - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(int(size.sum()))
    at = where - np.repeat(start, size)
    powers = np.ones(int(size.max()), np.uint64)
    powers[1:] = _BASE
    powers = np.multiply.accumulate(powers)
    terms = _ROW[data[where]] * powers[at]
    sums = np.add.reduceat(terms, np.r_[0, np.cumsum(size)[:-1]])
    return mix(sums + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
