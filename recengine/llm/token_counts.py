"""Token counts of whole texts, with overlap resynchronisation for huge ones.

Texts up to ``chunk_chars`` are encoded in one call. A longer text is encoded as
overlapping chunks with token offsets. Two neighbouring chunks are spliced at a
position in their overlap that (a) both encodings have as a token boundary and
(b) is proven stable: no piece of the vocabulary holds that pair of neighbouring
characters, so no merge can cross it, whatever stands around. If an overlap has
no such position it is widened, at last to the whole of the two chunks; these are
then encoded as one, and the next chunk is as long as both, so that a text without
any stable position costs a few calls over the text and not one for each chunk.
The count therefore equals that of one call over the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm._arrow import steps

SPACE_MARK = "▁"
#: Characters on each side of a position that normalisation may look at.
NEAR = 8


def tokenizer_file(name: str) -> str:
    """The place of a tokenizer file: a path as it is, a bare name from the installed tokenizer package."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


@lru_cache(maxsize=4)
def piece_model(name: str):
    """The model, and the pairs of neighbouring characters within its pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
    pairs = set()
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            piece = model.id_to_piece(i)
            pairs.update(zip(piece, piece[1:], strict=False))
    return model, pairs


def boundaries(model, text: str) -> dict[int, int]:
    """Character offsets of the token boundaries of a text, each with the number of tokens before it."""
    at: dict[int, int] = {0: 0}
    for k, (_, end) in enumerate(model.encode_as_offset_mapping(text)["offsets"]):
        at.setdefault(end, k + 1)  # the bytes of a character outside the vocabulary end where it begins, but for the last
    return at


def count_long(text: str, name: str, chunk_chars: int, overlap_chars: int) -> int:
    """Tokens of one text by chunks [a, b) that overlap and are spliced at stable common boundaries."""
    model, pairs = piece_model(name)
    normal = lambda part: model.normalize("|" + part).partition("|")[2]

    @lru_cache(maxsize=4096)
    def apart(before: str, after: str) -> bool:
        """Whether the normalised characters on both sides are those of each side alone, and no piece holds the two that meet."""
        left, right = normal(before), normal(after)
        return normal(before + after) == left + right and bool(left and right) and (left[-1], right[0]) not in pairs

    def stable(p: int) -> bool:
        return apart(text[max(0, p - NEAR) : p], text[p : p + NEAR])

    total, a, done, step = 0, 0, 0, chunk_chars  # done: everything before this position is counted
    b = min(len(text), chunk_chars)
    left = boundaries(model, text[a:b])
    while b < len(text):
        overlap, far = overlap_chars, min(len(text), b + step)
        while True:
            start = max(done, b - overlap)
            if start <= done:  # the overlap has become the whole chunk: encode both as one
                b, left, step = far, boundaries(model, text[a:far]), 2 * step
                break
            fit = [p for p in range(b - 1, start, -1) if p - a in left and p > done and stable(p)]
            right = boundaries(model, text[start:far]) if fit else {}
            common = next((p for p in fit if p - start in right), None)
            if common is not None:
                total += left[common - a] - left[done - a]
                a, b, left, done, step = start, far, right, common, chunk_chars
                break
            overlap *= 16
    return total + left[len(text) - a] - left[done - a]


def count_tokens(
    docs: DataFrame,
    model: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 4096,
    chunk_chars: int = 16384,
    overlap_chars: int = 256,
) -> DataFrame:
    """One row per row of ``docs``: id_col, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Null texts count as empty: 0 bytes, 0 tokens. Rows with null or repeated ids
    keep a row each. Only the two columns are read, so others may have any names.
    An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        processor, _ = piece_model(model)
        for batch in batches:
            for part in steps(batch):
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                short = [t for t in texts if len(t) <= chunk_chars]
                counted = iter(map(len, processor.encode(short, num_threads=1)) if short else ())
                n = [next(counted) if len(t) <= chunk_chars else count_long(t, model, chunk_chars, overlap_chars) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("id")), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    out = T.StructType([T.StructField("id", kind), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return rows.mapInArrow(run, out).select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
