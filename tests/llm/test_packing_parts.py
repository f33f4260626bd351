"""Ids by parts of texts equal the tokenizer's, and parts of letters are merged without normaliser and regular expressions."""

import numpy as np
import pyarrow as pa

from recengine.llm.packing import WordIds

NAME = "word_bpe_49k.json"
ODD = [
    "", " ", "Hello WORLD!! the(thing) it's 'still' X!'s a=b; ÉTÉ ñuÑu ßÞ×÷", "Été H̱i ẖ ≠x x≠ ſa Kelvin İstanbul ΣΣ",
    "<|endoftext|>a <|ENDOFTEXT|> x<|startoftext|>!", "a@b.com,c;d:e?f\"g#h$i%j&k*l/m+n(o)p", "ªºµ naïvȩ ÿŸ \x01a b\x01 　c d", "é" * 50 + " " + "Ab" * 300,
]


def test_ids_of_parts_equal_the_tokenizers():
    encoder = WordIds(NAME)
    rng = np.random.default_rng(2)
    letters = list("aAbZéÉß×̸́'.,!?(<|>=@ 1") + ["'s", "Σ", "K"]
    texts = ODD + ["".join(rng.choice(letters, rng.integers(1, 30))) for _ in range(3000)]
    ids, ends = encoder.texts(pa.array(texts))
    for k, text in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_parts_of_letters_are_merged_alone_and_in_one_case(monkeypatch):
    encoder, plain = WordIds(NAME), []
    encode = encoder.encode
    monkeypatch.setattr(encoder, "encode", lambda parts: plain.extend(parts) or encode(parts))
    texts = ["Tiatior TIATIOR tiatior Ñueas ñueas THTI!! 12"]
    ids, _ = encoder.texts(pa.array(texts))
    assert ids.tolist() == encoder.tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert sorted(plain) == [b"!!", b"12"]
