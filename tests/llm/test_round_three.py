"""Collocations, piece encoding and hard negatives against brute force and the library."""

import hashlib
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest

from recengine.llm import collocations as C
from recengine.llm import hard_negatives as H
from recengine.llm import piece_codec as P

MODEL = "piece_bpe_32k.model"


# ---- collocations


def brute_collocations(rows, least, share, top):
    f, words = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            words[lang] += len(ws)
            for k in (1, 2, 3):
                f.update((lang, tuple(ws[i : i + k])) for i in range(len(ws) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        longer = [n for (m, q), n in found.items() if m == lang and len(q) > len(p) and (q[:2] == p or q[1:] == p)]
        if any(100 * n >= share * a for n in longer):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, k, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right, k))
    return sorted((lang, r + 1, p.decode(), -a, x, y, words[lang], -s, k) for lang, rows in out.items() for r, (s, a, p, x, y, k) in enumerate(sorted(rows)[:top]))


def found_collocations(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut").collect())


@pytest.mark.parametrize("partitions", [1, 9])
def test_collocations_equal_brute_force(spark, partitions):
    rng = random.Random(partitions)
    vocabulary = ["the", "The", "of", "a", "é", "x\x01y", "日本", "new", "york", "city", "-"]
    rows = [(None, "en"), ("", "en"), (" \t\n", None), ("a b", None)]
    for _ in range(300):
        words = [rng.choices(vocabulary, weights=[9, 3, 5, 5, 2, 1, 1, 2, 2, 2, 1])[0] for _ in range(rng.randint(0, 25))]
        text = "".join(w + rng.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\x0b"]) for w in words)
        rows.append((text.replace("new york", "new york city") if rng.random() < 0.7 else text, rng.choice(["en", "en", "en", "de", None])))
    rows += rows[:20]  # repeated rows count each
    docs = spark.createDataFrame([(t, lang, 1, 2) for t, lang in rows], "text string, lang string, w1 int, n int").repartition(partitions)
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions * 3))  # ranges begin within a word's and a pair's rows
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert found_collocations(C.collocations(docs, 3, 50, 25)) == brute_collocations(rows, 3, 50, 25)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[1])


def test_counts_are_sent_on_when_memory_is_full(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(" ".join(rng.choice("abcdef") for _ in range(300)), "en") for _ in range(4)]
    docs = spark.createDataFrame(rows, "text string, lang string").coalesce(1)
    counts = C._Counts(2)
    for name, value in (("WORDS", 3), ("WAITING", 50)):
        monkeypatch.setattr(C, name, value)
    import pyarrow as pa

    out = []
    for t, lang in rows:
        C._words_and_pairs(C._Words(pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([t])], ["lang", "text"])), counts)
        assert counts.full
        out += [tuple(r.values()) for b in counts.rows() for r in b.to_pylist()]
    total = Counter()
    for lang, a, b, _, n in out:
        total[lang, a, b] += n
    words = [t.split() for t, _ in rows]
    expected = Counter(("en", w, None) for ws in words for w in ws) + Counter(("en", a, b) for ws in words for a, b in zip(ws, ws[1:], strict=False))
    assert total == expected
    assert found_collocations(C.collocations(docs, 10, 50, 50)) == brute_collocations(rows, 10, 50, 50)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "text string, lang string")
    assert C.collocations(empty).collect() == []
    assert C.collocations(spark.createDataFrame([(None, None), ("", "en")], "text string, lang string")).collect() == []


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000
    rows = [("en", "a", None, None, big), ("en", "b", None, None, big), ("en", "a", "b", None, big)]
    counts = spark.createDataFrame(rows, "lang string, w1 string, w2 string, w3 string, n long")
    before = C.phrase_counts
    try:
        C.phrase_counts = lambda *a: (counts, spark.createDataFrame([("en", 2 * big)], "lang string, words long"))
        assert found_collocations(C.collocations(counts)) == [("en", 1, "a b", big, big, big, 2 * big, 10**6, 1)]
    finally:
        C.phrase_counts = before


# ---- piece encoding


def library(proto=None):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=proto) if proto else P.codec(MODEL).library


def odd_texts(seed, n, letters):
    rng = random.Random(seed)
    return ["", " ", "  ", "▁", " ▁ a", "\n\n", "<s>a</s><unk>", "<0x41>", "a\0b", "a" * 5000, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(n))]


LETTERS = ["a", "ab", " ", "  ", "\n", "é", "日", "the", "ing", ".", "1", "▁", "𝄞", "<s>", "\t", "é", "ﬁ"]


def test_pieces_are_the_librarys_and_their_spans_tile_the_text():
    codec, texts = P.PieceCodec(MODEL), odd_texts(1, 1500, LETTERS)
    ids, begin, end, counts = codec.encode(texts)
    for t, a, b in zip(texts, counts[:-1], counts[1:], strict=True):
        assert ids[a:b].tolist() == codec.library.encode(t), t
        raw = t.encode()
        if b > a:
            assert begin[a] == 0 and end[b - 1] == len(raw) and (begin[a + 1 : b] == end[a : b - 1]).all(), t
        for i, x, y in zip(ids[a:b].tolist(), begin[a:b], end[a:b], strict=True):
            piece = codec.plain.id_to_piece(i)
            if codec.plain.is_byte(i):
                assert raw[x:y] == bytes([int(piece[3:5], 16)]), t
            else:
                assert raw[x:y].decode().replace(" ", "▁") in (piece, piece[1:]), t


def double_array(pairs):
    """A compiled character map by first fit, for tests: units of a double-array trie, then the replacements."""
    texts, values = b"", {}
    for key, value in pairs.items():
        values[key.encode()] = len(texts)
        texts += value.encode() + b"\0"
    units, taken, bases = {}, {0}, set()

    def put(at, prefix):
        labels = sorted({k[len(prefix)] for k in values if k.startswith(prefix) and len(k) > len(prefix)})
        leaf = prefix in values
        base = next(b for b in range(1, 1 << 20) if b not in bases and (at ^ b) < 1 << 21 and all((b ^ x) not in taken for x in [*labels, *([0] if leaf else [])]))
        units[at] = units.get(at, 0) | (at ^ base) << 10 if at else base << 10
        units[at] |= int(leaf) << 8
        bases.add(base)
        if leaf:
            taken.add(base)
            units[base] = values[prefix] | 1 << 31
        for x in labels:
            taken.add(base ^ x)
            units[base ^ x] = x
        for x in labels:
            put(base ^ x, prefix + bytes([x]))

    put(0, b"")
    size = (max(units) | 255) + 1
    blob = struct.pack(f"<{size}I", *(units.get(k, 1 << 31) for k in range(size)))
    return struct.pack("<I", len(blob)) + blob + texts


MAP = {"ﬁ": "fi", "é": "é", "é": "é", "ab": "ba", "abc": "the", "\t": " ", "\n": "", "日": " x "}


def number(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


@pytest.mark.parametrize("dummy,squeeze", [(0, 0), (0, 1), (1, 0), (1, 1)])
def test_a_compiled_character_map_is_followed_as_by_the_library(dummy, squeeze):
    compiled = double_array(MAP)
    assert P.character_map(compiled) == MAP
    spec = b"\x12" + number(len(compiled)) + compiled + b"\x18" + bytes([dummy]) + b"\x20" + bytes([squeeze])
    with open(P.tokenizer_file(MODEL), "rb") as f:
        proto = f.read() + b"\x1a" + number(len(spec)) + spec
    codec, own = P.PieceCodec(proto), library(proto)
    texts = odd_texts(2, 1500, [*LETTERS, "c", "abc"])
    ids, begin, end, counts = codec.encode(texts)
    for t, a, b in zip(texts, counts[:-1], counts[1:], strict=True):
        assert ids[a:b].tolist() == own.encode(t), t
        assert codec.normaliser.apply(t)[0].decode() == own.normalize(t).replace(" ", "▁"), t
        assert (begin[a:b] <= end[a:b]).all() and (begin[a + 1 : b] == end[a : max(a, b - 1)]).all() and (end[a:b] <= len(t.encode())).all(), t


def test_spans_of_replaced_prefixes():
    n = P.Normaliser({"ﬁ": "fi", "日": ""}, True, False, True, False)
    data, source = n.apply("aﬁ日 b")
    assert data.decode() == "▁afi▁b" and source.tolist() == [0, 0, 0, 0, 1, 1, 7, 7, 7, 8, 9]


def test_encode_decode_and_digests_on_tables(spark):
    rows = [(1, "Hello  wörld", 0), (1, "Hello  wörld", 1), (None, None, 2), (3, "", 3), (4, "x " * 3000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    lib = library()
    got = sorted(P.encode_pieces(docs, MODEL).collect(), key=lambda r: (r["doc_id"] or 0, len(r["ids"])))
    expected = sorted(((i, lib.encode(t or "")) for i, t, _ in rows), key=lambda r: (r[0] or 0, len(r[1])))
    assert [(r["doc_id"], r["ids"]) for r in got] == expected
    assert all(len(r["ids"]) == len(r["starts"]) == len(r["ends"]) for r in got)
    back = P.decode_pieces(P.encode_pieces(docs, MODEL).select("doc_id", "ids"), MODEL)
    assert Counter(tuple(r) for r in back.collect()) == Counter((i, lib.decode(lib.encode(t or ""))) for i, t, _ in rows)
    assert P.decode_pieces(spark.createDataFrame([(1, None)], "doc_id int, ids array<int>"), MODEL).collect()[0]["text"] is None
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()
    digests = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"], r["n_bytes"], r["covered_bytes"]) for r in P.round_trip(docs, MODEL).collect())
    want = Counter()
    for i, t, _ in rows:
        ids, size = lib.encode(t or ""), len((t or "").encode())
        want[i, len(ids), hexed(",".join(map(str, ids))), hexed(lib.decode(ids)), size, size] += 1
    assert digests == want
    for f in (P.encode_pieces, P.round_trip):
        assert f(docs.limit(0), MODEL).collect() == []


# ---- hard negatives


@pytest.mark.parametrize("dim,most", [(1, 5), (3, 1000), (64, 256), (128, 70_000), (300, 2**20), (1000, 255)])
def test_residue_products_are_exact(dim, most):
    rng = np.random.default_rng(dim)
    a, b = rng.integers(-most, most + 1, (17, dim)), rng.integers(-most, most + 1, (23, dim))
    a[0], b[0], b[1] = most, most, -most
    primes = H.primes_for(dim, int(np.linalg.norm(a, axis=1).max() * np.linalg.norm(b, axis=1).max() * 1.000001 + 1))
    assert (H.product(H.residues(a, primes), H.residues(b, primes), primes) == a @ b.T).all()


def brute_negatives(rows, is_anchor, positives=5, negatives=10):
    good = [(i, int(x), [int(np.floor(256 * float(c))) for c in v]) for i, v, x in rows if i is not None and x is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out, seen = [], set()
    for a in good:
        if not is_anchor(a[0]) or (key := (a[0], a[1], tuple(a[2]))) in seen:
            continue
        seen.add(key)
        scored = sorted((-sum(x * y for x, y in zip(a[2], v, strict=False)), i, label) for i, label, v in good if i != a[0])
        for ps, pi, _ in [s for s in scored if s[2] == a[1]][:positives]:
            fit = [s for s in scored if s[2] != a[1] and 30 * -ps <= 100 * -s[0] <= 90 * -ps][:negatives]
            out += [(a[0], pi, r + 1, s[1], -ps, -s[0]) for r, s in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, small):
    if small:  # several blocks, parts and batches
        for name, value in (("ANCHORS", 4), ("LEAST_ROWS", 40), ("MOST_ROWS", 70), ("TILE", 8192 * 2)):
            monkeypatch.setattr(H, name, value)
    rng = np.random.default_rng(7)
    rows = []
    for i in range(300):
        v = (rng.integers(-2, 4, 6) / 4).tolist()  # many ties
        rows.append((i, v, int(rng.integers(0, 4))))
    rows[5] = (5, None, 1)
    rows[10] = (10, [0.5, None, 0.0, 0.0, 0.0, 0.0], 1)
    rows[20] = (20, [float("nan")] + [0.0] * 5, 1)
    rows[21] = (21, [float("inf")] + [0.0] * 5, 1)
    rows[30] = (30, rows[30][1], None)
    rows[40] = (40, [], 2)
    rows[41] = (41, [1.0, -0.5], 2)
    rows[50] = (50, [-1.0] * 6, 3)  # no product above 0
    rows += [(None, [1.0] * 6, 1), rows[60], rows[60], (61, rows[61][1], rows[61][2])]
    table = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, id int, rank int").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37" if small else before)
        got = H.mine(table, table.where("vec_id % 10 = 0"))
        assert sorted(tuple(r) for r in got.collect()) == brute_negatives(rows, lambda i: i % 10 == 0)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_hard_negatives_of_nothing_and_of_too_much(spark):
    table = spark.createDataFrame([(1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert H.mine(table, table.limit(0)).collect() == H.mine(table.limit(0), table.limit(0)).collect() == H.mine(table, table).collect() == []
    with pytest.raises(ValueError):
        huge = spark.createDataFrame([(1, [1e30], 1)], "vec_id long, embedding array<float>, label int")
        H.mine(huge, huge)
