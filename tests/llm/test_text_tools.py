import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from recengine.llm import decontam, langid, line_dedup, ngram_join, packing, pii, quality, token_counts, warc
from recengine.llm._arrow import text_bytes, word_codes, word_hashes, words

WORDS = r"[^\x20\x09-\x0D]+"
ODD = ["", " ", "a", "A b  c\td\n", "é́,a .b", "日本語、x", "\x01 x", "a" * 5000, "x, y. <|endoftext|>z don't", "\n\n", " lead"]


def test_words_are_the_runs_without_white_space():
    data, offs = text_bytes(pa.array(ODD))
    start, end, doc = words(data, offs)
    found = [[] for _ in ODD]
    for s, e, k in zip(start, end, doc, strict=True):
        found[k].append(bytes(data[s:e]).decode())
    assert found == [re.findall(WORDS, t) for t in ODD]
    codes, distinct = word_codes(data, start, end)
    assert [distinct[c].decode() for c in codes] == [w for t in ODD for w in re.findall(WORDS, t)]
    hashes = word_hashes(data, start, end)
    assert len(set(zip(codes, hashes, strict=True))) == len(set(codes)) == len(set(hashes))


@pytest.mark.parametrize("chunk,overlap", [(300, 1), (1000, 64)])
@pytest.mark.parametrize("text", ["lorem ipsum, dolor " * 400, "a" * 3000, "ab c" * 900, "é▁ ▁x" * 700, "\n\n  " * 900, "日本語" * 700, "x" * 1499 + " " + "y" * 1500])
def test_resynchronised_counts_are_those_of_one_call(text, chunk, overlap):
    model, _ = token_counts.piece_model("piece_bpe_32k.model")
    assert token_counts.count_long(text, "piece_bpe_32k.model", chunk, overlap) == len(model.encode(text))


def test_ids_by_parts_are_those_of_whole_texts():
    encoder = packing.WordIds("word_bpe_49k.json")
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choices(string.ascii_letters + " ., '\n1é<|>", k=80)) for _ in range(200)]
    ids, ends = encoder.texts(pa.array(texts))
    for k, t in enumerate(texts):
        assert ids[ends[k] : ends[k + 1]].tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_texts_without_a_stable_position_cost_a_few_calls():
    calls, boundaries = [], token_counts.boundaries
    try:
        token_counts.boundaries = lambda model, text: calls.append(len(text)) or boundaries(model, text)
        assert token_counts.count_long("a" * 200_000, "piece_bpe_32k.model", 1000, 64) == len(token_counts.piece_model("piece_bpe_32k.model")[0].encode("a" * 200_000))
    finally:
        token_counts.boundaries = boundaries
    assert sum(calls) < 4 * 200_000


def test_random_texts_are_counted_as_by_one_call():
    model, _ = token_counts.piece_model("piece_bpe_32k.model")
    rng = random.Random(1)
    for _ in range(150):
        text = "".join(rng.choice(["a", "ab", " ", "  ", "\n", "é", "日", "the", "ing", ".", "1", "▁", "e\u0301", "ﬁ"]) for _ in range(rng.randint(1, 900)))
        assert token_counts.count_long(text, "piece_bpe_32k.model", 50, 4) == len(model.encode(text))


def test_histogram_packing_uses_every_piece_once_with_little_padding():
    rng = random.Random(5)
    counts = {}
    for _ in range(5000):
        n = min(2048, int(rng.lognormvariate(5.5, 1.2)) + 1)
        counts[n] = counts.get(n, 0) + 1
    patterns = packing.pack_histogram(counts, 2048)
    used = {}
    for p, n in patterns:
        assert sum(p) <= 2048
        for x in p:
            used[x] = used.get(x, 0) + n
    assert used == counts
    assert sum(k * n for k, n in counts.items()) / (2048 * sum(n for _, n in patterns)) > 0.97
    assert packing.pack_histogram({}, 2048) == []


def test_feistel_is_a_permutation_and_formats_stay_valid():
    key = b"k"
    for size in (1, 2, 3, 10, 97, 1000):
        moved = [pii.permute(key, "a", x, size) for x in range(size)]
        assert sorted(moved) == list(range(size))
        assert [pii.unpermute(key, "a", y, size) for y in moved] == list(range(size))
    text = "card 4111 1111 1111 1111, ip 10.2.3.4 not 999.1.1.1, iban DE89 3704 0044 0532 0130 00, on 2024-02-29 not 2024-02-30, ssn 123-45-6789, tel +1 (017) 555-7713, to jo.Doe99@mail7.example.com"
    out, n = pii.pseudonymise(text, key)
    assert n == 7 and "999.1.1.1" in out and "2024-02-30" in out and "4111" not in out
    assert re.sub(r"\d", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", out))) .count("@") == 1
    card = re.search(r"card ([\d ]+)", out)[1]
    assert pii.luhn(card.replace(" ", "")) and [len(x) for x in card.split()] == [4, 4, 4, 4]
    iban = re.search(r"iban ([A-Z0-9 ]+),", out)[1].replace(" ", "")
    assert pii.iban_remainder(iban) == 1
    assert pii.pseudonymise(out, key, undo=True)[0] == text
    assert pii.pseudonymise(text + text, key)[0] == out + out
    assert pii.pseudonymise("", key) == ("", 0)


def whole_text(text, key, undo=False):
    """The values of a text found by trying the pattern everywhere."""
    step, out, at = pii.unpermute if undo else pii.permute, "", 0
    while m := pii.PATTERN.search(text, at):
        new = pii.FORMATS[m.lastgroup](m[0], lambda label, value, size: step(key, label, value, size))
        stop = m.start() + len(new) if new else pii.after_failed(m)
        out, at = out + text[at : m.start()] + (new or text[m.start() : stop]), stop
    return out + text[at:]


def an_iban(rng, country, blanks):
    body = "".join(rng.choice("0123456789" if rng.random() < 0.7 else string.ascii_uppercase) for _ in range(pii.IBAN_LENGTHS[country] - 4))
    bare = country + f"{98 - pii.iban_remainder(country + '00' + body):02d}" + body
    return " ".join(bare[k : k + 4] for k in range(0, len(bare), 4)) if blanks else bare


def test_values_are_found_as_by_trying_everywhere():
    rng = random.Random(8)
    parts = ["4111 1111 1111 1111", "1/2/2024", "2024-02-01", "12.3.4.5", "1700000000000", "Jo.Doe@mail.example.com", "+1 (017) 555-7713", "123-45-6789", "USD", "NOW", "a", "12", "(", "@", ".", "-", "é1", "x_9", "555-1234-999"]
    for _ in range(400):
        some = [an_iban(rng, rng.choice(list(pii.IBAN_LENGTHS)), rng.random() < 0.5) if rng.random() < 0.3 else rng.choice(parts) for _ in range(rng.randint(1, 9))]
        text = "".join(x + rng.choice([" ", "  ", "\n", ", ", ""]) for x in some)
        got = pii.pseudonymise(text, b"k")[0]
        assert got == whole_text(text, b"k") and len(got) == len(text), text


def test_ibans_of_all_countries_are_replaced_also_between_words():
    rng = random.Random(4)
    for country in pii.IBAN_LENGTHS:
        for blanks in (False, True):
            value = an_iban(rng, country, blanks)
            out, n = pii.pseudonymise(f"PAY {value} NOW OR", b"k")
            assert n == 1 and value not in out and pii.pseudonymise(out, b"k", undo=True)[0] == f"PAY {value} NOW OR", value
            assert pii.pseudonymise(f"to {value.replace(' ', '')}.", b"k")[0][3:-1] == out[4:-7].replace(" ", "")
    assert pii.pseudonymise("SC18 SSCB 1101 0000 0000 0000 1497 USD", b"k")[1] == 1 == pii.pseudonymise("MU17 BOMM 0101 1010 3030 0200 000M UR", b"k")[1]


def test_equal_values_are_linked_in_all_notations_and_keep_their_length():
    of = lambda text: pii.pseudonymise(text, b"k")[0]
    seen = set()
    for day in ("2024-02-01", "1999-12-31", "2000-10-10", "1950-06-13", "2024-02-29"):
        y, m, d = of(day).split("-")
        assert of(f"{day[8:]}/{day[5:7]}/{day[:4]}") == f"{d}/{m}/{y}" and of(f"{day[8:]}.{day[5:7]}.{day[:4]}") == f"{d}.{m}.{y}"
        short = f"{int(day[8:])}/{int(day[5:7])}/{day[:4]}"
        assert of(short) == f"{int(d)}/{int(m)}/{y}" and len(of(short)) == len(short)
        if int(day[8:]) > 12:
            assert of(f"{day[5:7]}/{day[8:]}/{day[:4]}") == f"{m}/{d}/{y}"
        assert pii.pseudonymise(of(day), b"k", undo=True)[0] == day
        seen.add(of(day))
    assert len(seen) == 5
    assert of("Jo@x.com").lower() == of("jo@x.com") == of("JO@x.com").lower() != "jo@x.com"
    for stays in ("1700000000000", "4111 1111 1111 1112", "2023-02-29", "12/31/1899", "GB82 WEST 1234 5698 7654 33"):
        assert of(stays) == stays
    assert of("4111 1111 1111 1111 411").endswith(" 411") and of("4111-1111-1111-1111").replace("-", "") == of("4111111111111111")


def test_ppm_costs_are_those_of_the_definition():
    texts = {0: ["abracadabra", "banana"], 1: ["xyzzy abra"]}
    counts = {}
    for k in range(langid.ORDER + 1):
        for i, own in texts.items():
            seen = {}
            for t in own:
                data = b"\n" * langid.ORDER + t.encode()
                for p in range(langid.ORDER, len(data)):
                    gram = int.from_bytes(data[p - k : p + 1], "big")
                    seen[gram] = seen.get(gram, 0) + 1
            codes = np.array(sorted(seen), np.uint64)
            counts[k, i] = (codes, np.array([seen[int(c)] for c in codes]))
    model = langid.PpmModel(["a", "b"], [langid.fit_tree([counts[k, i] for k in range(langid.ORDER + 1)]) for i in texts])

    def cost(i, window):
        total = 0.0
        for k in range(langid.ORDER, -1, -1):
            context, gram = window >> 8 & (1 << 8 * k) - 1, window & (1 << 8 * (k + 1)) - 1
            codes, n = counts[k, i]
            here = [(int(c), int(m)) for c, m in zip(codes, n, strict=True) if int(c) >> 8 == context]
            if here:
                all_, kinds = sum(m for _, m in here), len(here)
                hit = dict(here).get(gram)
                if hit:
                    return total - np.log2(hit / (all_ + kinds))
                total -= np.log2(kinds / (all_ + kinds))
        return total + 8

    for t in ("abra", "xbanan", "qq", "zzy abz"):
        data, real, _ = langid.padded(pa.array([t]))
        code = langid.windows(data, 0, len(data))
        want = np.array([[cost(i, int(c)) for i in (0, 1)] for c in code[real]])
        assert np.allclose(model.costs(code[real]).T, want, atol=1e-4)


def test_templates_and_slots():
    assert decontam.kind_of("12,5")[1] == decontam.NUMBER and decontam.kind_of("30km")[1] == decontam.NUMBER
    assert decontam.kind_of("Kilometers")[1] == 0 and decontam.kind_of("km.")[1:] == (decontam.UNIT, False, True)
    value, kind, doc = decontam.Templates().of(pa.array(["The Alice saw 3 km. Then ...", ""]))
    assert kind.tolist() == [decontam.OPEN, decontam.NAME, 0, decontam.NUMBER, decontam.UNIT, decontam.OPEN] and set(doc) == {0}


def test_rtree_bounds_never_lose_a_link():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (30, 200, 900)]
    sets = []
    for s in base:
        for _ in range(40):
            keep = rng.random(len(s)) > rng.random() * 0.15
            sets.append(np.unique(np.r_[s[keep], rng.integers(0, 2**63, int(rng.integers(0, 6)), dtype=np.uint64)]))
    resident = np.array([True] * 60 + [False] * 60)
    order = rng.permutation(len(sets))
    sets = [sets[k] for k in order]
    found = {(q, int(o)) for q, others in ngram_join.leaf_candidates([ngram_join.group_counts(s) for s in sets], resident, True, 85) for o in others}
    for q in range(len(sets)):
        for o in range(q if resident[q] else 60):
            common = len(np.intersect1d(sets[q], sets[o]))
            if 185 * common >= 85 * (len(sets[q]) + len(sets[o])):
                assert (q, o) in found


def test_warc_record_round_trip():
    r = warc.parse(warc.record(7, "http://x/ y", "é".encode(), None, False, "d"))
    assert (r["page_id"], r["payload_bytes"], r["record_type"], r["payload"]) == (7, 2, "response", "é".encode())
    v = warc.parse(warc.record(None, None, b"", 9, True, "d"))
    assert (v["page_id"], v["refers_to"], v["record_type"], v["payload_bytes"]) == (None, 9, "revisit", 0)
    assert warc.sha1_base32(b"") == "3I42H3S6NNFQ2MSVX7XZKYAYSCX5QBYJ"


def brute_statistics(text):
    """The statistics one text at a time, from their definitions."""
    data = text.encode()
    ws = re.findall(rb"[^\x20\x09-\x0D]+", data)
    lines = [x for x in data.split(b"\n") if x]
    share = lambda hits, of: hits / max(1, of)
    among = lambda chars: sum(c in chars for c in data)
    upper, high = bytes(range(65, 91)), bytes(range(128, 256))
    letters = upper + bytes(range(97, 123)) + high
    shouted = lambda w: sum(c in upper for c in w) >= 2 and sum(c in upper for c in w) == sum(c in letters for c in w)
    symbols = b"#$%&*!@^~=+<>\\_{}[]"
    return {
        "log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(ws)), "word_bytes": share(sum(map(len, ws)), len(ws)), "upper_share": share(among(upper), among(letters)),
        "digit_share": share(among(b"0123456789"), len(data)), "symbol_share": share(among(symbols), len(data)), "stop_share": share(among(b".,;:?"), len(data)), "high_share": share(among(high), len(data)),
        "space_share": share(among(b" \t\n\x0b\x0c\r"), len(data)), "line_bytes": share(len(data), len(lines)), "log_lines": np.log1p(len(lines)), "same_line_share": 1 - share(len(set(lines)), len(lines)),
        "distinct_share": share(len(set(ws)), len(ws)), "decorated_share": share(sum(w[-1] in symbols for w in ws), len(ws)), "upper_word_share": share(sum(map(shouted, ws)), len(ws)),
        "short_word_share": share(sum(len(w) <= 3 for w in ws), len(ws)), "bar_share": share(data.count(b"|"), len(ws)),
    }


def test_statistics_equal_those_of_one_text_at_a_time():
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choices("abcABC 012 .,#|$!\n\té日", k=rng.randint(0, 300))) for _ in range(120)] + ["same\nsame\n\nother"]
    rows = quality._step(pa.array(texts))
    for text, row in zip(texts, rows, strict=True):
        want = brute_statistics(text)
        assert np.allclose(row, [want[k] for k in quality.STATISTICS]), text


def test_statistics_of_odd_texts_are_finite():
    rows = quality._step(pa.array(ODD))
    assert rows.shape == (len(ODD), len(quality.STATISTICS)) and np.isfinite(rows).all()


def test_rules_are_read_from_printed_trees():
    text = "RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 3 <= 0.5)\n     If (feature 1 <= 2.0)\n      Predict: 1.0\n     Else (feature 1 > 2.0)\n      Predict: 0.0\n    Else (feature 3 > 0.5)\n     Predict: 0.0\n"
    a, b = quality.STATISTICS[3], quality.STATISTICS[1]
    assert set(quality.paths(text)) == {((a, "<=", 0.5),), tuple(sorted([(a, "<=", 0.5), (b, "<=", 2.0)])), tuple(sorted([(a, "<=", 0.5), (b, ">", 2.0)])), ((a, ">", 0.5),)}


