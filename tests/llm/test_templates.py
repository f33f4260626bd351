"""Decontamination against brute force over token lists, and its recall on re-parameterised questions."""

import itertools
import random
import re
from collections import defaultdict
from math import ceil

from recengine.llm import decontam as D


def brute_readings(text):
    """Three lists of (form, kind, word index, marked), word by word."""
    words = []
    before = True
    for raw in re.findall(r"[^\x20\x09-\x0D]+", text or ""):
        low, kind, upper, ends = D.kind_of(raw)
        kind = (D.OPEN if before else D.NAME) if upper else kind
        before = ends
        words.append((low, kind, raw[-1] not in D._STRIP))
    kept = [(low, kind, on and k + 1 < len(words) and words[k + 1][0] != "") for k, (low, kind, on) in enumerate(words) if low]
    out = []
    for reading in range(3):
        tokens = []
        for k, (low, kind, _) in enumerate(kept):
            joined = k > 0 and kept[k - 1][2]
            last = kept[k - 1][1] if k else None
            numerals = joined and last == kind == D.NUMERAL
            named = joined and kind == D.NAME and (last == D.NAME or (last == D.OPEN and reading == 1)) and reading < 2
            before_name = kind == D.OPEN and kept[k][2] and k + 1 < len(kept) and kept[k + 1][1] == D.NAME
            if numerals or named:
                tokens[-1][0].append(low)
                continue
            own, marked = kind, True
            if reading == 0:
                own = 0 if before_name else kind
            elif reading == 1:
                own, marked = (D.OPENED, True) if before_name else (kind, False)
            else:
                own = 0 if kind in (D.NAME, D.OPEN) else kind
                marked = kind in (D.NAME, D.OPEN)
            tokens.append([[low], own, k, marked])
        done = []
        for lows, kind, k, marked in tokens:
            form = str(D.number_of(" ".join(lows))) if kind == D.NUMERAL else " ".join(lows)
            done.append((form, D.NUMBER if kind == D.NUMERAL else kind, k, marked))
        out.append(done)
    return out


def as_read(tokens, mask):
    """What is compared of each token, and its kind: 0 literal, else a placeholder."""
    out = []
    for i, (form, kind, _, _) in enumerate(tokens):
        name = kind == D.OPENED or (kind == D.OPEN and mask >> i & 1)
        place = D.NAME if name else 0 if kind == D.OPEN else kind
        out.append((place or form, str(D.OPEN) if name else str(place)))
    return tuple(x for x, _ in out), [k for _, k in out]


def item_windows(text):
    """(size or 0, compared, kinds, values, word, token) of all windows, and the number of their places."""
    found = []
    for tokens in brute_readings(text):
        for a in range(len(tokens) - D.WINDOW + 1):
            own = tokens[a : a + D.WINDOW]
            if sum(t[1] in (0, D.OPEN) for t in own) >= D.LITERALS and any(t[3] for t in own):
                opens = [i for i, t in enumerate(own) if t[1] == D.OPEN]
                for some in itertools.product((0, 1), repeat=len(opens)):
                    compared, kinds = as_read(own, sum(b << i for b, i in zip(some, opens, strict=True)))
                    found.append((0, compared, kinds, [t[0] for t in own], own[0][2], a))
    n = len({f[4] for f in found})
    if not found:
        for tokens in brute_readings(text):
            if not tokens or not any(t[3] for t in tokens):
                continue
            few = sum(t[1] in (0, D.OPEN) for t in tokens) < D.LITERALS
            for names in (False, True) if not few and any(t[1] == D.OPEN for t in tokens) else (False,):
                compared, kinds = as_read(tokens, -1 if names else 0)
                if few:
                    compared, kinds = tuple(t[0] for t in tokens), ["0"] * len(tokens)
                found.append((-len(tokens) if few else len(tokens), compared, kinds, [t[0] for t in tokens], tokens[0][2], 0))
        n = 1
    return found, n


def brute_leak(text, item, min_share=0.5):
    windows, n = item_windows(item)
    if not windows:
        return None
    by = defaultdict(list)
    for w in windows:
        by[w[0], w[1]].append(w)
    pairs = []
    for tokens in brute_readings(text):
        for size in {w[0] for w in windows}:
            long = abs(size) or D.WINDOW
            for a in range(len(tokens) - long + 1):
                own = tokens[a : a + long]
                for names in (False, True):
                    if not any(t[3] for t in own) or (names and (size < 0 or not any(t[1] == D.OPEN for t in own))):
                        continue
                    compared, kinds = as_read(own, -1 if names else 0)
                    if size < 0:
                        compared, kinds = tuple(t[0] for t in own), ["0"] * long
                    for w in by.get((size, compared), ()):
                        pairs.append((a - w[5], w, [t[0] for t in own], kinds))
    # a pair of windows may be met by several readings: they say the same
    matched, changed_slots = set(), 0
    for shift in {p[0] for p in pairs}:
        found, slots, every, more = set(), set(), set(), []
        for s, w, values, kinds in pairs:
            if s == shift:
                all_of = {(a, b, k == str(D.NUMBER), k == str(D.OPEN) or d == str(D.OPEN)) for k, d, a, b in zip(w[2], kinds, w[3], values, strict=True) if k != "0"}
                all_of = {x for x in all_of if not (x[3] and x[0] == x[1])}
                own = {x[:3] for x in all_of}
                every |= own
                if any(x[3] for x in all_of):
                    more.append((w[4], own))
                else:
                    found.add(w[4])
                    slots |= own
        firsts, named = {a for a, _, _ in slots}, {(a, b) for a, b, number in slots if not number}
        if len(slots) != len(firsts) or len(named) != len({b for _, b in named}):
            continue
        clash = {p for p in every if any((q[0] == p[0] and q[1] != p[1]) or (q[0] != p[0] and q[1] == p[1] and not (p[2] and q[2])) for q in every)}
        for at, own in more:
            if not own & clash:
                found.add(at)
                slots |= own
        matched |= found
        changed_slots += sum(a != b for a, b, _ in slots)
    return (len(matched), changed_slots) if matched and len(matched) >= ceil(n * min_share - 1e-9) else None


PEOPLE = ["Tom", "Mary", "Alice", "Bob", "O'Brien", "McDonald", "Maria Lopez", "Juan Carlos Perez", "Anna", "Carol", "Jean Dupont", "Dan"]
STORIES = [
    "{a} has {x} apples and {y} pears. {a} gives {b} {z} apples. How many apples does {b} have now?",
    "{a} drives {x} km in {y} hours. Then {b} drives {z} km on the same road. Who was faster, {a} or {b}?",
    "Say that {a} buys {x} books for {y} dollars each and sells {z} of them to {b}, how much does {a} lose?",
    "If {a} paints {x} walls in {y} days and {b} paints {z} walls how long do both take together for one wall?",
    "What is {x} plus {y} minus {z} when {a} counts with {b}?",
    "{a} and {b} run {x} miles today",
    "What is the capital of France?",
]
WORDS = {2: "two", 3: "three", 5: "five", 7: "seven", 12: "twelve", 21: "twenty-one", 40: "forty", 105: "one hundred five"}


def question(rng, story):
    numbers = rng.sample(sorted(WORDS), 3)
    text = story.format(a=(names := rng.sample(PEOPLE, 2))[0], b=names[1], **{k: WORDS[v] if rng.random() < 0.4 else str(v) for k, v in zip("xyz", numbers, strict=True)})
    return rng.choice([text, text, text, text.lower(), text.upper()]) if "capital" in story or rng.random() < 0.2 else text


def test_leaks_equal_brute_force(spark):
    rng = random.Random(21)
    items = [(k, question(rng, s)) for k, s in enumerate(STORIES * 2)] + [(50, "1 2 3 4 5 6 7 8 9"), (51, ""), (52, None), (53, "Old Rome")]
    docs = []
    for k in range(160):
        parts = [question(rng, rng.choice(STORIES)), "so " * rng.randint(0, 4), rng.choice(["", "Some Old Rome.", "1 2 3 4 5 6 7 8 9 and", question(rng, rng.choice(STORIES))])]
        text = " ".join(parts)
        if rng.random() < 0.3:  # a word or a name changed in the middle
            words = text.split(" ")
            words[rng.randrange(len(words))] = rng.choice(["Erin", "odd", "9", "Then"])
            text = " ".join(words)
        docs.append((k, text))
    docs += [(900, None), (901, "")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): (r["windows"], r["changed_slots"]) for r in D.find_leaks(d, b).collect()}
    expected = {(i, j): leak for i, t in docs for j, q in items if (leak := brute_leak(t, q))}
    assert len(expected) > 100
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in expected.items()}
    assert got == expected


def test_recall_of_names_numbers_and_capitals(spark):
    """Other names, also of several words, number words and other capitals; clean texts stay."""
    rng = random.Random(5)
    items = [(k, s.format(a="Anna", b="Bob", x="5", y="7", z="2")) for k, s in enumerate(STORIES)]
    filler = lambda n: " ".join(rng.choices("some words that stand around a question in a text of no interest at all".split(), k=n))
    docs = [(100 * k + j, f"{filler(20)}. {question(rng, s)} {filler(9)}") for k, s in enumerate(STORIES) for j in range(20)]
    clean = [(10_000 + k, f"{filler(60)}. {' '.join(rng.choices(PEOPLE, k=3))} {filler(5)}") for k in range(60)]
    found = {(r["doc_id"] // 100, r["item_id"], r["doc_id"]) for r in D.find_leaks(spark.createDataFrame(docs + clean, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    right = {d for k, i, d in found if k == i}
    print(f"recall {len(right) / len(docs):.3f}")
    assert len(right) >= 0.9 * len(docs) and all(d < 10_000 for _, _, d in found), len(right) / len(docs)


def test_numbers_in_words():
    for text, number in (("five", 5), ("twenty-one", 21), ("one hundred five", 105), ("two thousand three hundred", 2300), ("hundred", 100), ("three million", 3_000_000)):
        assert D.number_of(text) == number
