"""Benchmark decontamination by template canonicalisation.

Words become a template: numbers, also those in words, names, also of several words,
and units turn into typed placeholders, one for each number and name; all others are
lower-cased and stripped of punctuation. Windows of the templates of benchmark items
and of documents are hash-joined, so a question that was only given other numbers or
names still meets its source. As capitals may be changed too, every text is also read
with its names as ordinary words, and a capitalised word that opens a sentence as a
name and as none. A matched pair is then checked for slot consistency: going through
the aligned placeholders, one value of the item must always stand for one value of the
document; for names and units the other way round too, while two numbers of the item
may have become one.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm._arrow import mix, steps, text_bytes, word_codes, word_hashes, words
from recengine.llm._bitmap import Bitmap
from recengine.llm._scratch import materialize

#: Words of a window; of these at least LITERALS aren't placeholders.
WINDOW, LITERALS = 8, 4
#: Bits of the filter over the benchmark's window hashes that tasks receive (a fixed 1 MB).
FILTER_BITS = 23
#: Bounds of the words that a task remembers and of their bytes; then it starts afresh.
REMEMBERED, REMEMBERED_BYTES = 100_000, 8 << 20

# Names of units after which, or on which, a number is a quantity.
UNITS = frozenset(
    "km m cm mm mi mile miles ft foot feet inch inches yard yards kg g mg lb lbs oz ton tons l ml litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "dollar dollars euro euros usd eur cent cents percent mph kmh degrees celsius fahrenheit w kw j kj v hz khz mhz ghz kb mb gb tb".split()
)
_NUMBER = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:st|nd|rd|th|%)?$")
_NUMBER_UNIT = re.compile(r"[$€£]?[+-]?\d[\d.,]*([a-z]+)$")
_STRIP = "!\"#%&'()*,.:;<=>?@[\\]^_`{|}~«»“”‘’¿¡…-/"
_STOPS = (".", "!", "?", ":", ";", "…")
# Fixed tokens that stand for the placeholders in a hash.
NUMBER, NAME, UNIT = 1, 2, 3
#: A capitalised word that opens a sentence or the text: a name or a literal, so both readings are hashed.
OPEN = 4
#: A number in words, and a name that begins with an opening word; both after runs of words were made one token.
NUMERAL, OPENED = 5, 6
# The numbers that words stand for.
NUMERALS = dict(
    zero=0, one=1, two=2, three=3, four=4, five=5, six=6, seven=7, eight=8, nine=9, ten=10, eleven=11, twelve=12, thirteen=13, fourteen=14, fifteen=15, sixteen=16, seventeen=17, eighteen=18, nineteen=19,
    twenty=20, thirty=30, forty=40, fifty=50, sixty=60, seventy=70, eighty=80, ninety=90, hundred=100, thousand=1000, million=10**6, billion=10**9,
)
_POWER = 0x9E3779B97F4A7C15

_FACTORS = mix(np.arange(101, 101 + 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def kind_of(word: str) -> tuple[str, int, bool, bool]:
    """(canonical word, placeholder or 0, whether it is capitalised, whether it ends a sentence)."""
    bare, ends = word, False
    if not (word[-1:].isalnum() and word[:1].isalnum()):  # most words are bare
        bare = word.strip(_STRIP)
        ends = word.rstrip("\"'”’)]*#$%&!").endswith(_STOPS) or word.endswith(("!", "?"))
    low = bare.lower()
    if (bare[:1] in "$€£+-" or bare[:1].isdigit()) and (_NUMBER.match(bare) or ((m := _NUMBER_UNIT.match(low)) and m[1] in UNITS)):
        return low, NUMBER, False, ends
    if low in UNITS:
        return low, UNIT, False, ends
    if low in NUMERALS or ("-" in low and all(x in NUMERALS for x in low.split("-"))):
        return low, NUMERAL, False, ends
    return low, 0, bare[:1].isupper() and len(bare) > 1 and not bare.isupper(), ends


def number_of(words: str) -> int:
    """The number that words, with blanks or hyphens between them, stand for."""
    total = now = 0
    for x in map(NUMERALS.__getitem__, re.split("[ -]", words)):
        if x < 100:
            now += x
        elif x == 100:
            now = max(now, 1) * 100
        else:
            total, now = total + max(now, 1) * x, 0
    return total + now


def _hashes(texts: list[str]) -> np.ndarray:
    """Hashes of texts by their bytes; 0 for empty ones."""
    raw = [t.encode() for t in texts]
    offs = np.r_[0, np.cumsum([len(t) for t in raw])].astype(np.int64)
    out, there = np.zeros(len(raw), np.uint64), np.flatnonzero(np.diff(offs))
    out[there] = word_hashes(np.frombuffer(b"".join(raw), np.uint8), offs[:-1][there], offs[1:][there])
    return out


def _hash_of(text: str) -> np.uint64:
    return _hashes([text])[0]


_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_SPECIAL = [(np.sort(_hashes(sorted(UNITS))), UNIT), (np.sort(_hashes(sorted(NUMERALS))), NUMERAL)]


class Templates:
    """Canonicalises texts by way of their distinct words."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, int, bool, bool, bool]] = {}
        self.bytes = 0

    def of(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per word: hash of its canonical form, placeholder (0: literal), and index of its text; bare punctuation is left out."""
        return self.words(column)[:3]

    def words(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Callable[[int], str]]:
        """The same, whether the word may go on in the next one (no punctuation between), and the canonical form of a word by its number.

        Words of small letters alone, which most are, are their own canonical form and are only hashed.
        """
        data, offs = text_bytes(column)
        start, end, doc = words(data, offs)
        n = len(start)
        odd = np.r_[0, np.cumsum(~_SMALL[data], dtype=np.int64)]
        plain = odd[end] == odd[start]
        value, kind = np.zeros(n, np.uint64), np.zeros(n, np.int8)
        upper, ends, goes_on = np.zeros(n, bool), np.zeros(n, bool), np.ones(n, bool)
        at = np.flatnonzero(plain)
        value[at] = word_hashes(data, start[at], end[at])
        for special, own in _SPECIAL:
            place = np.minimum(np.searchsorted(special, value[at]), len(special) - 1)
            kind[at[special[place] == value[at]]] = own
        for number in np.flatnonzero(kind == NUMERAL):
            value[number] = _hash_of(str(NUMERALS[data[start[number] : end[number]].tobytes().decode()]))
        at = np.flatnonzero(~plain)
        codes, distinct = word_codes(data, start[at], end[at])
        if len(self.known) > REMEMBERED or self.bytes > REMEMBERED_BYTES:
            self.known.clear()
            self.bytes = 0
        new = [w for w in distinct if w not in self.known]
        kinds = [kind_of(w.decode(errors="replace")) for w in new]
        hashed = _hashes([str(number_of(x[0])) if x[1] == NUMERAL else x[0] for x in kinds])
        for w, h, (_, own, capital, stops) in zip(new, hashed.tolist(), kinds, strict=True):
            self.known[w] = h, own, capital, stops, w.decode(errors="replace")[-1] not in _STRIP
            self.bytes += len(w)
        if distinct:
            columns = zip(*[self.known[w] for w in distinct], strict=True)
            value[at], kind[at], upper[at], ends[at], goes_on[at] = (np.array(x, t)[codes] for x, t in zip(columns, (np.uint64, np.int8, bool, bool, bool), strict=True))
        # a capitalised word is a name; where a sentence or the text begins with it, it may be one
        opens = np.ones(n, bool)
        opens[1:] = ends[:-1] | (doc[1:] != doc[:-1])
        kind = np.where(upper, np.where(opens, OPEN, NAME), kind).astype(np.int8)
        there = value != 0
        first, last = start[there], end[there]
        form = lambda k: kind_of(data[first[k] : last[k]].tobytes().decode(errors="replace"))[0]
        return value[there], kind[there], doc[there], goes_on[there] & np.r_[there[1:], False][there], form


class Reading:
    """A text's words as tokens: value, kind, text, and the word at which each begins."""

    def __init__(self, value: np.ndarray, kind: np.ndarray, doc: np.ndarray, at: np.ndarray, marked: np.ndarray):
        self.value, self.kind, self.doc, self.at = value, kind, doc, at
        self.marked = marked  # tokens that other readings have otherwise: only windows with one are new

    def tokens(self, names: bool) -> np.ndarray:
        """What is hashed of each token; opening words are read as names or as literals."""
        read = np.where(self.kind == OPEN, NAME if names else 0, np.where(self.kind == OPENED, NAME, self.kind))
        return np.where(read > 0, read.astype(np.uint64), self.value)


def readings(templates: Templates, column: pa.Array) -> list[Reading]:
    """Three readings of the texts: names as slots; the same with names that begin with an opening word; names as ordinary words."""
    value, kind, doc, goes_on, form = templates.words(column)
    n = len(value)
    joins = goes_on[:-1] & (doc[1:] == doc[:-1]) if n else np.zeros(0, bool)  # with the next word
    numerals = joins & (kind[:-1] == NUMERAL) & (kind[1:] == NUMERAL)
    named = joins & (kind[:-1] == NAME) & (kind[1:] == NAME)
    opened = joins & (kind[:-1] == OPEN) & (kind[1:] == NAME)

    def merged(with_next: np.ndarray, kind: np.ndarray, marked: np.ndarray) -> Reading:
        """Runs of words that go with the next one as one token, of the kind of the first."""
        first = np.flatnonzero(np.r_[True, ~with_next]) if n else np.zeros(0, np.int64)
        size = np.diff(np.r_[first, n])
        out, own = value[first], kind[first]
        for k in np.flatnonzero(size > 1):
            a, b = first[k], first[k] + size[k]
            text = " ".join(form(c) for c in range(a, b))
            out[k] = _hash_of(str(number_of(text)) if own[k] == NUMERAL else text)
        own = np.where(own == NUMERAL, NUMBER, own)
        return Reading(out, own.astype(np.int8), doc[first], first, np.logical_or.reduceat(marked, first) if n else marked)

    single = np.where(np.r_[opened, False] if n else opened, 0, kind)  # before a name, an opening word is a literal
    whole = np.where(np.r_[opened, False] if n else opened, OPENED, kind)
    plain = np.where((kind == NAME) | (kind == OPEN), 0, kind)
    everywhere = np.ones(n, bool)
    return [merged(numerals | named, single, everywhere), merged(numerals | named | opened, whole, whole == OPENED), merged(numerals, plain, (kind == NAME) | (kind == OPEN))]


def windows(token: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums over the windows of WINDOW tokens, not yet mixed, and which of them stay in one text."""
    n = max(0, len(token) - WINDOW + 1)
    total, mixed = np.zeros(n, np.uint64), mix(token)
    for k in range(WINDOW):
        total += mixed[k : k + n] * _FACTORS[k]
    return total, doc[:n] == doc[WINDOW - 1 :] if n else np.zeros(0, bool)


def wholes(token: np.ndarray, at: np.ndarray, whole: int) -> np.ndarray:
    """Hashes of the runs of abs(whole) tokens from these places on; the sign tells values from templates."""
    mixed, total = mix(token), np.zeros(len(at), np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        for k in range(abs(whole)):
            total += mixed[at + k] * power
            power *= np.uint64(_POWER)
        return mix(total + mix(np.array([whole], np.int64).view(np.uint64)))


def _item_windows(texts: list[Reading], rows: int) -> Iterator[tuple[int, int, int, int, int, Reading, int, int]]:
    """hash, first token, whole, mask of the opening words read as names, positions of its text, reading, place and value of the anchor of a whole; for benchmark items."""
    places: list[set[int]] = [set() for _ in range(rows)]  # words at which windows begin
    found = []
    for r in texts:
        total, inside = windows(r.tokens(False), r.doc)
        literal = np.r_[0, np.cumsum((r.kind == 0) | (r.kind == OPEN))]
        fit = inside & (literal[WINDOW:] - literal[:-WINDOW] >= LITERALS) if len(total) else inside
        if len(total):
            marks = np.r_[0, np.cumsum(r.marked)]
            fit &= marks[WINDOW:] > marks[:-WINDOW]
        delta = mix(np.array([NAME], np.uint64)) - mix(r.value)
        for a in np.flatnonzero(fit):
            places[r.doc[a]].add(int(r.at[a]))
            masks = [(0, total[a])]
            for k in np.flatnonzero(r.kind[a : a + WINDOW] == OPEN):
                with np.errstate(over="ignore"):
                    masks += [(m | 1 << int(k), t + delta[a + k] * _FACTORS[k]) for m, t in masks]
            found += [(int(mix(np.array([t], np.uint64))[0]), int(a), 0, m, r) for m, t in masks]
    for h, a, whole, m, r in found:
        yield h, a, whole, m, len(places[r.doc[a]]), r, 0, 0
    for r in texts:  # a text without windows: one of all its tokens; with few literals only the same values match
        for text in np.unique(r.doc):
            lo, hi = np.searchsorted(r.doc, [text, text + 1])
            if places[text] or not r.marked[lo:hi].any():
                continue
            kind = r.kind[lo:hi]
            few = ((kind == 0) | (kind == OPEN)).sum() < LITERALS
            for names in (False, True) if not few and (kind == OPEN).any() else (False,):
                whole = int(lo - hi if few else hi - lo)
                own = r.value[lo:hi] if few else r.tokens(names)[lo:hi]
                anchor = 0 if few else int(np.flatnonzero((kind == 0) | ((kind == OPEN) & (not names)))[0]) if ((kind == 0) | ((kind == OPEN) & (not names))).any() else -1
                yield int(wholes(own, np.zeros(1, np.int64), whole)[0]), int(lo), whole, -1 if names else 0, 1, r, anchor, int(r.value[lo + max(anchor, 0)])


def _document_windows(texts: list[Reading], wanted: np.ndarray, anchors: np.ndarray, wholes_at: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, np.ndarray, int, int, Reading]]:
    """hashes, first tokens, whole, mask of the windows that the filter may hold: opening words all literals, then all names."""

    def held(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        bit = hashes >> np.uint64(64 - FILTER_BITS)
        return (bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1

    for r in texts:
        opening, marks = np.r_[0, np.cumsum(r.kind == OPEN)], np.r_[0, np.cumsum(r.marked)]
        last = np.searchsorted(r.doc, r.doc, side="right")  # the end of each token's text
        # places of the literals with which short items may begin: few
        near = np.flatnonzero(held(anchors, mix(r.value))) if wholes_at else np.zeros(0, np.int64)
        for names in (False, True):
            token, mask = r.tokens(names), -1 if names else 0
            total, inside = windows(token, r.doc)
            if len(total):
                inside = inside & (marks[WINDOW:] > marks[:-WINDOW])
                if names:
                    inside &= opening[WINDOW:] > opening[:-WINDOW]
            at = np.flatnonzero(inside)
            hashes = mix(total[at])
            hit = held(wanted, hashes)
            yield hashes[hit], at[hit], 0, mask, r
            for whole, anchor in wholes_at:
                if whole < 0 and names:
                    continue
                size = abs(whole)
                at = near - anchor if anchor >= 0 else np.arange(len(token))
                at = at[(at >= 0) & (at + size <= len(token))]
                at = at[(at + size <= last[at]) & (marks[at + size] > marks[at]) & ((opening[at + size] > opening[at]) | (not names))]
                hashes = wholes(r.value if whole < 0 else token, at, whole)
                hit = held(wanted, hashes)
                yield hashes[hit], at[hit], whole, mask, r


def _kinds(kind: np.ndarray, whole: int, mask: int) -> str:
    """The reading of each token of a window; OPEN stands for an opening word read as a name, or a name that begins with one."""
    if whole < 0:
        return "0" * len(kind)
    return "".join(str(OPEN) if k == OPENED else "0" if k == OPEN and not mask >> i & 1 else str(k) for i, k in enumerate(kind.tolist()))


_FIELDS = [T.StructField("window", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("values", T.ArrayType(T.LongType())), T.StructField("kinds", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("whole", T.IntegerType()), T.StructField("tok", T.IntegerType()), T.StructField("anchor", T.IntegerType()), T.StructField("anchor_value", T.LongType())]


def _window_rows(rows: DataFrame, near=None, wholes_at: list[tuple[int, int]] = ()) -> DataFrame:
    """The windows of the texts of ``rows`` (key columns, then text): of documents those near ``near``, else of items.

    Key columns, window, at (word of the text), values and kinds of its tokens, n
    (positions of an item's windows, 0 for documents), whole (tokens of a whole item,
    below 0 if only values match), tok (token of the reading), and of a whole item the
    place and value of the literal by which it is looked for.
    """
    keys = rows.columns[:-1]
    names = [*keys, *(f.name for f in _FIELDS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        wanted, anchors = (np.frombuffer(x, np.uint8) for x in near.value) if near is not None else (None, None)
        for batch in batches:
            for part in steps(batch):
                texts = readings(templates, part.column(len(keys)))
                if wanted is None:
                    found = list(_item_windows(texts, part.num_rows))
                else:
                    found = [(int(h), int(a), whole, mask, 0, r, 0, 0) for hashes, at, whole, mask, r in _document_windows(texts, wanted, anchors, wholes_at) for h, a in zip(hashes, at, strict=True)]
                first: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # of each text, by reading: its first token, its first word
                for r in texts:
                    begin = np.searchsorted(r.doc, np.arange(part.num_rows))
                    first[id(r)] = begin, r.at[np.minimum(begin, max(0, len(r.at) - 1))] if len(r.at) else begin
                ends = [x[1] + (abs(x[2]) or WINDOW) for x in found]
                text = np.array([x[5].doc[x[1]] for x in found], np.int64)
                word = [int(x[5].at[x[1]] - first[id(x[5])][1][t]) for x, t in zip(found, text, strict=True)]
                tok = [int(x[1] - first[id(x[5])][0][t]) for x, t in zip(found, text, strict=True)]
                own = [
                    np.array([x[0] for x in found], np.uint64).view(np.int64), word, [x[5].value[x[1] : e].view(np.int64) for x, e in zip(found, ends, strict=True)],
                    [_kinds(x[5].kind[x[1] : e], x[2], x[3]) for x, e in zip(found, ends, strict=True)], *([x[k] for x in found] for k in (4, 2)), tok, [x[6] for x in found], np.array([x[7] for x in found], np.uint64).view(np.int64),
                ]
                types = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                of = pa.array(text)
                yield pa.RecordBatch.from_arrays([*(part.column(k).take(of) for k in range(len(keys))), *(pa.array(x, t) for x, t in zip(own, types, strict=True))], names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[:-1], *_FIELDS]))


def _filter_of(hashes: DataFrame) -> bytes:
    """A bitmap of the first FILTER_BITS bits of hashes (window), folded together in Spark; its size is fixed."""
    word = F.shiftrightunsigned("window", 64 - FILTER_BITS + 6)
    bit = F.shiftrightunsigned("window", 64 - FILTER_BITS).bitwiseAND(F.lit(63)).cast("int")
    folded = hashes.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    out = np.zeros(1 << FILTER_BITS - 6, np.int64)
    found = folded.toArrow()
    out[found["word"].to_numpy()] = found["bits"].to_numpy()
    return out.tobytes()


def _mixed(values: DataFrame) -> DataFrame:
    """window: the mixed values of a column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(batch.column(0).to_numpy().view(np.uint64)).view(np.int64))], ["window"])

    return values.mapInArrow(run, "window long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    # texts tell rows with null or repeated ids apart
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def _leaks(docs: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, min_share: float) -> DataFrame:
    items = benchmark.select(F.col(item_col).alias("item"), F.xxhash64(F.col(item_text_col)).alias("item_key"), F.col(item_text_col).alias("text"))
    item_windows = materialize(_window_rows(items.distinct()), "item-windows")
    short = item_windows.where("whole <> 0")
    wholes_at = sorted((r["whole"], r["anchor"]) for r in short.select("whole", "anchor").distinct().collect())  # distinct lengths of short items
    near = docs.sparkSession.sparkContext.broadcast((_filter_of(item_windows), _filter_of(_mixed(short.select("anchor_value"))) if wholes_at else bytes(8)))
    doc_windows = _window_rows(_keyed(docs, id_col, text_col), near, wholes_at).withColumnRenamed("kinds", "doc_kinds").drop("n", "whole", "anchor", "anchor_value")
    doc_windows = materialize(doc_windows, "document-windows")
    near.destroy()

    # a pair shares at least min_share of the item's windows, so it shares one of the rarest 1 - min_share of them and one more
    held = item_windows.groupBy("window").agg(F.count(F.lit(1)).alias("items"))
    rarity = Window.partitionBy("item", "item_key").orderBy("items", "at")
    places = item_windows.join(held, "window").groupBy("item", "item_key", "at", "n").agg(F.sum("items").alias("items"))  # all readings of one place
    places = places.withColumn("place", F.row_number().over(rarity)).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * F.lit(min_share)) + 1)
    of_place = [item_windows[c].eqNullSafe(places[c]) for c in ("item", "item_key", "at")]
    rare = item_windows.join(places, of_place, "left_semi").select("window", "item", "item_key")
    chosen = doc_windows.join(rare, "window").select(*(F.col(c).alias(f"c_{c}") for c in ("id", "key", "item", "item_key"))).distinct()
    chosen = materialize(chosen, "chosen-pairs")  # first, so that a window that all items share meets only their documents
    source = item_windows.select("window", "item", "item_key", F.col("at").alias("item_at"), F.col("tok").alias("item_tok"), F.col("values").alias("item_values"), "kinds", "n")
    both = lambda own: F.lit(True) & F.col(own[0]).eqNullSafe(F.col(f"c_{own[0]}")) & F.col(own[1]).eqNullSafe(F.col(f"c_{own[1]}"))
    pairs = doc_windows.join(chosen, both(("id", "key"))).drop("c_id", "c_key")
    pairs = pairs.join(source.withColumnRenamed("window", "item_window"), both(("item", "item_key")) & (F.col("window") == F.col("item_window"))).drop("c_item", "c_item_key")

    # one copy of the item is what lies at one distance; its slots are the aligned placeholders
    # a changed opening word is a slot too, but only windows that have one fail where it is not consistent
    kind, doc_kind = (lambda k, c=c: F.substring(c, k + 1, F.lit(1)) for c in ("kinds", "doc_kinds"))
    slot = lambda k: F.when(kind(k) != "0", F.struct(F.get("item_values", k).alias("a"), F.get("values", k).alias("b"), (kind(k) == str(NUMBER)).alias("number"), ((kind(k) == str(OPEN)) | (doc_kind(k) == str(OPEN))).alias("open")))
    pairs = pairs.withColumn("all", F.filter(F.transform(F.sequence(F.lit(0), F.length("kinds") - 1), slot), lambda x: x.isNotNull() & ~(x["open"] & (x["a"] == x["b"]))))
    pairs = pairs.withColumn("changed", F.exists("all", lambda x: x["open"])).withColumn("slots", F.transform("all", lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["number"].alias("number"))))
    flat = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    copies = pairs.groupBy("id", "key", "item", "item_key", (F.col("tok") - F.col("item_tok")).alias("shift")).agg(
        F.collect_set(F.when(~F.col("changed"), F.col("item_at"))).alias("found"), flat(F.when(~F.col("changed"), F.col("slots"))).alias("slots"), flat("slots").alias("every"),
        F.collect_set(F.when(F.col("changed"), F.struct("item_at", "slots"))).alias("more"), F.max("n").alias("n"),
    )
    firsts = lambda c: F.size(F.array_distinct(F.transform(c, lambda x: x["a"])))
    named = F.filter("slots", lambda x: ~x["number"])
    one_to_one = (F.size("slots") == firsts("slots")) & (F.size(named) == F.size(F.array_distinct(F.transform(named, lambda x: x["b"]))))
    clash = F.filter("every", lambda p: F.exists("every", lambda q: ((q["a"] == p["a"]) & (q["b"] != p["b"])) | ((q["a"] != p["a"]) & (q["b"] == p["b"]) & ~(p["number"] & q["number"]))))
    copies = copies.where(one_to_one).withColumn("clash", clash).withColumn("more", F.filter("more", lambda x: ~F.arrays_overlap(x["slots"], F.col("clash"))))
    copies = copies.withColumn("found", F.array_union("found", F.transform("more", lambda x: x["item_at"]))).withColumn("slots", F.array_union("slots", F.flatten(F.transform("more", lambda x: x["slots"]))))
    whole = copies.groupBy("id", "key", "item", "item_key").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("found")))).alias("windows"),
        F.max("n").alias("n"),
        F.sum(F.size(F.filter("slots", lambda x: x["a"] != x["b"]))).alias("changed_slots"),
    )
    return whole.where(F.col("windows") >= F.col("n") * F.lit(min_share))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """Pairs of document and benchmark item that match: id_col, item_col, windows, share, changed_slots.

    A pair matches if at least ``min_share`` of the item's windows occur in copies
    whose slots are consistent: over the aligned placeholders of a copy an item's
    value stands for one value of the document, and but for numbers the other way round.
    ``changed_slots`` counts the values that differ, 0 for a verbatim copy. A name is a
    run of capitalised words, a number also one in words, and each is one slot, whatever
    its length. A capitalised word that opens a sentence is read both as a name and as a
    literal, and all texts also with names as literals, so capitals don't matter to copies.
    An item whose windows all have under LITERALS literals, or that is shorter than a
    window, has one window of all its words; with under LITERALS literals in all, only
    its own values match it, in any text that holds them. Null texts and texts
    without words match nothing. Rows that repeat an id and a text count once, and ids
    of documents and items may be null; items that repeat an id with another text are
    matched by themselves. Texts are read whole, however long; an empty table of
    either kind gives no rows.
    """
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, min_share)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_col), F.col("windows").cast("long").alias("windows"), (F.col("windows") / F.col("n")).alias("share"), F.col("changed_slots").cast("long").alias("changed_slots"))


def remove_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", min_share: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all their columns, that match no item of the benchmark.

    Rows are told apart by id and text; rows without a match keep their place, null
    and empty texts among them. Only texts whose key may be a leak's are shuffled.
    """
    found = _leaks(docs, benchmark, id_col, text_col, item_col, item_text_col, min_share).select(F.col("id").alias("_leak_id"), F.col("key").alias("_leak_key")).distinct()
    found = materialize(found, "leaks")
    key = F.xxhash64(F.col(text_col))
    marked = Bitmap(found, "_leak_key", "leak-bitmap").mark(docs, key, "_leak_near")
    left = marked.where("_leak_near").drop("_leak_near").join(found, F.col(id_col).eqNullSafe(F.col("_leak_id")) & (key == F.col("_leak_key")), "left_anti")
    return marked.where("not _leak_near").drop("_leak_near").unionByName(left)
