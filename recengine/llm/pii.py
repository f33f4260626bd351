"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Values are found by pattern and validated (card check digits, IBAN length and
remainder, octets of an IP address, calendar dates of 1900 to 2099, phone numbers with
an assigned country code, in the North American plan or with a trunk zero); what fails
its validation stays as it is, and so do phone numbers without a country or area code.
Of mail addresses the ASCII letters and the digits of the local part are replaced. A validated value is replaced by a keyed permutation of
all values of its format: its digits are one number below the size of the domain,
which a Feistel network over two halves of the number permutes, walking on until
the result is again in the domain and valid. The pseudonym is written as the value
was: with its blanks, marks, leading zeros and capitals, and as long. Equal values
have equal pseudonyms in every document, however they are written (a day as
2024-02-01 or 01/02/2024, an IBAN with or without blanks, an address in capitals),
and different ones of a format different ones. Who holds the key can undo it.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import itertools
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm._arrow import steps

ROUNDS = 8

# The patterns of the formats, in the order in which they are tried.
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]{1,254}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)"
    r"|(?P<ip>(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![\d.]*\d))"
    r"|(?P<date>(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/.])\d{1,2}[/.]\d{1,2}[/.]\d{4}(?![\d/]))"
    r"|(?P<iban>\b[A-Za-z]{2}\d{2}(?: ?[A-Za-z0-9]){11,30})"
    r"|(?P<ssn>(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]))"
    r"|(?P<card>(?<![\d.])\d(?:[ -]?\d){12,18}(?![\d]))"
    r"|(?P<phone>(?<![\w+])\+\d{1,15}(?:(?:[ ./-]|[ .-]?\(|\)[ .-]?)\d{1,12}){0,6}"
    r"|(?<![\w+])(?<!\d[ ,./-])(?:1[ .-]?)?(?:\([2-9]\d\d\) ?[2-9]\d\d[ .-]|[2-9]\d\d-[2-9]\d\d-|[2-9]\d\d\.[2-9]\d\d\.)\d{4}(?![ ,./-]?\d)"
    r"|(?<![\w+])(?<!\d[ ,./-])(?:\(0\d{1,4}\)[ /-]?|0\d{1,4}[ /-])\d{3,8}(?:[ -]\d{2,5}){0,2}(?![ ,./-]?\d)"
    r"|(?<![\w+])(?<!\d[ ,./-])0[1-9](?:([ .-])\d\d)(?:\8\d\d){3}(?![ ,./-]?\d))"
)
# The length of an IBAN by country.
IBAN_LENGTHS = dict(
    AD=24, AE=23, AL=28, AT=20, AZ=28, BA=20, BE=16, BG=22, BH=22, BR=29, BY=28, CH=21, CR=22, CY=28, CZ=24, DE=22, DK=18, DO=28, EE=20, EG=29,
    ES=24, FI=18, FO=18, FR=27, GB=22, GE=22, GI=23, GL=18, GR=27, GT=28, HR=21, HU=28, IE=22, IL=23, IQ=23, IS=26, IT=27, JO=30, KW=30, KZ=20,
    LB=28, LC=32, LI=21, LT=20, LU=20, LV=21, LY=25, MC=27, MD=24, ME=22, MK=19, MR=27, MT=31, MU=30, NL=18, NO=15, PK=24, PL=28, PS=29, PT=25,
    QA=29, RO=24, RS=22, SA=24, SC=31, SD=18, SE=24, SI=19, SK=24, SM=27, ST=25, SV=28, TL=23, TN=24, TR=26, UA=29, VA=22, VG=24, XK=20,
)


def _mask(key: bytes, label: str, size: int, k: int, half: int, a: int) -> int:
    """What a round adds to one half, from the other: 64 bits more than a half has."""
    mac = hmac.new(key, f"{label}|{size}|{k}|{half}".encode(), hashlib.sha256).digest()
    need = a.bit_length() // 8 + 9
    return int.from_bytes(mac[:16] if need <= 16 else hashlib.shake_256(mac).digest(need), "big")


def permute(key: bytes, label: str, value: int, size: int) -> int:
    """A keyed permutation of the numbers below ``size``: Feistel rounds over (left, right) of about equal ranges, walked until below ``size``."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1  # a * a >= size
    while True:
        left, right = divmod(value, a)
        for k in range(ROUNDS):
            left, right = right, (left + _mask(key, label, size, k, right, a)) % a
        value = left * a + right
        if value < size:
            return value


def unpermute(key: bytes, label: str, value: int, size: int) -> int:
    """The inverse of ``permute``."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    while True:
        left, right = divmod(value, a)
        for k in reversed(range(ROUNDS)):
            left, right = (right - _mask(key, label, size, k, left, a)) % a, left
        value = left * a + right
        if value < size:
            return value


_DOUBLED = str.maketrans("0123456789", "0246813579")


def luhn(digits: str) -> bool:
    return sum(map(int, digits[::-2] + digits[-2::-2].translate(_DOUBLED))) % 10 == 0


def fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    it = iter(digits)
    return re.sub(r"\d", lambda _: next(it), shape)


Move = Callable[[str, int, int], int]


def _card(text: str, move: Move) -> str | None:
    groups = list(re.finditer(r"\d+", text))
    digits = "".join(m[0] for m in groups)
    sizes = list(itertools.accumulate(len(m[0]) for m in groups))
    for n, end in zip(reversed(sizes), (m.end() for m in reversed(groups)), strict=True):  # another number may follow the card's
        if n < 13:
            break
        if luhn(digits[:n]):  # all but the check digit, which follows
            head = str(move(f"card{n}", int(digits[: n - 1]), 10 ** (n - 1))).zfill(n - 1)
            return fill(text[:end], head + next(c for c in "0123456789" if luhn(head + c)))
    return None


_OCTETS = ((0, 10), (10, 100), (100, 256))  # by number of digits


def _ip(text: str, move: Move) -> str | None:
    parts = text.split(".")
    octets = [int(x) for x in parts]
    if max(octets) > 255:
        return None
    spans = [next(s for s in _OCTETS if s[0] <= x < s[1]) for x in octets]  # an octet keeps its number of digits
    value, size = 0, 1
    for x, (low, high) in zip(octets, spans, strict=True):
        value, size = value * (high - low) + x - low, size * (high - low)
    value = move("ip" + "".join(str(low) for low, _ in spans), value, size)
    out = []
    for part, (low, high) in zip(reversed(parts), reversed(spans), strict=True):
        value, x = divmod(value, high - low)
        out.append(str(x + low).zfill(len(part)))
    return ".".join(reversed(out))


_YEARS = range(1900, 2100)


def _class(day: datetime.date) -> tuple[int, bool]:
    """What a pseudonym shares with its day, so that it is as long and read in the same order: days below 10, up to 12 and beyond; months below 10."""
    return (day.day > 9) + (day.day > 12), day.month > 9


@lru_cache(maxsize=1)
def _days() -> tuple[dict[tuple[int, bool], list[int]], dict[int, int]]:
    """The days of each class, and the place of each day in its class."""
    classes: dict[tuple[int, bool], list[int]] = {}
    place = {}
    for n in range(datetime.date(_YEARS[0], 1, 1).toordinal(), datetime.date(_YEARS[-1], 12, 31).toordinal() + 1):
        own = classes.setdefault(_class(datetime.date.fromordinal(n)), [])
        place[n] = len(own)
        own.append(n)
    return classes, place


def _date(text: str, move: Move) -> str | None:
    parts = re.findall(r"\d+", text)
    for order in [(0, 1, 2)] if "-" in text else [(2, 1, 0), (2, 0, 1)]:  # day first, else month first
        try:
            day = datetime.date(*(int(parts[i]) for i in order))
        except ValueError:
            continue
        if day.year not in _YEARS:
            return None
        classes, place = _days()
        own = classes[_class(day)]
        kind = "".join(map(str, map(int, _class(day))))
        new = datetime.date.fromordinal(own[move(f"date{kind}", place[day.toordinal()], len(own))])
        value = dict(zip(order, (new.year, new.month, new.day), strict=True))
        texts = iter(str(value[i]).zfill(len(parts[i])) for i in range(3))
        return re.sub(r"\d+", lambda _: next(texts), text)
    return None


def iban_remainder(text: str) -> int:
    moved = text[4:] + text[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97


def _iban(text: str, move: Move) -> str | None:
    shown, text = text, text.upper()
    size = IBAN_LENGTHS.get(text[:2], 0)
    end = next((k + 1 for k, n in enumerate(itertools.accumulate(c != " " for c in text)) if n == size), 0)
    bare = text[:end].replace(" ", "")
    if shown[:end] not in (text[:end], text[:end].lower()):
        return None  # capitals and small letters mixed
    if not end or text[end : end + 1].isalnum() or iban_remainder(bare) != 1:  # words may follow
        return None
    digits = "".join(c for c in bare[4:] if c.isdigit())
    if not digits:
        return None
    body = fill(bare[4:], str(move(f"iban{bare[:2]}{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits)))
    check = 98 - iban_remainder(bare[:2] + "00" + body)
    new = iter(bare[:2] + f"{check:02d}" + body)
    out = re.sub(r"\S", lambda _: next(new), text[:end])
    return out if shown[:end] == text[:end] else out.lower()


def _ssn(text: str, move: Move) -> str | None:
    good = lambda x: x[:3] not in ("000", "666") and x[0] != "9" and x[3:5] != "00" and x[5:] != "0000"
    digits = text.replace("-", "")
    if not good(digits):
        return None
    while True:
        digits = str(move("ssn", int(digits), 10**9)).zfill(9)
        if good(digits):
            return fill(text, digits)


def country_code(digits: str) -> str:
    """The assigned country code that digits begin with, or nothing."""
    one, two = digits[:1], digits[:2]
    if one in ("1", "7"):
        return one
    # fixed values: the codes of two digits, and the first two digits of those of three
    if two in "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split():
        return two
    if two in "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split() and len(digits) > 2:
        return digits[:3]
    return ""


def _phone(text: str, move: Move) -> str | None:
    if not text.startswith("+"):  # the pattern is the plan; its fixed digits stay what they are
        digits = re.sub(r"\D", "", text)
        trunk = digits[0] == "0"
        if trunk and not 9 <= len(digits) <= 12:
            return None
        own = digits[1:] if trunk or len(digits) == 11 else digits
        kind, new = f"phone{digits[0] if own != digits else ''}n{len(own)}", int(own)
        while True:
            new = move(kind, new, 10 ** len(own))
            moved = str(new).zfill(len(own))
            if trunk or (moved[0] > "1" and moved[3] > "1"):
                if not (trunk and moved[0] == "0"):
                    return fill(text, digits[: len(digits) - len(own)] + moved)
    groups = list(re.finditer(r"\d+", text))
    digits = "".join(m[0] for m in groups)
    code = country_code(digits)
    if not code or len(groups) > 1 and len(groups[0][0]) < len(code):
        return None
    # as many groups as make a number: of ten digits with code 1 or 7, else up to twelve, ended by a long group
    size, end, long = -len(code), None, False
    for k, m in enumerate(groups):
        size += len(m[0])
        if size > 12 or long:
            break
        long = len(m[0]) - (len(code) if k == 0 else 0) > 5
        if size == 10 if len(code) == 1 else size >= 7:
            end, own = m.end(), digits[len(code) : len(code) + size]
            if len(code) == 1:
                break
    if end is None or text[end - 1 : end].isdigit() and text[end : end + 1].isdigit():
        return None
    return fill(text[:end], code + str(move(f"phone+{code}:{len(own)}", int(own), 10 ** len(own))).zfill(len(own)))


def _email(text: str, move: Move) -> str:
    local, _, domain = text.partition("@")
    # letters and digits of the local part keep their kind and place
    value, size = 0, 1
    for c in local:
        if c.isascii() and c.isdigit():
            value, size = value * 10 + int(c), size * 10
        elif c.isalpha() and c.isascii():
            value, size = value * 26 + ord(c.lower()) - 97, size * 26
    shape = re.sub(r"[a-z]", "a", re.sub(r"[0-9]", "0", re.sub(r"[A-Z]", lambda m: m[0].lower(), local)))
    value, out = move(f"email{shape}", value, size), []
    for c in reversed(local):
        base = 1 if not c.isascii() else 10 if c.isdigit() else 26 if c.isalpha() else 1
        value, d = divmod(value, base)
        out.append(c if base == 1 else str(d) if base == 10 else chr((97 if c.islower() else 65) + d))
    return "".join(reversed(out)) + "@" + domain


FORMATS = {"card": _card, "ip": _ip, "date": _date, "iban": _iban, "ssn": _ssn, "phone": _phone, "email": _email}


def pseudonymise(text: str, key: bytes, undo: bool = False) -> tuple[str, int]:
    """The text with its validated values replaced, and how many were."""
    step = unpermute if undo else permute
    move = lambda label, value, size: step(key, label, value, size)
    out, upto, at, done = [], 0, 0, 0
    while hit := _HIT.search(text, at):
        # a value has a digit or an at sign after at most BEFORE characters, none of them blank
        h, new = hit.start(), None
        start = max(at, h - BEFORE)
        blank = max((k for c in " \n\t\r" if (k := text.rfind(c, start, h)) >= 0), default=start - 1)
        for p in range(blank + 1, h + 1):
            if m := PATTERN.match(text, p):
                new = FORMATS[m.lastgroup](m[0], move)
                if new is not None:
                    out += (text[upto:p], new)
                    upto = at = p + len(new)  # as long as the value
                    done += 1
                    break
                at = after_failed(m)
                if at > h:
                    break
        if new is None:
            at = max(at, h + 1)
    return "".join((*out, text[upto:])), done


def after_failed(m: re.Match) -> int:
    """Where to go on after a match that fails its validation: within it, but a number in groups of four is no phone number."""
    if m.lastgroup == "card" and re.fullmatch(r"\d{4}(?:[ -]\d{4})*(?:[ -]\d{1,4})?", m[0]):
        for k in range(m.start() + 5, m.end(), 5):  # a card may begin with a later group
            later = PATTERN.match(m.string, k)
            if later and later.lastgroup == "card" and _card(later[0], lambda label, value, size: value) is not None:
                return k
        return m.end()
    return m.start() + 1


_HIT = re.compile("[0-9@]")
#: Characters of a value before its first digit or at sign: those of the local part of an address.
BEFORE = 254


def pseudonymise_texts(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, text_col with pseudonyms, n_replaced.

    Texts are handled whole. A null text stays null with 0 replacements, an empty one
    empty; values that fail their validation stay as they are. Rows with null or
    repeated ids keep a row each, and only the two columns are read, so others may
    have any names. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(text_col).isNull().alias("missing"))
    secret = key.encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                out = [(None, 0) if none else pseudonymise(t, secret) if _HIT.search(t) else (t, 0) for t, none in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], ["id", "text", "n_replaced"])

    out = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("text", T.StringType()), T.StructField("n_replaced", T.LongType())])
    return rows.mapInArrow(run, out).select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_replaced")
