"""Phone numbers are validated, other numbers left alone, and values of any case and length found."""

import random

import pytest

from recengine.llm import pii

NUMBERS = [
    "+1 (017) 555-7713", "+1 212-555-0187", "+1.212.555.0187", "+12125550187", "+49 30 1234567", "+49301234567", "+44 (0)20 7946 0958", "+33 1 23 45 67 89", "+7 495 123-45-67", "+351 21 345 6789",
    "(212) 555-0187", "212-555-0187", "212.555.0187", "1-800-555-0199", "030 1234567", "(030) 1234567", "020 7946 0958", "01 23 45 67 89", "01.23.45.67.89",
]
OTHERS = [
    "10 000 000 people", "2020-2021-2022 seasons", "1990-1995-2000", "order 123 456 789", "ISBN 978-0306-4061", "ISBN 0-306-40615-2", "ISBN 978-3-16-148410-0", "1,200 300 400", "1.234.567.890", "12 345-6789-1234",
    "0.1234 5678", "v1.2.3 2024 1000", "+5 apples", "+100 200 300", "scores 021 345 now", "room 112-555", "2024 1234 5678", "212-155-0187", "112-555-0187", "999-999-9999 1", "3.1415926535", "1700000000000",
]


@pytest.mark.parametrize("text", NUMBERS)
def test_numbers_are_replaced_in_any_place(text):
    for before, after in (("", ""), ("call ", " now"), ("(", ")"), ("tel:", ". Then"), ("é ", "\n2024")):
        if before == "(" and text[0] == "(":
            continue
        out, n = pii.pseudonymise(before + text + after, b"k")
        assert n == 1 and out.startswith(before) and out.endswith(after) and text not in out and len(out) == len(before + text + after), out
        assert [c.isdigit() for c in out] == [c.isdigit() for c in before + text + after]
        assert pii.pseudonymise(out, b"k", undo=True)[0] == before + text + after


@pytest.mark.parametrize("text", OTHERS)
def test_other_numbers_stay(text):
    assert pii.pseudonymise(text, b"k") == (text, 0)
    assert pii.pseudonymise(f"of {text}, and", b"k") == (f"of {text}, and", 0)


def test_random_amounts_ranges_and_codes_are_left_alone():
    rng = random.Random(6)
    group = lambda n: str(rng.randint(10 ** (n - 1), 10**n - 1))
    for _ in range(2000):
        kind = rng.randint(0, 3)
        text = (
            " ".join([group(rng.randint(1, 3)), *(f"{rng.randint(0, 999):03d}" for _ in range(rng.randint(1, 4)))]) if kind == 0  # amounts
            else "-".join(str(rng.randint(1900, 2099)) for _ in range(3)) if kind == 1  # runs of years
            else ",".join([group(rng.randint(1, 3)), *(f"{rng.randint(0, 999):03d}" for _ in range(2))]) + " 100 200" if kind == 2
            else f"978-{group(1)}-{group(4)}-{group(4)}-{group(1)}"
        )
        found, n = pii.pseudonymise(f"sum {text} here", b"k")
        assert n == 0 or pii.luhn("".join(c for c in text if c.isdigit())), found  # a card's check digit may hold by chance


def test_values_in_small_letters_and_long_addresses():
    out, n = pii.pseudonymise("pay de89 3704 0044 0532 0130 00 to it", b"k")
    upper = pii.pseudonymise("pay DE89 3704 0044 0532 0130 00 to it", b"k")[0]
    assert n == 1 and out.lower() == upper.lower() != "pay de89 3704 0044 0532 0130 00 to it" and out[4:6] == "de"
    for local in ("jo.bär", "a" * 70, "x" * 250):
        out, n = pii.pseudonymise(f"to {local}@x.org now", b"k")
        assert n == 1 and local not in out and len(out) == len(f"to {local}@x.org now") and pii.pseudonymise(out, b"k", undo=True)[0] == f"to {local}@x.org now"
        assert len(set(out[3 : 3 + len(local)])) > 3
    for stays in ("31.12.1899", "555-1234", "De89 3704 0044 0532 0130 00"):  # stated limits
        assert pii.pseudonymise(stays, b"k") == (stays, 0)


def test_one_number_has_one_pseudonym_with_and_without_blanks():
    digits = lambda t: "".join(c for c in pii.pseudonymise(t, b"k")[0] if c.isdigit())
    assert digits("+49 30 1234567") == digits("+49301234567") == digits("+49 (30) 123-4567")
    assert len({digits(f"+4930{k:07d}") for k in range(200)}) == 200
