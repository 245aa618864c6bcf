"""Personal values beside other numbers and capital words."""

import re

import pytest

from tests.llm.test_pii import iban_ok, luhn, run

CARDS = ["4111111111111111", "4111 1111 1111 1111", "4041-8949-7460-8795", "378282246310005"]
IBANS = ["ES9121000418450200051332", "AT611904300234573201", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO9386011117947", "BE68539007547034", "PL61109010140000071219812874", "FR14 2004 1010 0505 0001 3M02 606"]


def left(spark, cases, kind, right):
    """Each case is (before, value, behind); the neighbours stay and the value becomes another right one."""
    for (before, value, behind), (text, found) in zip(cases, run(spark, [b + v + c for b, v, c in cases]), strict=True):
        assert text.startswith(before) and text.endswith(behind), text
        got = text[len(before) : len(text) - len(behind)]
        assert found == [kind] and got != value and right(got) and re.sub("[0-9]", "9", re.sub("[A-Z]", "A", got)) == re.sub("[0-9]", "9", re.sub("[A-Z]", "A", value)), (before, value, behind, text)


def test_cards_beside_numbers(spark):
    sides = [("card ", " 12/27"), ("Room 5 ", ""), ("No 77777 ", " 123 ok"), ("", " 12a"), ("REF AB12 ", " EUR")]
    cases = [(b, v, c) for v in CARDS for b, c in sides]
    # a longer window that is right by chance is a card as well
    digits = lambda *s: re.findall("[0-9]+", " ".join(s))
    chance = lambda b, v, c: any(luhn("".join(w)) for g in [digits(b) + digits(v) + digits(c)] for i in range(len(g)) for j in range(i, len(g)) for w in [g[i : j + 1]] if len("".join(digits(v))) < len("".join(w)) <= 19)
    cases = [x for x in cases if not chance(*x)]
    assert len(cases) > 12
    left(spark, cases, "card", luhn)


def test_ibans_beside_capital_words(spark):
    left(spark, [(b, v, c) for v in IBANS for b, c in (("", " EUR 50"), ("IBAN ", " BIC ABCD"), ("NR 12 AT ", " 4000"), ("A1 ", " EURO"))], "iban", iban_ok)


def test_two_in_a_run_and_other_kinds_behind(spark):
    texts = ["4111 1111 1111 1111 4041894974608795", "4111111111111111 2021-02-28", "4111111111111111 8.8.8.8", "12345 2021-02-28", "AT611904300234573201 4111 1111 1111 1111", "4111111111111111 123-45-6789", "4111111111111111 212-555-1234"]
    got = run(spark, texts)
    assert [f for _, f in got] == [["card", "card"], ["card", "iso_date"], ["card", "ip"], ["iso_date"], ["iban", "card"], ["card", "ssn"], ["card", "us_phone"]]
    assert got[3][0].startswith("12345 ")


@pytest.mark.parametrize("text", ["1" * 20_000, "12 " * 3_000, "4041 8949 7460 8796", "GB83WEST12345698765432 EUR", "1111 2222 3333 444x"])
def test_runs_without_a_value_stay(spark, text):
    (out, found), = run(spark, [text])
    assert len(out) == len(text) and ((out == text) == (not found)) and (found == [] or text.startswith("12 "))
