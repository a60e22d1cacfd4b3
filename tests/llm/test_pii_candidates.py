"""Values inside longer candidates, upper-case secrets, timestamps, mm/dd."""

import pytest

from tastemill.llm import pii


@pytest.mark.parametrize("text,kind,value", [
    ("4111111111111111 123", "card", "4111111111111111"),
    ("4111 1111 1111 1111 12/27", "card", "4111 1111 1111 1111"),
    ("1234 4111 1111 1111 1111", "card", "4111 1111 1111 1111"),
    ("DE89370400440532013000 BIC COBADEFF", "iban", "DE89370400440532013000"),
    ("t = " + "9233A8EC" * 5, "hex", "9233A8EC" * 5),
    ("AB12" + "9233A8EC" * 3 + "0F0F", "hex", "AB12" + "9233A8EC" * 3 + "0F0F"),
    ("at 2024-05-01T12:00:00Z", "date", "2024-05-01"),
    ("on 12/31/2024 it", "date", "12/31/2024"),
    ("on 31/12/2024 it", "date", "31/12/2024")])
def test_found(text, kind, value):
    got = pii.pseudonymise(text, b"k")
    assert [(s["kind"], text[s["start"]:s["end"]]) for s in got["spans"]] == [(kind, value)]
    assert value not in got["text"] and len(got["text"]) == len(text)


def test_american_dates_stay_distinct():
    days = [f"{m:02d}/{d:02d}/2024" for m in range(1, 13) for d in range(1, 29)] + [f"{d:02d}/{m:02d}/2024" for m in range(1, 13) for d in range(13, 29)]
    assert len({pii.pseudonym("date", s, b"k") for s in days}) == len(set(days))


def test_failed_numbers_stay():
    for text in ("4111111111111112", "4111 1111 1111 1112", "99/99/2024", "2024-13-01T00:00"):
        assert pii.pseudonymise(text, b"k") == {"text": text, "spans": []}
