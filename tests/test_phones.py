import time

import pytest

from gleaner.functions.phone_metadata import PLANS, load, other_codes
from gleaner.operators import phones


def found(text, *hints):
    data = text.encode()
    return [(data[e.start : e.end].decode(), e.normalized, e.region) for e in phones.scan(text, hints)]


@pytest.mark.parametrize(
    "text, hints, want",
    [
        ("+1 202-555-0143", (), [("+1 202-555-0143", "+12025550143", "US")]),
        ("Call (202) 555-0199 today", ("US",), [("(202) 555-0199", "+12025550199", "US")]),
        ("(202) 555-0199", (), []),
        ("+49 (0)30 2312 5456", (), [("+49 (0)30 2312 5456", "+493023125456", "DE")]),
        ("0049 30 23125456", (), [("0049 30 23125456", "+493023125456", "DE")]),
        ("(+995 32) 2 25 04 84", (), [("(+995 32) 2 25 04 84", "+995322250484", "GE")]),
        ("44 (0)303 123 1113", (), [("44 (0)303 123 1113", "+443031231113", "GB")]),
        ("Tel. 030 1234567 / 0171 1234567", ("DE",), [("030 1234567", "+49301234567", "DE"), ("0171 1234567", "+491711234567", "DE")]),
        ("030 1234567 030 1234568", ("DE",), [("030 1234567", "+49301234567", "DE"), ("030 1234568", "+49301234568", "DE")]),
        ("12.03.2024 030 1234567", ("DE",), [("030 1234567", "+49301234567", "DE")]),
        ("Call 020 7946 0321 24 hours", ("GB",), [("020 7946 0321", "+442079460321", "GB")]),
        ("PLZ 01067 0351 1234567", ("DE",), [("0351 1234567", "+493511234567", "DE")]),
        ("+49 5121 206917-5555", (), [("+49 5121 206917-5555", "+4951212069175555", "DE")]),
        ("+34 91 714 6300", (), [("+34 91 714 6300", "+34917146300", "ES")]),
        ("NY 10118 212-555-0147", ("US",), [("212-555-0147", "+12125550147", "US")]),
        ("Tel 2125550147", ("US",), [("2125550147", "+12125550147", "US")]),
        ("2125550147", ("US",), []),
        ("(202) 555-0143, ext. 22", ("US",), [("(202) 555-0143, ext. 22", "+12025550143", "US")]),
        ("(800) 555-CARE (2273)", ("US",), [("(800) 555-CARE (2273)", "+18005552273", "US")]),
        ("dial 711 now", ("US",), [("711", "711", "US")]),
        ("room 711 now", ("US",), []),
        ("18001 0300 123 1300", ("GB",), [("18001 0300 123 1300", "+443001231300", "GB")]),
        ("225 04 84", ("GE",), [("225 04 84", "+995322250484", "GE")]),
        ("ტელეფონი: 1403", ("GE",), [("1403", "1403", "GE")]),
        ("ip 10.0.0.1 on 2024-01-15 10:30, price $555-0100, id 202555014312", ("US",), []),
        ("0800-1700, 08.00-12.00, 01.01.26-31.12.26", ("DE",), []),
        ("Chrome/128.0.6613.138, INV-2026-00871, DE89 3704 0044 0532 0130 00", ("DE", "US"), []),
        ("Order No. 030 1234567", ("DE",), []),
        ("1 234 567 EUR", ("US",), []),
        ("12 345 678 901 234", ("DE",), []),
        ("4111 1111 1111 1111", ("US", "DE"), []),
        ("", ("US",), []),
    ],
)
def test_scan(text, hints, want):
    assert found(text, *hints) == want


@pytest.mark.parametrize("word", ["gelichst", "GEL", "europaweit", "poundland"])
def test_words_after_a_number_in_full_are_no_currency(word):
    assert found(f"einßung +1 (287) 555-6394 {word}") == [("+1 (287) 555-6394", "+12875556394", "US")]
    assert found(f"+1 234 567 8901 {word}") == found(f"030 1234567 {word}", "DE") == []  # without brackets they are, as beginnings of words


def test_offsets_are_bytes():
    e = phones.scan("é +1 202-555-0143", ())[0]
    assert (e.start, e.end) == (3, 18)


def test_hints_are_tried_in_order_and_main_region_wins_a_shared_code():
    assert found("020 7946 0321", "DE", "GB")[0][2] == "DE" and found("020 7946 0321", "GB", "DE")[0][2] == "GB"
    assert found("+1 416 555 0143")[0][2] == "CA" and found("+1 800 555 0143")[0][2] == "US"


@pytest.mark.parametrize("text", ["1 " * 20_000, "030 1234567 " * 4000, "12-34-56-78 " * 4000, "1" * 100_000, "(1)" * 20_000, "+" * 50_000])
def test_hostile_runs_are_linear(text):
    start = time.time()
    phones.scan(text, ("DE", "US", "GB"))
    assert time.time() - start < 10


def test_plans(tmp_path):
    assert len(PLANS) == 11 and len(other_codes()) == 196
    path = tmp_path / "plans.json"
    path.write_text('[{"id": "XX", "code": 999, "trunk": "0", "lengths": [6], "core": [6], "prefixes": ["12x"]}]')
    plan = load(str(path))[0]
    assert plan.score("123456") == 0.99 and plan.score("223456") == 0.75 and plan.score("1234") is None
