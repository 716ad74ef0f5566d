import time

import pytest

from gleaner.operators import emails


def found(text):
    data = text.encode()
    return [(data[e.start : e.end].decode(), e.normalized, e.confidence) for e in emails.scan(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to Ana.Lee@Example.COM.", [("Ana.Lee@Example.COM", "Ana.Lee@example.com", 0.99)]),
        ("é <x@y.org>, (z@y.org)", [("x@y.org", "x@y.org", 0.99), ("z@y.org", "z@y.org", 0.99)]),
        ("'o'brien@x.ie'", [("o'brien@x.ie", "o'brien@x.ie", 0.99)]),
        ("key=a@b.co and `c@d.io`", [("a@b.co", "a@b.co", 0.99), ("c@d.io", "c@d.io", 0.99)]),
        ("host a@b.c1", [("a@b.c1", "a@b.c1", 0.7)]),
        ("https://user:pw@host.example.com/x", []),
        ("/path/a@b.com", []),
        ("a@b@c.com", []),
        (".a@b.com a..b@c.com a@b a@-b.com a@b-.com", []),
        ("x" * 65 + "@b.com", []),
        ("a@" + "b" * 64 + ".com", []),
        ("", []),
        ("@", []),
    ],
)
def test_scan(text, want):
    assert found(text) == want


def test_whole():
    assert emails.whole("a@b.com") and not emails.whole("a@b.com ") and not emails.whole("a@b.com,c@d.com")


def test_linear():
    start = time.time()
    assert len(emails.scan("a@b.co;" * 40_000)) == 40_000
    assert len(emails.scan("a" * 200_000 + "@b.co")) == 0
    assert time.time() - start < 5
