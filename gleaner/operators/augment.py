"""Variants of labelled addresses that keep their components: edits drawn by a hash of seed, id, copy and edit, so that reruns agree."""

from __future__ import annotations

import unicodedata
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleaner.arrow import explode_structs, per_text
from gleaner.functions.hashing import fnv1a

from .corpus import Piece, Pieces, abbreviations, cuts_token, decompose, glued, render, spans_valid

DIRECTIONS = frozenset("north south east west northeast northwest southeast southwest".split())
_JAPANESE = ("぀", "鿿")


class Draw:
    """Numbers of a hashed stream."""

    def __init__(self, *key: object):
        self.key, self.n = "/".join(map(str, key)), 0

    def uniform(self) -> float:
        self.n += 1
        h = fnv1a(f"{self.key}/{self.n}".encode())  # a last byte reaches few of its high bits, so it is mixed
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ h >> shift) * factor & 0xFFFFFFFFFFFFFFFF
        return ((h ^ h >> 31) >> 11) / float(1 << 53)

    def below(self, n: int) -> int:
        return int(self.uniform() * n)


def japanese(p: Pieces) -> bool:
    """More labelled pieces in Japanese than in Latin script."""
    labelled = [i.text for i in p.items if i.label]
    cjk = sum(any(_JAPANESE[0] <= c <= _JAPANESE[1] for c in t) for t in labelled)
    return cjk > sum(any(c.isascii() and c.isalpha() for c in t) for t in labelled)


def _together(country: str, a: str | None, b: str | None) -> bool:
    """Pairs that no separator splits: a number and its road, a postcode and its place."""
    place = ("suburb", "district", "city")
    if {a, b} == {"house_number", "road"}:
        return True
    if country in ("DE", "GE") and a == "postcode" and b in place:
        return True
    return country == "GE" and (a, b) == ("city", "postcode") or country == "US" and (a, b) == ("region", "postcode")


def _in_us_place(country: str, p: Pieces, i: int) -> bool:
    labels = [x.label for x in p.items]
    return country == "US" and "city" in labels and "region" in labels and labels.index("city") <= i < labels.index("region")


def _with_seps(p: Pieces, change) -> Pieces:
    return Pieces(p.items, [change(i, s, p.items[i], p.items[i + 1]) for i, s in enumerate(p.seps)])


def _with_texts(p: Pieces, change) -> Pieces:
    return Pieces([Piece(i.label, change(i)) for i in p.items], p.seps)


def commas(country: str, p: Pieces, draw: Draw) -> Pieces:
    if country == "JP" and japanese(p):
        return p
    return _with_seps(p, lambda i, s, a, b: ", " if s == " " and a.label and b.label and not _together(country, a.label, b.label) else s)


def newlines(country: str, p: Pieces, draw: Draw) -> Pieces:
    if country == "JP" and japanese(p):
        return p
    free = [i for i, s in enumerate(p.seps) if s != "\n" and not _together(country, p.items[i].label, p.items[i + 1].label) and not _in_us_place(country, p, i)]
    chosen = {free[draw.below(len(free))] for _ in range(1 + draw.below(min(2, len(free))))} if free else set()
    return _with_seps(p, lambda i, s, a, b: "\n" if i in chosen else s)


def one_line(country: str, p: Pieces, draw: Draw) -> Pieces:
    town = draw.uniform() < 0.6

    def change(i: int, s: str, a: Piece, b: Piece) -> str:
        if s != "\n":
            return s
        if glued(a.text, b.text) and a.label and b.label:
            return ""
        if country == "JP" and japanese(p) or _together(country, a.label, b.label) or country == "GB" and (a.label, b.label) == ("city", "postcode") and town:
            return " "
        return ", "

    return _with_seps(p, change)


def marks(country: str, p: Pieces, draw: Draw) -> Pieces:
    mark = (" · ", " | ", "; ", " - ")[draw.below(4)]
    if country == "JP" or any("\n" in s for s in p.seps):
        return p
    return _with_seps(p, lambda i, s, a, b: mark if s == ", " and not _in_us_place(country, p, i) else s)


_WIDE = {ord("0") + k: 0xFF10 + k for k in range(10)} | {ord("-"): "－"}


def digit_width(country: str, p: Pieces, draw: Draw) -> Pieces:
    if country != "JP":
        return p
    wide = any("０" <= c <= "９" for i in p.items for c in i.text)
    table = {v if isinstance(v, int) else ord(v): chr(k) for k, v in _WIDE.items()} if wide else _WIDE
    return _with_texts(p, lambda i: i.text.translate(table))


def ideographic_comma(country: str, p: Pieces, draw: Draw) -> Pieces:
    if country != "JP" or not japanese(p):
        return p
    return _with_seps(p, lambda i, s, a, b: "、" if s == " " and a.label and b.label else s)


def _shortened(country: str, text: str) -> str:
    words = text.split(" ")
    short = {full: s for full, s in reversed(abbreviations(country))}
    is_direction = lambda w: w.rstrip(".").lower() in DIRECTIONS
    out = []
    for k, w in enumerate(words):
        n, low = len(words), w.lower()
        if is_direction(w):
            fits = n > 2 and k in (0, n - 1)
        else:
            fits = k > 0 and (k == n - 1 or k == n - 2 and is_direction(words[-1])) and words[k - 1].lower() != "the"
        if low in short and fits:
            s = short[low]
            out.append(s.upper() if len(w) > 1 and w == w.upper() else s[:1].upper() + s[1:] if w[:1].isupper() else s)
        elif country == "DE" and len(w) > 6 and low.endswith(("straße", "strasse")):
            out.append(w[: -6 if low.endswith("straße") else -7] + "str.")
        else:
            out.append(w)
    return " ".join(out)


def abbreviate(country: str, p: Pieces, draw: Draw | None) -> Pieces:
    return _with_texts(p, lambda i: _shortened(country, i.text) if i.label == "road" else i.text)


def _recased(country: str, p: Pieces, f) -> Pieces:
    same = lambda t: f(t) if len(f(t).encode()) == len(t.encode()) else t
    return p if country == "GE" else _with_texts(p, lambda i: same(i.text))


def upper(country: str, p: Pieces, draw: Draw) -> Pieces:
    return _recased(country, p, str.upper)


def lower(country: str, p: Pieces, draw: Draw) -> Pieces:
    return _recased(country, p, str.lower)


def german_prefix(country: str, p: Pieces, draw: Draw) -> Pieces:
    at = next((k for k, i in enumerate(p.items) if i.label == "postcode" and i.text[:1].isdigit()), None)
    if country != "DE" or at is None or at and p.items[at - 1].text == "D-":
        return p
    return Pieces([*p.items[:at], Piece(None, "D-"), *p.items[at:]], [*p.seps[:at], "", *p.seps[at:]])


def decomposed(country: str, p: Pieces, draw: Draw) -> Pieces:
    return _with_texts(p, lambda i: unicodedata.normalize("NFD", i.text)) if country == "DE" else p


def reorder(country: str, p: Pieces, draw: Draw) -> Pieces:
    """Postcode and town the other way round, where both ways are written."""
    for i in range(len(p.items) - 1):
        pair = p.items[i].label, p.items[i + 1].label
        if country == "GE" and set(pair) == {"city", "postcode"}:
            return Pieces([*p.items[:i], p.items[i + 1], p.items[i], *p.items[i + 2 :]], p.seps)
    return p


#: In order of application, each with the probability that a copy gets it.
EDITS = (
    (commas, 0.5), (newlines, 0.3), (one_line, 0.35), (marks, 0.10), (digit_width, 0.5), (ideographic_comma, 0.15), (abbreviate, 0.4), (upper, 0.15), (lower, 0.10),
    (german_prefix, 0.05), (decomposed, 0.10), (reorder, 0.20),
)


def components(country: str, p: Pieces) -> Counter:
    """What an edit may not change: labels and texts, whatever their case, width and abbreviation."""
    flat = lambda i: unicodedata.normalize("NFKC", _shortened(country, i.text.lower()) if i.label == "road" else i.text).lower().replace("ß", "ss").replace("strasse", "str.")
    return Counter((i.label, flat(i)) for i in p.items if i.label)


def copies(seed: int, country: str, row_id: int, text: str, spans: list, n: int) -> list[tuple[int, str, list]]:
    """Up to n variants (copy, text, spans), each unlike the row and the others."""
    source, seen, out = decompose(text, spans), {text}, []
    before = components(country, source)
    for c in range(n):
        p = source
        for edit, rate in EDITS:
            draw = Draw(seed, row_id, c, edit.__name__)
            if draw.uniform() < rate:
                p = edit(country, p, draw)
        made, made_spans = render(p)
        if components(country, p) != before:
            raise ValueError(f"an edit changed the components of row {row_id}: {text!r} -> {made!r}")
        if made not in seen and spans_valid(made, made_spans) and not cuts_token(made, made_spans):
            seen.add(made)
            out.append((c, made, made_spans))
    return out


def copy_id(row_id: int, n: int, c: int) -> int:
    """Ids of copies count down from the largest unsigned long."""
    return (1 << 64) - 1 - (row_id * n + c)


def original_id(copy: int, n: int) -> int:
    return ((1 << 64) - 1 - copy) // max(1, n)


COPY = "array<struct<copy:int,text:string,spans:array<struct<label:string,start:int,end:int>>>>"


def augmented(rows: DataFrame, id_col: str, n: int, seed: int = 0) -> DataFrame:
    """(id, country, copy, text, spans): variants of training rows (id, country, text, spans)."""

    def of(row_id: int, country: str, text: str, spans: list) -> list[dict]:
        found = copies(seed, country, row_id, text, [(s["label"], s["start"], s["end"]) for s in spans], n)
        return [{"copy": c, "text": t, "spans": [{"label": k, "start": a, "end": b} for k, a, b in own]} for c, t, own in found]

    columns = [F.col(id_col), F.col("country"), F.col("text"), F.col("spans")]
    return explode_structs(per_text(rows, columns, of, COPY, "copies", [id_col, "country"]), "copies", [id_col, "country"])
