"""Deterministic address parsing and entity detection from token features alone: the default scorer, as no weights are shipped."""

from __future__ import annotations

import bisect
import itertools

import regex

from gleaner.functions.dictionaries import DICTIONARIES
from gleaner.schema import Component, Entity

from .features import SHORT_LINE_TOKENS, bits_of, featurize, house_number_like, line_ranges, lowered, postcode_at, shape_string
from .tokens import Token, joins_spaces, tokenize

#: Fixed values.
ROAD_SUFFIXES = tuple("straße strasse str. str weg gasse allee platz damm ufer straat laan plein gracht kade dijk singel".split())
ROAD_PARTICLES = frozenset("den der de van am an auf im zum zur".split())
NAME_PARTICLES = frozenset("van der de von di da la le du".split())
ORG_PARTICLES = frozenset("& and of de und".split())
JAPANESE = (("region", "都道府県"), ("city", "市区"), ("suburb", "町村"))
CONFIDENCE = 0.9


class Document:
    """Tokens with features; content: places of tokens that aren't white space."""

    def __init__(self, text: str, country: str | None = None, rule_spans: list[tuple[int, int]] = ()):
        self.tokens: list[Token] = tokenize(text)
        self.flags = [f.flags for f in featurize(self.tokens, rule_spans, country, ngrams=False)]
        self.content = [i for i, t in enumerate(self.tokens) if t.is_content]
        self._rank = {i: k for k, i in enumerate(self.content)}

    def has(self, i: int, *names: str) -> bool:
        return bool(self.flags[i] & bits_of(names))

    def alpha(self, i: int) -> bool:
        return self.tokens[i].kind == "alpha"

    def title(self, i: int) -> bool:
        return self.alpha(i) and self.has(i, "title_case", "all_upper")

    def georgian(self, i: int) -> bool:
        return self.alpha(i) and self.tokens[i].script == "georgian"

    def lower(self, i: int) -> str:
        return self.tokens[i].text.lower()

    def beside(self, i: int, step: int) -> int | None:
        """The next content token that way."""
        k = self._rank[i] + step
        return self.content[k] if 0 <= k < len(self.content) else None

    def lines(self) -> list[list[int]]:
        return [[k for k in range(a, b) if self.tokens[k].is_content] for a, b in line_ranges(self.tokens)]

    def between(self, a: int, b: int) -> list[Token]:
        return self.tokens[a + 1 : b]

    def span(self, first: int, last: int) -> tuple[int, int]:
        return self.tokens[first].start, self.tokens[last].end


class _Parser:
    def __init__(self, doc: Document, country: str | None):
        self.doc, self.country, self.label = doc, country, dict.fromkeys(doc.content)

    def free(self, i: int | None) -> bool:
        return i is not None and self.label[i] is None

    def put(self, label: str, *places: int) -> None:
        for i in places:
            self.label[i] = label

    def postcodes(self) -> None:
        self.put("postcode", *[i for i in self.doc.content if self.doc.has(i, "postcode_like")])

    def countries(self) -> None:
        """Country terms at the end of their line."""
        runs: list[list[int]] = []
        for i in self.doc.content:
            if self.free(i) and self.doc.has(i, "country"):
                before = runs[-1][-1] if runs else None
                if before is not None and self.doc.beside(before, 1) == i and all(t.kind == "space" for t in self.doc.between(before, i)):
                    runs[-1].append(i)
                else:
                    runs.append([i])
        for run in runs:
            rest = self.doc.tokens[run[-1] + 1 :]
            tail = next((t for t in rest if t.kind != "space" and t.text not in (",", ".", ";")), None)
            if tail is None or tail.kind == "newline":
                self.put("country", *run)

    def units(self) -> None:
        for i in self.doc.content:
            k = self.doc.beside(i, 1)
            if self.free(i) and self.doc.has(i, "unit") and self.free(k) and self.doc.tokens[k].kind in ("digit", "alnum"):
                self.put("unit", i, k)

    def roads(self) -> None:
        doc = self.doc
        for i in doc.content:
            suffix = doc.alpha(i) and any(doc.lower(i).endswith(s) and doc.lower(i) != s for s in ROAD_SUFFIXES)
            if not self.free(i) or not (suffix or doc.has(i, "road")):
                continue
            self.put("road", i)
            in_georgian, at = doc.tokens[i].script == "georgian", i
            for _ in range(1 if in_georgian else 2 if suffix else 3):
                k = doc.beside(at, -1)
                if not self.free(k) or doc.tokens[k].text in (",", ";"):
                    break
                if not (doc.georgian(k) if in_georgian else doc.title(k) or doc.lower(k) in ROAD_PARTICLES):
                    break
                self.put("road", k)
                at = k
            k = doc.beside(i, 1)
            if self.country != "JP" and self.free(k) and doc.alpha(k) and doc.has(k, "all_upper") and len(doc.tokens[k].text) <= 2:
                self.put("road", k)

    def house_numbers(self) -> None:
        doc = self.doc
        if self.country == "JP":
            run: list[int] = []
            for i in reversed(doc.content):
                if not self.free(i) or not (doc.tokens[i].kind == "digit" or doc.tokens[i].text == "-"):
                    break
                run.append(i)
            if len(run) >= 3:
                self.put("house_number", *run)
            return
        found = [i for i in doc.content if self.free(i) and doc.has(i, "house_number_like")]
        self.put("house_number", *[i for i in found if any(k is not None and self.label[k] == "road" for k in (doc.beside(i, -1), doc.beside(i, 1)))])

    def regions(self) -> None:
        doc = self.doc
        if self.country == "JP":
            self._endings(*JAPANESE[0])
            return
        for i in doc.content:
            k = doc.beside(i, 1)
            code = k is not None and self.label[k] == "postcode" and doc.alpha(i) and doc.has(i, "all_upper") and len(doc.tokens[i].text) == 2
            if self.free(i) and (doc.has(i, "region") or code):
                self.put("region", i)

    def cities(self) -> None:
        doc = self.doc
        if self.country == "JP":
            for label, endings in JAPANESE[1:]:
                self._endings(label, endings)
            self.put("suburb", *self._first_run(doc.content, doc.alpha))
            return
        roads = [n for n, i in enumerate(doc.content) if self.label[i] in ("road", "house_number")]
        self.put("city", *self._first_run(doc.content[roads[-1] + 1 if roads else 0 :], lambda i: doc.title(i) or doc.georgian(i)))

    def _first_run(self, places: list[int], fits) -> list[int]:
        run: list[int] = []
        for i in places:
            if self.free(i) and fits(i):
                run.append(i)
            elif run:
                break
        return run

    def _endings(self, label: str, endings: str) -> None:
        """Runs of free words that end in one of the signs."""
        for n, i in enumerate(self.doc.content):
            if self.free(i) and self.doc.tokens[i].text[0] in endings:
                first = n
                while first and self.free(self.doc.content[first - 1]) and self.doc.alpha(self.doc.content[first - 1]):
                    first -= 1
                self.put(label, *self.doc.content[first : n + 1])

    def components(self) -> list[Component]:
        """Neighbours of one label, nothing but spaces between them, as one."""
        found: list[list] = []
        for i in self.doc.content:
            label = self.label[i]
            if label and found and found[-1][0] == label and self.doc.beside(found[-1][2], 1) == i and all(t.kind == "space" for t in self.doc.between(found[-1][2], i)):
                found[-1][2] = i
            elif label:
                found.append([label, i, i])
        return [Component(label, *self.doc.span(a, b), CONFIDENCE) for label, a, b in found]


def parse_address(text: str, country: str | None = None) -> list[Component]:
    """Components of one address, by precedence: postcode, country, unit, road, house number, region, city."""
    work = _Parser(Document(text, country), country)
    for step in (work.postcodes, work.countries, work.units, work.roads, work.house_numbers, work.regions, work.cities):
        step()
    return work.components()


def _addresses(doc: Document, lines: list[list[int]]):
    n = 0
    while n < len(lines):
        line = lines[n]
        n += 1
        if not line or any(doc.has(i, "in_rule_span") for i in line):
            continue
        house = any(doc.has(i, "house_number_like") and any(doc.has(k, "road") for k in line[p + 1 : p + 5]) for p, i in enumerate(line))
        if not house and not any(doc.has(i, "postcode_like") for i in line):
            continue
        last, below = line[-1], lines[n] if n < len(lines) else []
        if any(doc.has(i, "postcode_like", "country") for i in below) and not any(doc.has(i, "in_rule_span") for i in below):
            last, n = below[-1], n + 1
        yield line[0], last


def _organizations(doc: Document, lines: list[list[int]]):
    for line in lines:
        p = next((p for p, i in enumerate(line) if doc.has(i, "legal_form")), None)
        if p is None:
            continue
        first = last = line[p]
        if p == 0:
            for k in line[1:6]:
                if not doc.alpha(k):
                    break
                last = k
        else:
            for k in line[max(0, p - 5) : p][::-1]:
                if not doc.title(k) and doc.lower(k) not in ORG_PARTICLES:
                    break
                first = k
        if first != last or doc.alpha(first):
            yield first, last


def _name(doc: Document, line: list[int]) -> tuple[int, int] | None:
    """Two to four words of a name, particles between them."""
    if any(doc.has(i, "legal_form", "road") for i in line):
        return None
    georgian, run = all(map(doc.georgian, line)), []
    for i in line:
        if doc.alpha(i) if georgian else doc.title(i) or run and doc.lower(i) in NAME_PARTICLES:
            run.append(i)
        elif run:
            break
    while run and not georgian and not doc.title(run[-1]):
        run.pop()
    return (run[0], run[-1]) if 2 <= len(run) <= 4 else None


def _people(doc: Document, lines: list[list[int]]):
    for n, line in enumerate(lines):
        p = next((p for p, i in enumerate(line) if doc.has(i, "honorific")), None)
        if p is not None:
            rest = line[p + 1 :]
            while rest and (doc.tokens[rest[0]].text == "." or doc.has(rest[0], "honorific")):
                rest = rest[1:]
            names = rest[: 1 + (len(rest) > 1 and doc.title(rest[1]))] if rest and doc.title(rest[0]) else []
            if names:
                yield names[0], names[-1]
                continue
        if any(doc.has(i, "salutation", "closing") for i in line):
            found = _name(doc, lines[n + 1]) if n + 1 < len(lines) else None
        else:
            found = _name(doc, line) if line and all(doc.has(i, "in_short_line_block") for i in line) else None
        if found:
            yield found


# Most lines hold nothing to detect, which runs of them without a space tell; those are few different ones.

_OPENING = regex.compile("A{1,2}9[9A]?|A9A|9999")  # shapes of first halves of postcodes
_MARKS = {name: frozenset(t for n in names for t in DICTIONARIES[n]) for name, names in (("term", ("legal_form", "honorific", "salutation", "closing")), ("road", ("road",)))}
_OPEN = {name: frozenset(t[:k] for t in terms for k in range(1, len(t) + 1)) for name, terms in _MARKS.items()}
#: Second words of terms: without one, no term goes on behind a space.
_SECOND = tuple({t.split(" ")[1] for t in _MARKS["term"] if " " in t})
_WORD = regex.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$&]*)")
#: A piece's number of content tokens, and above it whether it has a term, may begin one, or may have a road, a house number or a postcode, each in bits of its own, so that sums count them.
_FIELD = 32
_TERM, _BEGUN, _ROAD, _HOUSE, _POSTCODE = (1 << _FIELD * k for k in range(1, 6))
_MOST_PIECES, _LONG_PIECE = 100_000, 64
_DROPPED = "," * (SHORT_LINE_TOKENS + 1)  # stands for long lines


def _spelled(texts: list[str], mark: str) -> tuple[bool, bool]:
    """(whether a term is spelled by neighbours in texts, whether one begins there and may go on behind a space)."""
    begun = False
    for i in range(len(texts)):
        phrase = ""
        for t in texts[i:]:
            phrase += t
            if phrase in _MARKS[mark]:
                return True, True
            if phrase not in _OPEN[mark]:
                break
        else:
            begun |= phrase + " " in _OPEN[mark]
    return False, begun


class _Pieces(dict):
    """What runs without a space say of their line."""

    def __missing__(self, piece: str) -> int:
        plain = _WORD.fullmatch(piece)
        if plain and plain[1].lower() not in _OPEN["term"] and plain[1].lower() not in _OPEN["road"]:
            found = 1 + len(plain[2])
        else:
            found = self._read(tokenize(piece))
        if len(piece) <= _LONG_PIECE:
            if len(self) >= _MOST_PIECES:
                self.clear()
            self[piece] = found
        return found

    def _read(self, tokens: list[Token]) -> int:
        found = sum(t.is_content for t in tokens)
        groups = [[lowered(t.text) for t in own] for content, own in itertools.groupby(tokens, lambda t: t.is_content) if content]
        if len(groups) > 1:  # white space of other kinds, behind which a term may go on
            found += _TERM + _ROAD
        for own in groups if len(groups) == 1 else ():
            whole, begun = _spelled(own, "term")
            found += _TERM * whole + _BEGUN * begun + _ROAD * any(_spelled(own, "road"))
        numbers = [i for i, t in enumerate(tokens) if t.kind in ("digit", "alnum")]
        found += _HOUSE * any(house_number_like(tokens[i].text) for i in numbers)
        return found + _POSTCODE * any(postcode_at(tokens, i, None) or i == len(tokens) - 1 and _OPENING.fullmatch(shape_string(tokens[i].text)) is not None for i in numbers)


_PIECES = _Pieces()


def _goes_on(line: str) -> bool:
    return any(w in line for w in _SECOND)


def _telling(text: str, rules: list[tuple[int, int]]) -> tuple[str, list[int], list[int]] | None:
    """(text, starts, moves): the text with long lines that can't matter cut short, and by how many bytes what begins at or after each of the starts has moved. None if all lines matter or can't be told apart."""
    if any(c in text for c in "\r\x85\u2028\u2029") or joins_spaces(text):
        return None
    lines, piece = text.split("\n"), _PIECES.__getitem__
    said = [sum(map(piece, line.split(" "))) for line in lines]
    starts = list(itertools.accumulate((len(line.encode()) + 1 for line in lines), initial=0))
    ruled, wanted = set(), set()
    for a, b in rules:
        first, last = bisect.bisect_right(starts, a) - 1, bisect.bisect_left(starts, b) - 1
        ruled.update(range(first, last + 1))
        wanted.update(range(first, last + 1) if last > first else ())
    mask = (1 << _FIELD) - 1
    sizes = [x & mask for x in said]
    short = [0 < n <= SHORT_LINE_TOKENS for n in sizes]
    for n, x in enumerate(said):
        place = x >= _POSTCODE or x & (mask * _HOUSE) and x & (mask * _ROAD)
        term = x & (mask * _TERM) or x & (mask * _BEGUN) and _goes_on(lowered(lines[n]))
        if term or place and n not in ruled or short[n] and (n and short[n - 1] or n + 1 < len(lines) and short[n + 1]):
            wanted |= {n, n + 1}
    kept: list[str] = []
    at, places, moves = 0, [], []
    dropped = False
    for n, line in enumerate(lines):
        if n not in wanted and sizes[n] > SHORT_LINE_TOKENS:
            if not dropped:
                kept.append(_DROPPED)
                at += len(_DROPPED) + 1
            dropped = True
            continue
        if dropped or not places:
            places.append(at)
            moves.append(starts[n] - at)
        kept.append(line)
        at += starts[n + 1] - starts[n]
        dropped = False
    return ("\n".join(kept), places, moves) if len(moves) != 1 or moves[0] or dropped else None


def _moved(rules: list[tuple[int, int]], places: list[int], moves: list[int], size: int) -> list[tuple[int, int]]:
    """rules, in order, as they lie in the shorter text; those of lines that went are left out."""
    found = []
    for k, (place, move) in enumerate(zip(places, moves, strict=True)):
        end = (places[k + 1] - len(_DROPPED) - 1 if k + 1 < len(places) else size) + move
        first = bisect.bisect_left(rules, (place + move, 0))
        for a, b in itertools.takewhile(lambda r, end=end: r[0] < end, itertools.islice(rules, first, None)):
            found.append((a - move, b - move))
    return found


def detect(text: str, rules: list[Entity], country: str | None = None) -> list[Entity]:
    """People, organizations and addresses that overlap no rule span and not each other: addresses first, then organizations."""
    spans = sorted((e.start, e.end) for e in rules)
    places, moves = [0], [0]
    if country is None and (less := _telling(text, spans)):
        text, places, moves = less
        spans = _moved(spans, places, moves, len(text.encode()) + 1) if places else []
    found = _detect(text, spans, country)
    back = lambda at: moves[bisect.bisect_right(places, at) - 1]
    return [e.moved(e.start + back(e.start), e.end + back(e.start)) for e in found]


def _detect(text: str, rules: list[tuple[int, int]], country: str | None) -> list[Entity]:
    doc = Document(text, country, rules)
    lines, taken, found = doc.lines(), list(rules), []
    for kind, spans in (("address", _addresses), ("org", _organizations), ("person", _people)):
        for first, last in spans(doc, lines):
            start, end = doc.span(first, last)
            if not any(start < b and a < end for a, b in taken):
                taken.append((start, end))
                found.append(Entity(kind, start, end, CONFIDENCE, "model"))
    return sorted(found, key=lambda e: (e.start, e.end))
