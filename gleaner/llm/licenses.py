"""License scans: marked-up templates compiled to token automata.

A template is wording with two kinds of markup. ``[[ ... ]]`` may be absent (and may hold
more markup), ``{{name:n}}`` stands for up to n words of any kind, and ``a|b`` for either
word. A text matches where its words follow all of the rest exactly.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, text_batches

#: Phrases whose places count as base ones, and their labels.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))

#: The wording of licenses, in the words that texts are read as.
_AS_IS = """
the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of
merchantability fitness for a particular purpose and [[ non infringement ]] [[ noninfringement ]] in no event shall the authors [[ or copyright holders ]] be liable for
any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the
software or the use or other dealings in the software
"""
_MIT = f"""
permission is hereby granted free of charge to any person obtaining a copy of this software [[ and associated documentation files ]] [[ the software ]]
to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute
sublicense [[ and ]] [[ or ]] sell copies of the software and to permit persons to whom the software is furnished to do so subject to the
following conditions the above copyright notice [[ and this permission notice ]] [[ including the next paragraph ]] shall be included in all copies or substantial
portions of the software {_AS_IS}
"""
_ISC = """
permission to use copy modify and [[ or ]] distribute this software for any purpose with or without fee is hereby granted provided that the above
copyright notice and this permission notice appear in all copies the software is provided as is and the {{who:4}} disclaims all
warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the
{{who:4}} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data
or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or
performance of this software
"""
_BSD = """
redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
[[ 1 ]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
[[ 2 ]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the
documentation and or other materials provided with the distribution
"""
_NAMES = """
[[ 3 ]] neither the name of {{owner:12}} nor the names of its|{{people:1}} contributors may be used to endorse or promote products derived from this
software without specific prior written permission
"""
_DISCLAIMED = """
this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not
limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the
copyright holder|owner|holders or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but
not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and
on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of
the use of this software even if advised of the possibility of such damage
"""
_ZLIB = """
this software is provided as is without any express or implied warranty in no event will the authors|author be held liable for any damages
arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial
applications and to alter it and redistribute it freely subject to the following restrictions [[ 1 ]] the origin of this software must
not be misrepresented you must not claim that you wrote the original software if you use this software in a product an
acknowledgment|acknowledgement in the product documentation would be appreciated but is not required [[ 2 ]] altered source versions must be plainly marked
as such and must not be misrepresented as being the original software [[ 3 ]] this notice may not be removed or altered from any
source distribution
"""
_UNLICENSE = f"""
this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or
distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any
means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our
heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law {_AS_IS}
"""
_APACHE = """
licensed under the apache license version 2 0 [[ the license ]] you may not use {{work:4}} except in compliance with the license you may obtain
a copy of the license at http|https www apache org licenses license 2 0 [[ txt ]] [[ html ]] unless required by applicable law or agreed to in writing software
distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied
see the license for the specific language governing permissions and limitations under the license
"""
_GPL = """
is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the
free software foundation either version {version} of the license or at your option any later version {{{{program:4}}}} is distributed in the
hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a
particular purpose see the gnu general public license for more details
"""

_WORK = "[[ this|the {{work:4}} is|are ]]"
_UNDER = "released|licensed|distributed|available|provided|published under"
_PUBLISHED = "[[ the terms of ]] the gnu general public license [[ as published by {{who:6}} ]] [[ either ]]"
_LATER = "[[ of the license ]] [[ or [[ at your option ]] any later version ]]"

#: How much a place says: all the wording of a license (or, of long licenses, of the notice that they tell authors to use), a sentence that names one, or a base phrase.
WORDING, NOTICE, BASE = 1.0, 0.75, 0.5
#: (label, what a match says, template); a label may have several.
TEMPLATES = (
    ("mit", WORDING, _MIT),
    ("mit", NOTICE, f"{_WORK} {_UNDER} [[ the terms of ]] the mit license"),
    ("isc", WORDING, _ISC),
    ("bsd-2-clause", WORDING, f"{_BSD} {_DISCLAIMED}"),
    ("bsd-3-clause", WORDING, f"{_BSD} {_NAMES} {_DISCLAIMED}"),
    ("zlib", WORDING, _ZLIB),
    ("public-domain", WORDING, _UNLICENSE),
    ("public-domain", NOTICE, f"{_WORK} free and unencumbered software released into the public domain"),
    ("apache-2", WORDING, _APACHE),
    ("apache-2", NOTICE, f"{_WORK} licensed under the apache license version 2 [[ 0 ]] [[ the license ]]"),
    ("gpl-3", WORDING, _GPL.format(version=3)),
    ("gpl-3", NOTICE, f"{_WORK} {_UNDER} {_PUBLISHED} version 3 {_LATER}"),
    ("gpl-2", WORDING, _GPL.format(version=2)),
    ("gpl-2", NOTICE, f"{_WORK} {_UNDER} {_PUBLISHED} version 2 {_LATER}"),
    ("cc-by-nc-4", NOTICE, f"{_WORK} {_UNDER} [[ a|the ]] [[ creative commons ]] cc by nc 4 0 [[ international ]] [[ license ]]"),
    ("cc-by-4", NOTICE, f"{_WORK} {_UNDER} [[ a|the ]] [[ creative commons ]] cc by 4 0 [[ international ]] [[ license ]]"),
    ("cc-by-nc-4", NOTICE, f"{_WORK} {_UNDER} a|the creative commons attribution noncommercial 4 0 [[ international ]] [[ public ]] license"),
)

_MARK = re.compile(r"\[\[|\]\]|\{\{\w+:\d+\}\}(?:\|\S+)*|[^\s\[\]]+")


def parse(template: str) -> list:
    """Nested list of the template's parts: a frozenset of words, an int (so many words of any kind), a list (optional)."""
    stack: list[list] = [[]]
    for mark in _MARK.findall(template):
        if mark == "[[":
            stack.append([])
        elif mark == "]]":
            inner = stack.pop()
            stack[-1].append(inner)
        elif mark.startswith("{{"):
            stack[-1].append(int(mark.split(":")[1].split("}")[0]))
        elif "{{" in mark:  # a word or whatever: one word of any kind
            stack[-1].append([1])
        else:
            stack[-1].append(frozenset(w.encode() for w in mark.split("|")))
    if len(stack) != 1:
        raise ValueError(f"optional regions don't close: {template[:60]}")
    return stack[0]


class Automaton:
    """A template as a deterministic automaton over words, its states made as texts need them."""

    def __init__(self, template: str):
        self.steps: list[list[tuple[frozenset[bytes] | None, int]]] = [[]]
        self.free: list[list[int]] = [[]]
        self.end = self._build(parse(template), 0)
        self.words = frozenset(w for out in self.steps for s, _ in out if s for w in s)
        self.start = self._closure({0})
        self.made: dict[frozenset[int], dict[bytes | None, frozenset[int]]] = {}

    def _state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def _build(self, parts: list, at: int) -> int:
        for part in parts:
            if isinstance(part, list):
                inner = self._state()
                self.free[at].append(inner)
                end, after = self._build(part, inner), self._state()
                self.free[end].append(after)
                self.free[at].append(after)
                at = after
            elif isinstance(part, int):
                after = self._state()
                self.free[at].append(after)
                for _ in range(part):
                    nxt = self._state()
                    self.steps[at].append((None, nxt))
                    self.free[nxt].append(after)
                    at = nxt
                at = after
            else:
                nxt = self._state()
                self.steps[at].append((part, nxt))
                at = nxt
        return at

    def _closure(self, states: set[int]) -> frozenset[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return frozenset(states)

    def first_words(self) -> set[bytes]:
        """The words that a match begins with; a template may not begin with words of any kind."""
        found: set[bytes] = set()
        for s in self.start:
            for words, _ in self.steps[s]:
                if words is None:
                    raise ValueError("a template can't begin with replaceable words")
                found |= words
        return found

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest match that begins at a word, or -1."""
        states, best = self.start, -1
        for i in range(at, len(words)):
            word = words[i] if words[i] in self.words else None
            row = self.made.setdefault(states, {})
            if word not in row:
                row[word] = self._closure({t for s in states for accepted, t in self.steps[s] if accepted is None or word in accepted})
            states = row[word]
            if not states:
                break
            if self.end in states:
                best = i + 1
        return best


_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """Words of a UTF-8 text: A-Z in lower case, runs of letters and digits of ASCII and of all that is beyond it."""
    return text.translate(_TABLE).split() if text else []


@dataclass(frozen=True)
class Scanner:
    phrases: tuple[tuple[str, str], ...] = PHRASES
    templates: tuple[tuple[str, float, str], ...] = TEMPLATES

    @functools.cached_property
    def compiled(self):
        starts: dict[bytes, list[tuple[float, str, Automaton | list[bytes]]]] = {}
        for label, says, template in self.templates:
            automaton = Automaton(template)
            for w in automaton.first_words():
                starts.setdefault(w, []).append((says, label, automaton))
        for phrase, label in self.phrases:
            words = phrase.encode().split()
            starts.setdefault(words[0], []).append((BASE, label, words))
        return starts

    def scan(self, text: bytes | None) -> tuple[int, list[tuple[str, float, int, int]]]:
        """(number of words, places): a place is (label, what it says, first word, word after it)."""
        words, starts = tokens(text), self.compiled
        places, upto = [], {}
        if not starts.keys().isdisjoint(words):
            for i, w in enumerate(words):
                for says, label, what in starts.get(w, ()):
                    if isinstance(what, list):
                        if words[i : i + len(what)] == what:
                            places.append((label, says, i, i + len(what)))
                    elif i >= upto.get(id(what), 0) and (end := what.match(words, i)) > i:
                        places.append((label, says, i, end))
                        upto[id(what)] = end
        return len(words), places


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("places", pa.list_(pa.struct([("label", pa.string()), ("says", pa.float64()), ("start", pa.int64()), ("end", pa.int64())])))])


@functools.lru_cache(maxsize=4)
def _scanner(phrases, templates) -> Scanner:
    return Scanner(phrases, templates)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases=PHRASES, templates=TEMPLATES) -> DataFrame:
    """Places of license wording in every whole text: (doc_id, n_words, places).

    places: array of (label, says, start, end), in words from 0: all places of the base
    phrases (says 0.5), overlapping ones too, and for each template its longest matches from left to
    right (1 for the whole wording of a license, 0.75 for a sentence that names one). Null and empty texts have no words and no places; repeated rows are each
    scanned; ids may be null; an empty table gives no rows; other columns are not read.
    """
    text_batches(docs.sparkSession)
    phrases, templates = tuple(map(tuple, phrases)), tuple(map(tuple, templates))

    def run(batches):
        scanner = _scanner(phrases, templates)
        for b in slices(batches):
            found = [scanner.scan(t) for t in as_bytes(b.column(1))]
            places = [[{"label": x, "says": k, "start": s, "end": e} for x, k, s, e in p] for _, p in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in found], pa.int64()), pa.array(places, _FOUND.field(2).type)], schema=_FOUND)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_words long, places array<struct<label:string,says:double,start:bigint,end:bigint>>")


def report(found: DataFrame) -> DataFrame:
    """A digest of scan(): counts and ends of base places, labels, and as a score the most that a place says, 0 without any."""
    base = F.filter("places", lambda p: p["says"] == BASE)
    listed = lambda c: F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda p: p["label"]))), ",")
    starts = F.transform(base, lambda p: p["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["says"])), F.lit(0.0)).alias("score"),
    )


def regex(template: str) -> str:
    """The template as a regular expression over words that each have a space before them, with one after all."""

    def of(parts: list) -> str:
        found = ""
        for part in parts:
            if isinstance(part, list):
                found += f"(?:{of(part)})?"
            elif isinstance(part, int):
                found += f"(?: [^ ]+){{0,{part}}}"
            else:
                words = "|".join(sorted(w.decode() for w in part))
                found += f" (?:{words})" if len(part) > 1 else f" {words}"
        return found

    return of(parse(template)) + " "


def oracle(phrases=PHRASES, templates=TEMPLATES) -> str:
    """DuckDB SQL of the report over documents; templates are regular expressions there."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

    def at(phrase: str) -> str:
        parts = phrase.split()
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(parts))
        return f"list_filter(range(1, len(words) + 1), lambda i: {same})"

    places = ", ".join(f"{at(p)} AS p{k}" for k, (p, _) in enumerate(phrases))
    every = "list_concat(" * (len(phrases) - 1) + "p0" + "".join(f", p{k})" for k in range(1, len(phrases)))
    base = ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (_, label) in enumerate(phrases))
    own = ", ".join(f"CASE WHEN regexp_matches(line, '{regex(t)}') THEN {{'label': '{label}', 'says': CAST({says} AS DOUBLE)}} END" for label, says, t in templates)
    join = "coalesce(array_to_string(list_sort(list_distinct(list_filter({}, lambda x: x IS NOT NULL))), ','), '')"
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
p AS (SELECT doc_id, words, ' ' || array_to_string(words, ' ') || ' ' AS line, {places} FROM w),
q AS (SELECT doc_id, words, {every} AS places, [{base}] AS base, list_filter([{own}], lambda x: x IS NOT NULL) AS own FROM p)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(places) AS BIGINT) AS n_base,
  CAST(list_min(places) - 1 AS BIGINT) AS first_word, CAST(list_max(places) - 1 AS BIGINT) AS last_word,
  {join.format("base")} AS base_labels, {join.format("list_concat(base, list_transform(own, lambda x: x.label))")} AS labels,
  greatest(coalesce(list_max(list_transform(own, lambda x: x.says)), 0), CASE WHEN len(places) > 0 THEN {BASE} ELSE 0 END) AS score
FROM q
"""
