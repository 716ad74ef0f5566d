import re

import duckdb
import pandas as pd
import pytest

from gleaner.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = "This software is released under the MIT License."
GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
WHOLE = GRANT + """

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
and/or other materials provided with the distribution.
%s
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE
LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE
GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT
LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH
DAMAGE."""
NAMES = "3. Neither the name of Some Great Company, Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy
of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES
OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public
License for more details."""
TEXTS = [
    (1, None), (2, ""), (3, "no wording"), (4, MIT), (4, MIT), (5, "under the mit license under the MIT license"), (6, GRANT), (7, GRANT.replace("free of charge", "for a fee")),
    (8, "Licensed under the Apache License, Version 2.0"), (9, "The code is licensed under the Apache License, Version 2.0 (the License)"), (10, "CC-BY-NC 4.0"), (11, "é under\x0bthe mit\x00license ü"),
    (12, "under the mit " * 2000), (None, "This work is licensed under a CC BY-NC 4.0 International License"), (13, "GNU"), (15, WHOLE), (16, BSD % ""), (17, BSD % NAMES), (18, APACHE), (19, GPL), (20, WHOLE.replace("EXPRESS OR IMPLIED", "EXPRESS")), (14, "This program is available under the terms of the GNU General Public License as published by the FSF, either version 3 of the License, or (at your option) any later version"),
]


def base(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [(i, label) for phrase, label in lic.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]


def test_report_matches_definition_and_oracle(spark, docs):
    found = lic.report(lic.scan(docs(TEXTS))).collect()
    assert len(found) == len(TEXTS)
    for r, (i, text) in zip(found, TEXTS):
        words, places = base(text)
        assert r["doc_id"] == i and r["n_words"] == len(words) and r["n_base"] == len(places)
        assert r["first_word"] == min((p for p, _ in places), default=None) and r["last_word"] == max((p for p, _ in places), default=None)
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(TEXTS, columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    rows = con.sql(lic.oracle()).fetchall()
    key = lambda t: tuple((x is None, str(x)) for x in t)
    assert sorted(map(tuple, found), key=key) == sorted(rows, key=key)


def said(text):
    """The most that places of each label say, base phrases apart."""
    found = {}
    for label, says, *_ in lic.Scanner().scan(text.encode())[1]:
        if says != lic.BASE:
            found[label] = max(says, found.get(label, 0))
    return found


@pytest.mark.parametrize("text, label", [(WHOLE, "mit"), (BSD % "", "bsd-2-clause"), (BSD % NAMES, "bsd-3-clause"), (APACHE, "apache-2"), (GPL, "gpl-3")])
def test_whole_wordings_match_and_no_mandatory_word_may_go(text, label):
    assert said("Copyright (c) 2020 Somebody\n\n" + text + "\n\nint main() {}") == {label: lic.WORDING}
    words = text.split()
    for i in range(0, len(words), 17):
        gone = said(" ".join(words[:i] + ["otherwise"] + words[i:]))
        assert gone.get(label) != lic.WORDING or i == 0 or label == "gpl-3" and "program" in " ".join(words[i - 4 : i + 4]).lower()


def test_templates_accept_optional_and_replaceable_parts_only():
    assert said(WHOLE.replace(" and associated documentation files", "")) == {"mit": lic.WORDING}
    assert said(GRANT) == said(WHOLE.replace("free of charge", "for a fee")) == {}
    assert said("This program is available under the terms of the GNU General Public License as published by the FSF, either version 3 of the License") == {"gpl-3": lic.NOTICE}
    assert said("This work is licensed under a Creative Commons CC BY 4.0 license") == {"cc-by-4": lic.NOTICE}


def test_automaton_takes_the_longest_match():
    a = lic.Automaton("a [[ b [[ c ]] ]] {{x:2}} d|e")
    assert a.match(b"a b c 1 2 d".split(), 0) == 6
    assert a.match(b"a d e".split(), 0) == 3
    assert a.match(b"a 1 2 3 d".split(), 0) == -1
    assert a.first_words() == {b"a"}
    with pytest.raises(ValueError):
        lic.Automaton("{{x:2}} a").first_words()
    with pytest.raises(ValueError):
        lic.parse("a [[ b")


def test_empty_table(docs):
    assert lic.scan(docs([])).count() == 0
