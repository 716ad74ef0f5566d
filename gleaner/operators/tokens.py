"""The tokenizer: lossless, Unicode-aware, byte offsets. Characters become class letters, and one pattern over those finds tokens."""

from __future__ import annotations

import re
from collections import Counter
from typing import NamedTuple

import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.arrow import rows_of_texts
from gleaner.functions.offsets import byte_offsets
from gleaner.functions.unicode import COMBINING_RANGES, INVISIBLE, SCRIPTS, SPACES, classify
from gleaner.tables import spread

_LETTER = {
    "newline": "n", "space": "s", "digit": "d", "wide_digit": "e", "arabic_digit": "f", "combining": "c", "punct": "p", "other": "o",
    "latin": "L", "cyrillic": "C", "greek": "G", "georgian": "K", "arabic": "A", "hebrew": "W", "han": "H", "hiragana": "R", "katakana": "T", "hangul": "U", "thai": "I", "devanagari": "D",
}
_SCRIPT = {letter: name for name, letter in _LETTER.items() if name in SCRIPTS[:-1]}


class _Classes(dict):
    def __missing__(self, code: int) -> str:
        self[code] = found = _LETTER[classify(code)]
        return found


#: Carriage returns, joiners and points have letters of their own.
_CLASSES = _Classes({13: "r", 39: "j", 0x2019: "j", 45: "j", 46: "t"})
#: Joiners that join nothing: before a possessive s, and hyphens before capitals.
_NO_JOINER = regex.compile(r"['’](?=s(?!\p{Alphabetic}|\p{N}))|-(?=\p{Uppercase})")


def _words() -> str:
    mixed = "|".join(f"{x}(?:[{x}c]|j(?={x}))*(?P<{x}1>d[d{x}c]*)?" for x in "LCG")
    plain = "|".join(f"{x}(?:[{x}c]|j(?={x}))*" for x in "KAWRTUID")
    number = "|".join(f"(?P<{x}2>{x}[d{x}c]*)" for x in "LCG")
    return f"{mixed}|{plain}|Hc*(?:j(?=H))?|d(?:[dc]|t(?=d))*(?:{number})?|e[ec]*|f[fc]*"


_TOKEN = re.compile(rf"rn|[rn]|s[sc]*|o[oc]*|c[co]*|(?:{_words()})|[pjt]c*")


class Token(NamedTuple):
    start: int
    end: int
    kind: str
    script: str
    text: str

    @property
    def is_content(self) -> bool:
        return self.kind not in ("space", "newline")


_KINDS = {"n": "newline", "r": "newline", "s": "space", "p": "punct", "j": "punct", "t": "punct", "o": "other", "c": "other", "e": "digit", "f": "digit"}


def tokenize(text: str) -> list[Token]:
    """Tokens that cover every byte: words of one script, digits, both together, single punctuation marks, spaces, line breaks."""
    classes = text.translate(_CLASSES)
    if "j" in classes:
        marked = list(classes)
        for m in _NO_JOINER.finditer(text):
            marked[m.start()] = "p"
        classes = "".join(marked)
    places, found = byte_offsets(text), []
    for m in _TOKEN.finditer(classes):
        a, b = m.span()
        first, script = classes[a], "other"
        if first in _SCRIPT:
            script, kind = _SCRIPT[first], "alnum" if first in "LCG" and m[f"{first}1"] else "alpha"
        elif first == "d":
            after = next((x for x in "LCG" if m[f"{x}2"]), None)
            kind, script = ("alnum", _SCRIPT[after]) if after else ("digit", "other")
        else:
            kind = _KINDS[first]
        found.append(Token(places[a], places[b], kind, script, text[a:b]))
    return found


_JOINED = f"[{re.escape(SPACES.replace(' ', ''))}{re.escape(INVISIBLE)}{''.join(f'{chr(a)}-{chr(b)}' for a, b in COMBINING_RANGES)}]"
_JOINING = re.compile(_JOINED)
_BESIDE_SPACE = re.compile(f" {_JOINED}|{_JOINED} ")


def joins_spaces(text: str) -> bool:
    """Whether a token may hold both a space (U+0020) and another character: if not, runs between spaces and line feeds have the tokens that they have alone."""
    return bool(_JOINING.search(text)) and bool(_BESIDE_SPACE.search(text))


def normalise(text: str) -> str:
    """Lower case, without punctuation, tokens joined by one space."""
    return " ".join(t.text.lower() for t in tokenize(text) if t.is_content and t.kind != "punct")


def tokens(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row a token: (keys, pos, start, end, class, script)."""

    def of(text: str | None) -> tuple[list, ...]:
        found = tokenize(text or "")
        return [t.start for t in found], [t.end for t in found], [t.kind for t in found], [t.script for t in found]

    return rows_of_texts(docs, [F.col(text_col)], of, "start int, end int, class string, script string", keys, "pos")


COUNTS = "class string, script string, n bigint, bytes bigint"
_MARKS, _LATIN = ".,;:!?%$&", re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_FLUSH, _MEMO, _LONG, _CHARS = 50_000, 100_000, 64, 8 << 20


class _Counting:
    """Tokens of many texts by class and script. Runs without a space are counted first, and what tokens a run has is worked out once while it is remembered."""

    def __init__(self):
        self.n: Counter = Counter()
        self.bytes: Counter = Counter()
        self.pieces: Counter = Counter()
        self.memo: dict[str, tuple] = {}
        self.chars = 0

    def _put(self, kind: tuple[str, str], n: int, size: int) -> None:
        if n:
            self.n[kind] += n
            self.bytes[kind] += size

    def add(self, text: str) -> None:
        if "\r" in text or joins_spaces(text):
            for t in tokenize(text):
                self._put((t.kind, t.script), 1, t.end - t.start)
            return
        lines, spaces, runs = text.split("\n"), 0, 0
        for line in lines:
            parts = line.split(" ")
            gaps = len(parts) - 1
            if not gaps and len(line) > _LONG:
                self._tokens_of(line, 1)
                continue
            self.pieces.update(parts)
            if gaps:  # spaces side by side are one token
                spaces += gaps
                runs += gaps - (parts.count("") - (not parts[0]) - (not parts[-1]) if "  " in line else 0)
        self._put(("space", "other"), runs, spaces)
        self._put(("newline", "other"), len(lines) - 1, len(lines) - 1)
        self.chars += len(text)
        if len(self.pieces) > _FLUSH or self.chars > _CHARS:
            self.flush()

    def _tokens_of(self, piece: str, times: int) -> None:
        found = self.memo.get(piece)
        if found is None:
            own: dict[tuple[str, str], list[int]] = {}
            for t in tokenize(piece):
                sums = own.setdefault((t.kind, t.script), [0, 0])
                sums[0] += 1
                sums[1] += t.end - t.start
            found = tuple((kind, n, size) for kind, (n, size) in own.items())
            if len(piece) <= _LONG:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[piece] = found
        for kind, n, size in found:
            self._put(kind, n * times, size * times)

    def flush(self) -> None:
        self.pieces.pop("", None)
        words = size = marks = 0
        for piece, times in self.pieces.items():
            word = piece.rstrip(_MARKS)
            if word.isalpha() and (word.isascii() or _LATIN.fullmatch(word)):  # most are a word, maybe with marks after it
                words += times
                size += times * (len(word) if word.isascii() else len(word.encode()))
                marks += times * (len(piece) - len(word))
            else:
                self._tokens_of(piece, times)
        self._put(("alpha", "latin"), words, size)
        self._put(("punct", "other"), marks, marks)
        self.pieces.clear()
        self.chars = 0


def _counted(docs: DataFrame, text_col: str) -> DataFrame:
    """(class, script, n, bytes) of each task's texts; a row without a class has how many texts aren't null."""

    def run(batches):
        import pyarrow as pa

        work, texts = _Counting(), 0
        for whole in batches:
            for s in range(0, whole.num_rows, 512):  # few texts are Python strings at a time
                for text in whole.column(0).slice(s, 512).to_pylist():
                    texts += text is not None
                    if text:
                        work.add(text)
        work.flush()
        rows = [(*kind, n, work.bytes[kind]) for kind, n in work.n.items()] + [(None, None, texts, 0)]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["class", "script", "n", "bytes"])

    return spread(docs.select(text_col)).mapInArrow(run, COUNTS)


def counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(class, script, n, bytes): tokens of all texts, counted in the tasks that read them; null and empty texts have none."""
    rows = _counted(docs, text_col).where("class is not null")
    return rows.groupBy("class", "script").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def covered(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(bytes, docs): bytes of the tokens of all texts, null without a text, and how many texts there are, from one reading."""
    rows = _counted(docs, text_col)
    docs_read = F.coalesce(F.sum(F.when(F.col("class").isNull(), F.col("n"))), F.lit(0))
    return rows.agg(F.when(docs_read > 0, F.sum("bytes")).alias("bytes"), docs_read.alias("docs"))


def dominant_script(rows: DataFrame, keys: list[str], first_seen: bool = False) -> DataFrame:
    """(keys, script): of most letter tokens, Han and kana counting as japanese; ties to the smaller name, or to the script that is seen first."""
    name = F.when(F.col("script").isin("han", "hiragana", "katakana"), "japanese").otherwise(F.col("script"))
    counted = rows.where(F.col("class").isin("alpha", "alnum")).groupBy(*keys, name.alias("script")).agg(F.count("*").alias("n"), F.min("start").alias("at"))
    tie = ["at", "script"] if first_seen else ["script"]
    return counted.groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("n"), *tie)).alias("best")).select(*keys, "best.script")


def too_long(tokens: list[Token], most: int = 4096) -> bool:
    """Whether a run without white space has more tokens than ``most``."""
    n = 0
    for t in tokens:
        n = n + 1 if t.is_content else 0
        if n > most:
            return True
    return False


def limits(text: Column) -> Column:
    """Whether a text is short enough for an address: 8 KiB."""
    return F.octet_length(text) <= 8192
