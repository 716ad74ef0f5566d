"""Lines of a text by kind, and the blocks that they form."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.arrow import explode_structs, per_text
from gleaner.functions import text as texts
from gleaner.functions.offsets import byte_offsets

#: Fixed values.
SHORT_CHARS, SIGNATURE_LINES = 64, 2
HEADERS = ("From:", "Sent:", "To:", "Cc:", "Subject:", "Date:")
CLOSINGS = (
    "best", "best regards", "kind regards", "regards", "warm regards", "best wishes", "all the best", "thanks", "thank you", "many thanks", "cheers", "sincerely", "yours sincerely",
    "yours faithfully", "yours truly", "mit freundlichen grüßen", "viele grüße", "beste grüße", "freundliche grüße", "met vriendelijke groet", "პატივისცემით", "よろしくお願いいたします", "敬具",
)

SEPARATOR_LINE = r"^[-_=* ]{3,}$"
CHAT_LINE = r"^(?:\[[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\]|[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?) "
HEADER_LINE = "^(?:" + "|".join(HEADERS) + ")|^On .*wrote:$"


def kind(raw: Column) -> Column:
    """The kind of a line; the first that fits of blank, separator, quoted_blank, quoted, chat_turn, table_row, header, closing, text."""
    line = texts.trim(raw)
    rest = texts.trim(F.substr(line, F.lit(2)))
    many = lambda c, sign: F.length(c) - F.length(F.replace(c, F.lit(sign), F.lit(""))) >= 2
    closing = F.lower(texts.trim(F.regexp_replace(line, "[,.!]+$", "")))
    return (
        F.when(line == "", "blank")
        .when(line.rlike(SEPARATOR_LINE), "separator")
        .when(line.startswith(">") & (rest == ""), "quoted_blank")
        .when(line.startswith(">"), "quoted")
        .when(line.rlike(CHAT_LINE), "chat_turn")
        .when(many(line, "|") | many(raw, "\t"), "table_row")
        .when(line.rlike(HEADER_LINE), "header")
        .when(closing.isin(list(CLOSINGS)), "closing")
        .otherwise("text")
    )


def classified(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row a line: (keys, line_no from 0, line, kind), natively."""
    split = docs.select(*keys, F.posexplode(texts.lines(F.col(text_col))).alias("line_no", "line"))
    return split.withColumn("kind", kind(F.col("line")))


@dataclass
class Line:
    start: int
    end: int
    kind: str
    chars: int


@dataclass
class Block:
    kind: str
    lines: list[Line]
    short_lines: bool
    gap_lines: int

    @property
    def start(self) -> int:
        return self.lines[0].start

    @property
    def end(self) -> int:
        return self.lines[-1].end


_BREAK = re.compile("\r\n|[\n\r\x85\u2028\u2029]")
_SEPARATOR, _CHAT, _HEADER = re.compile(SEPARATOR_LINE), re.compile(CHAT_LINE), re.compile(HEADER_LINE)


def _kind(raw: str) -> tuple[str, int]:
    line = raw.strip()
    if not line:
        return "blank", 0
    if _SEPARATOR.search(line):
        found = "separator"
    elif line[0] == ">":
        found = "quoted" if line[1:].strip() else "quoted_blank"
    elif _CHAT.search(line):
        found = "chat_turn"
    elif line.count("|") >= 2 or raw.count("\t") >= 2:
        found = "table_row"
    elif _HEADER.search(line):
        found = "header"
    else:
        found = "closing" if line.rstrip(",.!").rstrip().lower() in CLOSINGS else "text"
    return found, len(line)


def split_lines(text: str) -> list[Line]:
    places, at, found = byte_offsets(text), 0, []
    for m in [*_BREAK.finditer(text), None]:
        end = m.start() if m else len(text)
        if m or end > at:
            found.append(Line(places[at], places[end], *_kind(text[at:end])))
        at = m.end() if m else end
    return found


#: Kinds of lines that go on in the block before them, by that block's kind.
_JOINS = {"header": {"header"}, "quoted": {"quoted_reply"}, "text": {"paragraph", "chat_turn"}, "closing": {"paragraph", "chat_turn"}}
_OPENS = {"header": "header", "quoted": "quoted_reply", "chat_turn": "chat_turn", "table_row": "table_row", "separator": "separator"}
_CONTENT = {"text", "quoted", "chat_turn", "header"}


def split_blocks(text: str) -> list[Block]:
    """The blocks of a text: blank lines end one, separators and table rows are their own, headers, quotes and a chat turn with what follows keep together.

    A paragraph of two or more short lines, sign-offs not counted, is a signature.
    """
    runs: list[tuple[str, list[Line], int]] = []
    is_open, gap = False, 0
    for line in split_lines(text):
        if line.kind in ("blank", "quoted_blank"):
            is_open, gap = False, gap + 1
            continue
        if is_open and runs[-1][0] in _JOINS.get(line.kind, ()):
            runs[-1][1].append(line)
            continue
        runs.append((_OPENS.get(line.kind, "paragraph"), [line], gap))
        is_open, gap = line.kind not in ("separator", "table_row"), 0
    blocks = []
    for name, lines, before in runs:
        content = [x for x in lines if x.kind in _CONTENT]
        short = len(content) >= SIGNATURE_LINES and all(x.chars <= SHORT_CHARS for x in content)
        blocks.append(Block("signature" if short and name == "paragraph" else name, lines, short, before))
    return blocks


BLOCK = "struct<kind:string,start:int,end:int,n_lines:int,short_lines:boolean,gap_lines:int>"


def blocks(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """One row a block: (keys, block_no, kind, start, end, n_lines, short_lines, gap_lines)."""

    def of(text: str | None) -> list[dict]:
        return [{"kind": b.kind, "start": b.start, "end": b.end, "n_lines": len(b.lines), "short_lines": b.short_lines, "gap_lines": b.gap_lines} for b in split_blocks(text or "")]

    return explode_structs(per_text(docs, [F.col(text_col)], of, f"array<{BLOCK}>", "blocks", keys), "blocks", keys, "block_no")
