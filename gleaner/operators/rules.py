"""Emails and phones of whole texts, merged: emails win, link destinations win over what is scanned."""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.arrow import explode_structs, per_text
from gleaner.schema import ENTITY, Entity

from . import emails, phones, regions


def disjoint(rows: list[Entity], others: list[Entity]) -> list[Entity]:
    """rows that overlap none of others; both in order, others disjoint."""
    found, k = [], 0
    for e in rows:
        while k < len(others) and others[k].end <= e.start:
            k += 1
        if k == len(others) or others[k].start >= e.end:
            found.append(e)
    return found


def scan(text: str | None, hints: list[str] | None = None) -> tuple[list[str], list[Entity]]:
    """(regions used, entities in order): without hints, the regions that the text points to."""
    used = [h.upper() for h in hints] if hints else regions.infer(text)
    mails = emails.scan(text) if text and "@" in text else []
    numbers = sorted(phones.scan(text, used), key=lambda e: (e.start, e.end))
    return used, sorted(disjoint(numbers, mails) + mails, key=lambda e: (e.start, e.end))


def from_link(destination: str, start: int, end: int, hints: list[str]) -> Entity | None:
    """What a mailto: or tel: destination names, spanning the visible text of the link."""
    if start >= end:
        return None
    scheme, _, rest = destination.partition(":")
    plain = lambda s: re.sub("%40", "@", re.sub("%2[Bb]", "+", s.replace("%20", "")))
    if scheme.lower() == "mailto":
        found = emails.whole(plain(re.split("[?,]", rest)[0]))
    elif scheme.lower() == "tel":
        found = phones.whole(re.sub("[-.() ]", "", plain(rest.split(";")[0])), hints)
    else:
        return None
    return replace(found, start=start, end=end, confidence=min(found.confidence, 0.99)) if found else None


def merge_links(scanned: list[Entity], linked: list[Entity]) -> list[Entity]:
    """Links win over what they overlap, inner ones over outer ones."""
    kept: list[Entity] = []
    for e in sorted(linked, key=lambda e: (e.end - e.start, e.start)):
        if all(e.end <= k.start or k.end <= e.start for k in kept):
            kept.append(e)
    kept.sort(key=lambda e: e.start)
    return sorted(disjoint(sorted(scanned, key=lambda e: e.start), kept) + kept, key=lambda e: (e.start, e.end))


def with_rules(docs: DataFrame, keys: list[str], text_col: str = "text", hints: Column | list[str] | None = None) -> DataFrame:
    """(keys, entities): what rules find in each text. A text without a digit or an at sign isn't sent to Python.

    hints: regions for all rows, or a column of arrays of them; empty or null is none.
    """
    hint = hints if isinstance(hints, Column) else F.array(*map(F.lit, hints)) if hints else F.array().cast("array<string>")
    text = F.when(F.col(text_col).rlike("[0-9@]"), F.col(text_col))

    def of(text: str | None, hints: list[str] | None) -> list[dict]:
        if not text:
            return []
        data = text.encode()
        return [e.row(data) for e in scan(text, hints)[1]]

    return per_text(docs, [text, hint], of, f"array<{ENTITY}>", "entities", keys)


def rule_entities(docs: DataFrame, keys: list[str], text_col: str = "text", hints: Column | list[str] | None = None) -> DataFrame:
    """One row an entity, its fields as columns; rows without any are filtered before Python."""
    some = docs.where(F.col(text_col).rlike("[0-9@]"))
    return explode_structs(with_rules(some, keys, text_col, hints), "entities", keys)


def anti_overlap(rows: DataFrame, others: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """rows whose spans overlap none of others of the same keys: an interval anti-join, equi on the keys."""
    right = others.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(start).alias("__start"), F.col(end).alias("__end"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = (F.col(start) < F.col("__end")) & (F.col("__start") < F.col(end))
    for s in same:
        on = on & s
    return rows.join(right, on, "left_anti")


def semi_overlap(rows: DataFrame, others: DataFrame, keys: list[str], start: str = "start", end: str = "end", inside: bool = False) -> DataFrame:
    """rows whose spans overlap, or lie inside, one of others of the same keys."""
    right = others.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(start).alias("__start"), F.col(end).alias("__end"))
    on = (F.col("__start") <= F.col(start)) & (F.col(end) <= F.col("__end")) if inside else (F.col(start) < F.col("__end")) & (F.col("__start") < F.col(end))
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return rows.join(right, on, "left_semi")
