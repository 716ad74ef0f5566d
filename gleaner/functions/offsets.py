"""Offsets are UTF-8 bytes, end exclusive; Spark's string functions count characters."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The part of text between byte offsets."""
    return F.decode(F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (end - start).cast("int")), "UTF-8")


def utf16_offset(text: Column, at: Column) -> Column:
    """A byte offset in UTF-16 code units, as JavaScript counts."""
    return (F.octet_length(F.encode(byte_slice(text, F.lit(0), at), "UTF-16BE")) / 2).cast("int")


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, text>> of a pattern's matches, with byte offsets."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    size = lambda c: F.octet_length(c.cast("binary"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(s: Column, pair: Column) -> Column:
        first = s["at"] + size(pair["gap"])
        last = first + size(pair["text"])
        return F.struct(last.alias("at"), F.concat(s["out"], F.array(F.struct(first.alias("start"), last.alias("end"), pair["text"].alias("text")))).alias("out"))

    pairs = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda gap, text: F.struct(gap.alias("gap"), text.alias("text")))
    return F.aggregate(pairs, start, step)["out"]


def byte_offsets(text: str) -> list[int] | range:
    """The byte offset of each character, and of the end."""
    if text.isascii():
        return range(len(text) + 1)
    if len(text) > 64:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        found = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000), out=found[1:])
        return found.tolist()
    return list(itertools.accumulate((1 if c < "\x80" else 2 if c < "ࠀ" else 3 if c < "\U00010000" else 4 for c in text), initial=0))


def utf16_offsets(text: str, offsets: list[int]) -> list[int]:
    """Byte offsets in UTF-16 code units, all from one walk."""
    place = {at: i for i, at in enumerate(byte_offsets(text))}
    units = list(itertools.accumulate((1 if c < "\U00010000" else 2 for c in text), initial=0))
    return [units[place[at]] for at in offsets]
