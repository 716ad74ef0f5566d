"""Synthetic documents: templates with slots, filled from pools by hashed draws, spans measured while the text is built."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.arrow import per_text
from gleaner.functions import text as texts
from gleaner.functions.hashing import fnv1a
from gleaner.tables import written

from . import leakage
from .augment import Draw
from .tokens import tokenize

#: Slots, and the kind of span that each makes; none is text alone.
SLOTS = {"person": "person", "person_first": None, "person_last": None, "org": "org", "address": "address", "email": "email", "phone": "phone", "city": None, "date": None, "number": None, "word": None}
FORMS = {"plain": str, "upper": str.upper, "lower": str.lower, "title": str.title}
#: Categories of documents and their weights.
CATEGORIES = {"no_person_with_address": 1, "no_address_with_person": 1, "nothing": 1, "both": 3}

_SLOT = re.compile(r"\{([^{}]*)\}")


@dataclass(frozen=True)
class Slot:
    name: str
    form: str
    group: int


def parse(template: str) -> list[str | Slot]:
    """Text and slots of {slot}, {slot#n}, {slot:form} or {slot:form#n}; anything else in braces is an error."""
    out: list[str | Slot] = []
    at = 0
    for m in _SLOT.finditer(template):
        body, _, group = m[1].partition("#")
        name, _, form = body.partition(":")
        if name not in SLOTS or (form or "plain") not in FORMS or group and not group.isdigit() or "#" in m[1] and not group:
            raise ValueError(f"unknown slot {m[0]} in {template!r}")
        out += [template[at : m.start()], Slot(name, form or "plain", int(group or 0))]
        at = m.end()
    if "{" in template[at:] or "}" in re.sub(_SLOT, "", template):
        raise ValueError(f"unclosed slot in {template!r}")
    return [x for x in [*out, template[at:]] if x != ""]


def render(template: str, pools: dict[str, list[str]], draw: Draw) -> tuple[str, list[tuple[str, int, int]]]:
    """(text, spans in bytes). Slots of one group share their person or value; an email of a group spells the group's person."""
    bound: dict[tuple[str, int], str] = {}

    def value(slot: Slot) -> str:
        base = "person" if slot.name.startswith("person") else slot.name
        key = (base, slot.group)
        if slot.group and key in bound:
            found = bound[key]
        elif base == "email" and slot.group and ("person", slot.group) in bound:
            names = re.findall("[a-z]+", bound["person", slot.group].lower()) or ["info"]
            domain = pools["email"][draw.below(len(pools["email"]))].rpartition("@")[2]
            found = f"{'.'.join((names[0], names[-1])) if len(names) > 1 else names[0]}@{domain}"
        else:
            found = pools[base][draw.below(len(pools[base]))]
        if slot.group:
            bound[key] = found
        if slot.name == "person_first":
            found = found.split(" ")[0]
        if slot.name == "person_last":
            found = found.split(" ")[-1]
        return FORMS[slot.form](found)

    data, spans = b"", []
    for part in parse(template):
        if isinstance(part, str):
            data += part.encode()
            continue
        start = len(data)
        data += value(part).encode()
        if SLOTS[part.name]:
            spans.append((SLOTS[part.name], start, len(data)))
    return data.decode(), spans


def category(spans: list[tuple[str, int, int]]) -> str:
    kinds = {k for k, _, _ in spans}
    person, address = bool(kinds & {"person", "org"}), "address" in kinds
    return "both" if person and address else "no_address_with_person" if person else "no_person_with_address" if address else "nothing"


def problem(text: str, spans: list[tuple[str, int, int]], wanted: str | None, most_tokens: int) -> str | None:
    """Why a document can't be used: category_mismatch, too_long, empty_entity, overlap, boundary_misaligned."""
    if wanted and category(spans) != wanted:
        return "category_mismatch"
    tokens = tokenize(text)
    if sum(t.is_content for t in tokens) > most_tokens:
        return "too_long"
    starts, ends, last = {t.start for t in tokens}, {t.end for t in tokens}, 0
    for _, s, e in spans:
        if s == e:
            return "empty_entity"
        if s < last:
            return "overlap"
        if s not in starts or e not in ends:
            return "boundary_misaligned"
        last = e
    return None


DOCUMENT = "struct<text:string,entities:array<struct<kind:string,start:int,end:int>>,category:string,reason:string>"


def documents(ids: DataFrame, templates: list[tuple[str, str | None]], pools: dict[str, list[str]], seed: int = 0, most_tokens: int = 2048, id_col: str = "id") -> DataFrame:
    """(id, text, entities, category, reason) for each id: the template and every slot are drawn by hashes of seed and id.

    templates: (text, category wanted or None). Bad templates fail here, not in a task.
    """
    for t, _ in templates:
        parse(t)

    def of(row: int) -> dict:
        draw = Draw(seed, row)
        template, wanted = templates[draw.below(len(templates))]
        text, spans = render(template, pools, draw)
        return {"text": text, "entities": [{"kind": k, "start": s, "end": e} for k, s, e in spans], "category": category(spans), "reason": problem(text, spans, wanted, most_tokens)}

    return per_text(ids, [F.col(id_col)], of, DOCUMENT, "d", [id_col]).select(id_col, "d.*")


def usable(made: DataFrame, id_col: str, n: int, excluded_texts: DataFrame | None = None, excluded_surfaces: DataFrame | None = None, weights: dict[str, int] | None = None) -> DataFrame:
    """n documents without a reason against them, texts once, none of excluded texts (text) or surfaces (kind, key), by category weights.

    Instead of drawing again for each one dropped, more are made than needed and the first are taken.
    """
    from . import dedup, splits

    kept = dedup.keep_first(made.where("reason is null"), F.col("text"), [id_col])
    if excluded_texts is not None:
        kept = leakage.without(kept, excluded_texts, ["text"])
    if excluded_surfaces is not None:
        flat = kept.select(id_col, F.explode("entities").alias("e"), "text")
        value = F.decode(F.substring(F.encode("text", "UTF-8"), F.col("e.start") + 1, F.col("e.end") - F.col("e.start")), "UTF-8")
        keyed = flat.select(id_col, F.col("e.kind").alias("kind"), leakage.surface_key(F.col("e.kind"), value).alias("key"))
        hit = keyed.join(excluded_surfaces.select("kind", "key").distinct(), ["kind", "key"]).select(id_col).distinct()
        kept = kept.join(hit, id_col, "left_anti").select(*kept.columns)
    weights = weights or CATEGORIES
    total = sum(weights.values())
    quota = F.coalesce(*[F.when(F.col("category") == c, n * w // total) for c, w in weights.items()], F.lit(0))
    ranked = splits.first_of(kept, ["category"], [id_col], n).withColumn("__quota", quota)
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("category").orderBy(id_col))
    return ranked.withColumn("__place", place).where("__place <= __quota").drop("__place", "__quota")


class Short(RuntimeError):
    """Not enough documents could be made."""


def drawn(spark: SparkSession, n: int, templates: list[tuple[str, str | None]], pools: dict[str, list[str]], seed: int = 0, rounds: int = 10, **excluded) -> DataFrame:
    """As many documents as categories' weights make of n: what usable() drops is drawn again, in rounds with new ids, and it is an error if that isn't enough.

    Each round makes twice what is missing at first, and then ever more; earlier documents
    stay, as ids are in order of rounds.
    """
    weights = excluded.get("weights") or CATEGORIES
    wanted = sum(n * w // sum(weights.values()) for w in weights.values())
    size = 2 * n
    for _ in range(rounds):
        kept = written(usable(documents(spark.range(size), templates, pools, seed), "id", n, **excluded), "drawn")
        if kept.count() >= wanted:
            return kept
        size *= 2
    raise Short(f"fewer than {wanted} documents of {size // 2} drawn can be used")


def pool(rows: DataFrame, name: str, kind: str, split: str, excluded: DataFrame | None = None, most: int = 50_000, seed: int = 0) -> list[str]:
    """Names to fill slots with: those of one split of the hash of the name, none of excluded surfaces (kind, key), each once; a bounded sample, by hash, of ``most``."""
    from . import splits

    distinct = rows.select(F.col(name).alias("name")).where("name is not null").distinct()
    own = distinct.where(splits.split_100(F.col("name"), seed) == split)
    if excluded is not None:
        keyed = own.withColumn("key", leakage.surface_key(F.lit(kind), F.col("name")))
        own = leakage.without(keyed, excluded.where(F.col("kind") == kind).select("key"), ["key"]).select("name")
    return [r["name"] for r in own.orderBy(splits.mixed_key(seed, F.col("name")), "name").limit(most).collect()]


ROOM_STYLES = ("Room {}", "Building {}", "Mail Stop {}", "Suite {}")


def with_prefix(address: str, key: str, per_mille: int = 300) -> str:
    """An address with a room, building or mail stop before its street, for a hashed share of addresses."""
    h = fnv1a(key.encode())
    if h % 1000 >= per_mille:
        return address
    style, number = ROOM_STYLES[h // 1000 % len(ROOM_STYLES)], f"{'ABCDEFGH'[h // 4000 % 8]}{h // 32000 % 900 + 100}"
    return f"{style.format(number)}{chr(10) if h // 7 % 2 else ', '}{address}"


def clean_people(rows: DataFrame, name: str = "name") -> DataFrame:
    """People whose names have no digits or marks, two words or more, and 60 bytes at most."""
    c = F.col(name)
    return rows.where(~c.rlike(r"[\p{N}\p{S}]|[\p{P}&&[^'’.-]]") & (F.octet_length(c) <= 60) & (F.size(F.split(texts.trim(c), r"(?U)\s+")) >= 2))


def clean_organizations(rows: DataFrame, name: str = "name") -> DataFrame:
    """Organizations of three bytes or more that don't name their own identifier."""
    c: Column = F.col(name)
    return rows.where((F.octet_length(c) >= 3) & ~F.lower(c).rlike(r"\blei\b"))
