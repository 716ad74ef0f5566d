"""The three operations over DataFrames of texts: detect, parse_address, extract_contacts.

Everything that belongs to one text is worked out where its row is, so that no shuffle is
needed; bands, thresholds and kinds are native filters on what comes back.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.arrow import explode_structs, per_text
from gleaner.operators import baseline, emails, grouping, markdown, phones, policy, rules, spans, tokens
from gleaner.schema import COMPONENT, ENTITY, KINDS, RULE_KINDS, Component, Contact, Entity

_CONTACT = f"struct<start:int,end:int,confidence:float,review_recommended:boolean,person:{ENTITY},org:{ENTITY},addresses:array<{ENTITY}>,emails:array<{ENTITY}>,phones:array<{ENTITY}>>"
EXTRACTION = f"struct<contacts:array<{_CONTACT}>,unassigned:array<{ENTITY}>,error:string>"
DETECTION = f"struct<entities:array<{ENTITY}>,error:string>"


class Scorer(Protocol):
    """What finds people, organizations and addresses, and what parses addresses."""

    def detect(self, text: str, rules: list[Entity], regions: list[str], mask: spans.Mask | None) -> list[Entity]: ...

    def parse(self, text: str, country: str | None) -> list[Component]: ...


class Baseline:
    """The deterministic default."""

    def detect(self, text: str, rules: list[Entity], regions: list[str], mask: spans.Mask | None) -> list[Entity]:
        found = baseline.detect(text, rules)
        return [e for e in found if mask is None or mask.contains(e.start, e.end)]

    def parse(self, text: str, country: str | None) -> list[Component]:
        return baseline.parse_address(text, country)


@dataclass(frozen=True)
class Options:
    """kinds: what to return; country_hint: regions of national numbers, in order; markdown: read texts as Markdown, with these options."""

    kinds: tuple[str, ...] = KINDS
    country_hint: tuple[str, ...] = ()
    include_uncertain: bool = False
    markdown: markdown.Options | None = None
    scorer: Scorer = field(default_factory=Baseline)

    def __post_init__(self):
        if not self.kinds or set(self.kinds) - set(KINDS):
            raise ValueError(f"kinds have to be some of {KINDS}")
        if any(len(h) != 2 or not h.isalpha() or not h.isascii() for h in self.country_hint):
            raise ValueError("hints are codes of two letters")
        object.__setattr__(self, "country_hint", tuple(h.upper() for h in self.country_hint))


def attach_components(entity: Entity, text: bytes, scorer: Scorer, include_uncertain: bool) -> Entity:
    """An address with its parsed components: as sure as itself and the mean of what is known of them."""
    part = text[entity.start : entity.end]
    if len(part) > 8192:
        return entity
    found = shape_components(part.decode("utf-8", "replace"), scorer.parse(part.decode("utf-8", "replace"), None), include_uncertain)
    known = [np.float32(c.confidence) for c in found if c.label != "unknown"]
    sure = min(np.float32(entity.confidence), np.float32(sum(known) / len(known))) if known else np.float32(entity.confidence)
    moved = tuple(Component(c.label, c.start + entity.start, c.end + entity.start, c.confidence) for c in found)
    return replace(entity, components=moved, confidence=float(sure))


_EDGES = ",;、，；。"


def shape_components(text: str, found: Iterable[Component], include_uncertain: bool = False) -> list[Component]:
    """Components trimmed, touching suburbs merged, unsure and repeated ones unknown."""
    data, out = text.encode(), []
    for c in found:
        raw = data[c.start : c.end].decode("utf-8", "replace")
        inner = raw
        while inner and (inner[0] in _EDGES or inner[0].isspace()):
            inner = inner[1:]
        head = len(raw.encode()) - len(inner.encode())
        while inner and (inner[-1] in _EDGES or inner[-1].isspace()):
            inner = inner[:-1]
        if not inner:
            continue
        c = Component(c.label, c.start + head, c.start + head + len(inner.encode()), c.confidence)
        if out and out[-1].label == c.label == "suburb" and out[-1].end == c.start:
            out[-1] = Component("suburb", out[-1].start, c.end, min(out[-1].confidence, c.confidence))
        else:
            out.append(c)
    medium = np.float32(policy.MEDIUM)
    out = [c if np.float32(c.confidence) >= medium else Component("unknown", c.start, c.end, c.confidence) for c in out]
    for label in policy.SINGLE_LABELS:
        same = [i for i, c in enumerate(out) if c.label == label]
        best = max(same, key=lambda i: (out[i].confidence, i), default=None)
        out = [Component("unknown", c.start, c.end, c.confidence) if i in same and i != best else c for i, c in enumerate(out)]
    return [c for c in out if include_uncertain or np.float32(c.confidence) >= medium]


def _banded(found: list[Entity], include_uncertain: bool) -> list[Entity]:
    """Bands as policy.bands() has them, for what is grouped inside one row."""
    flagged = [replace(e, review_recommended=bool(np.float32(e.confidence) < np.float32(policy.HIGH))) for e in found]
    return [e for e in flagged if include_uncertain or np.float32(e.confidence) >= np.float32(policy.MEDIUM)]


def entities_of(text: str, options: Options, hints: list[str] | None = None) -> list[Entity]:
    """Every entity of one text, merged, of the wanted kinds, with bands applied, in order."""
    hints, mask = list(hints or options.country_hint), None
    if options.markdown is not None:
        selected = markdown.select(text, options.markdown)
        regions, found = markdown.scan(text, selected, hints)
        mask = selected.mask()
    else:
        regions, found = rules.scan(text, hints)
    if set(options.kinds) - set(RULE_KINDS):
        data, sure = text.encode(), policy.DETECT_MIN
        model = [e for e in options.scorer.detect(text, found, regions, mask) if np.float32(e.confidence) >= np.float32(sure[e.kind])]
        model = [e for e in spans.merge(found + model, mask) if e.source != "rules"]
        found = found + [attach_components(e, data, options.scorer, options.include_uncertain) if e.kind == "address" else e for e in model]
    wanted = [e for e in found if e.kind in options.kinds]
    return sorted(_banded(wanted, options.include_uncertain), key=lambda e: (e.start, e.end))


def contacts_of(text: str, options: Options, hints: list[str] | None = None) -> tuple[list[Contact], list[Entity]]:
    """(contacts, unassigned) of one text, in document order."""
    found = entities_of(text, replace(options, kinds=KINDS), hints)
    return grouping.apply_bands(*grouping.group(text, found), options.include_uncertain)


def _contact_row(c: Contact, data: bytes) -> dict:
    one = lambda e: e.row(data) if e else None
    many = lambda es: [e.row(data) for e in es]
    return {
        "start": c.start, "end": c.end, "confidence": c.confidence, "review_recommended": bool(c.review_recommended), "person": one(c.person), "org": one(c.org),
        "addresses": many(c.addresses), "emails": many(c.emails), "phones": many(c.phones),
    }


def _hints(hints: Column | None) -> Column:
    return hints if hints is not None else F.array().cast("array<string>")


def detect(docs: DataFrame, keys: list[str], options: Options = Options(), text_col: str = "text", hints: Column | None = None) -> DataFrame:
    """One row an entity: (keys, kind, start, end, text, confidence, review_recommended, source, components, normalized, region).

    Texts without a digit or an at sign can't hold emails or phones and aren't read for
    those alone. A text that is too large to be cut has no rows; errors() lists those.
    """
    found = detections(docs, keys, options, text_col, hints)
    return explode_structs(found.select(*keys, "result.entities"), "entities", keys)


def detections(docs: DataFrame, keys: list[str], options: Options = Options(), text_col: str = "text", hints: Column | None = None) -> DataFrame:
    """(keys, result): entities and, if there is one, the error of each text."""
    text = F.col(text_col)
    if not set(options.kinds) - set(RULE_KINDS) and options.markdown is None:
        text = F.when(text.rlike("[0-9@]"), text)

    def of(text: str | None, hints: list[str] | None) -> dict:
        if not text:
            return {"entities": [], "error": None}
        try:
            data = text.encode()
            return {"entities": [e.row(data) for e in entities_of(text, options, hints)], "error": None}
        except spans.InputTooLarge as problem:
            return {"entities": [], "error": str(problem)}

    return per_text(docs, [text, _hints(hints)], of, DETECTION, "result", keys)


def errors(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, error) of texts that couldn't be read."""
    return found.where("result.error is not null").select(*keys, "result.error")


def extract_contacts(docs: DataFrame, keys: list[str], options: Options = Options(), text_col: str = "text", hints: Column | None = None) -> DataFrame:
    """(keys, contacts, unassigned, error) of each text."""

    def of(text: str | None, hints: list[str] | None) -> dict:
        if not text:
            return {"contacts": [], "unassigned": [], "error": None}
        try:
            data = text.encode()
            contacts, rest = contacts_of(text, options, hints)
            return {"contacts": [_contact_row(c, data) for c in contacts], "unassigned": [e.row(data) for e in rest], "error": None}
        except spans.InputTooLarge as problem:
            return {"contacts": [], "unassigned": [], "error": str(problem)}

    return per_text(docs, [F.col(text_col), _hints(hints)], of, EXTRACTION, "result", keys).select(*keys, "result.*")


def contact_members(extracted: DataFrame, keys: list[str]) -> DataFrame:
    """One row a member: (keys, contact, kind, start, end, text, normalized); contact is null for the unassigned."""
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c)).otherwise(F.array().cast(f"array<{ENTITY}>"))
    rows = extracted.select(*keys, F.posexplode("contacts").alias("contact", "c")).select(*keys, "contact", "c.*")
    inside = rows.select(*keys, "contact", F.explode(F.concat(one("person"), one("org"), "addresses", "emails", "phones")).alias("e"))
    outside = extracted.select(*keys, F.lit(None).cast("int").alias("contact"), F.explode("unassigned").alias("e"))
    return inside.unionByName(outside).select(*keys, "contact", "e.kind", "e.start", "e.end", "e.text", "e.normalized")


PARSED = f"struct<components:array<{COMPONENT}>,confidence:float,error:string>"


def parse_address(addresses: DataFrame, keys: list[str], options: Options = Options(), text_col: str = "text", country: Column | None = None) -> DataFrame:
    """(keys, components, confidence, error) of each text, taken to be one address: returned even when nothing is sure.

    confidence is the least of components that aren't unknown, else 0. More than 8 KiB or
    256 tokens is an error.
    """

    def of(text: str | None, country: str | None) -> dict:
        text = text or ""
        if len(text.encode()) > 8192 or sum(t.is_content for t in tokens.tokenize(text)) > spans.MOST_ENTITY_TOKENS:
            return {"components": [], "confidence": 0.0, "error": "too long for an address"}
        found = shape_components(text, options.scorer.parse(text, country), options.include_uncertain)
        known = [c.confidence for c in found if c.label != "unknown"]
        return {"components": [vars(c) for c in found], "confidence": min(known, default=0.0), "error": None}

    column = (country if country is not None else F.lit(None)).cast("string")
    return per_text(addresses, [F.col(text_col), column], of, PARSED, "result", keys).select(*keys, "result.*")


def register(spark) -> None:
    """find_emails, find_phones and parse_address as SQL functions: arrays of structs of a text."""
    from pyspark.sql.types import _parse_datatype_string as ddl

    def arrow(f, kind: str):
        from gleaner.arrow import to_arrow_type

        out = to_arrow_type(ddl(kind))

        def run(column, *rest):
            import pyarrow as pa

            return pa.array([f(*row) for row in zip(column.to_pylist(), *[r.to_pylist() for r in rest], strict=True)], out)

        return F.arrow_udf(run, kind)

    rows = lambda text, found: [e.row((text or "").encode()) for e in found]
    import pyarrow as pa

    mails = arrow(lambda t: rows(t, emails.scan(t)), f"array<{ENTITY}>")
    numbers = arrow(lambda t, h: rows(t, phones.scan(t, h or [])), f"array<{ENTITY}>")
    parsed = arrow(lambda t: [vars(c) for c in shape_components(t or "", baseline.parse_address(t or ""))], f"array<{COMPONENT}>")
    del pa
    spark.udf.register("find_emails", mails)
    spark.udf.register("find_phones", numbers)
    spark.udf.register("parse_address", parsed)
