"""Answers to JSON requests: each row has its own operation, kinds, hints, format and offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.arrow import per_text
from gleaner.operators import markdown, policy, spans, tokens
from gleaner.plans import api
from gleaner.schema import ENTITY, KINDS, Entity
from gleaner.sources import writers

_ANSWER = f"struct<entities:array<{ENTITY}>,contacts:{api.EXTRACTION.removeprefix('struct<contacts:').split(',unassigned:')[0]},unassigned:array<{ENTITY}>,address:{ENTITY},error:string>"
LARGEST_ADDRESS = 8192


def address_of(text: str, options: api.Options) -> Entity:
    """A text as one address, from its first byte to its last, as sure as its least sure known component."""
    data = text.encode()
    if len(data) > LARGEST_ADDRESS or sum(t.is_content for t in tokens.tokenize(text)) > spans.MOST_ENTITY_TOKENS:
        raise spans.InputTooLarge("too long for an address")
    found = api.shape_components(text, options.scorer.parse(text, None), options.include_uncertain)
    sure = min((c.confidence for c in found if c.label != "unknown"), default=0.0)
    return Entity("address", 0, len(data), sure, source="model", components=tuple(found), review_recommended=sure < policy.HIGH)


def answers(requests: DataFrame, keys: list[str], scorer: api.Scorer | None = None, model: str = "baseline") -> DataFrame:
    """(keys, json, error) of requests as readers.requests() gives them.

    Without kinds all are wanted, without a hint regions are inferred, and without a format
    a text is plain. An answer has entities, contacts and unassigned, or an address with
    its components, as the operation says; a text that is too large has an error instead.
    """
    scorer = scorer or api.Baseline()

    def of(operation, text, kinds, hints, uncertain, form) -> dict:
        options = api.Options(tuple(kinds or KINDS), tuple(h.strip() for h in hints or ()), bool(uncertain), markdown.Options() if form == "markdown" else None, scorer)
        row: dict = dict.fromkeys(("entities", "contacts", "unassigned", "address", "error"))
        text = text or ""
        data = text.encode()
        try:
            if operation == "detect":
                row["entities"] = [e.row(data) for e in api.entities_of(text, options)]
            elif operation == "contacts":
                contacts, rest = api.contacts_of(text, options)
                row["contacts"], row["unassigned"] = [api._contact_row(c, data) for c in contacts], [e.row(data) for e in rest]
            else:
                row["address"] = address_of(text, options).row(data)
        except spans.InputTooLarge as problem:
            row["error"] = str(problem)
        return row

    columns = [F.col(c) for c in ("operation", "text", "kinds", "country_hint", "include_uncertain", "format")]
    found = per_text(requests, columns, of, _ANSWER, "a", [*keys, "operation", "text", "offsets"])
    return found.select(*keys, F.when(F.col("a.error").isNull(), _json(model)).alias("json"), F.col("a.error").alias("error"))


def _json(model: str) -> Column:
    def body(utf16: bool) -> Column:
        one = lambda e: writers.rendered(e, F.col("text"), utf16)
        many = lambda c: F.transform(c, one)
        address = one(F.col("a.address"))
        shown = address.withField("components", F.coalesce(address["components"], F.array().cast("array<struct<label:string,start:int,end:int,confidence:double>>")))
        head = [F.lit(model).alias("model"), F.col("operation").alias("operation")]
        contact = writers.rendered_contact(F.col("text"), utf16)
        return (
            F.when(F.col("operation") == "detect", F.to_json(F.struct(*head, many(F.col("a.entities")).alias("entities"))))
            .when(F.col("operation") == "contacts", F.to_json(F.struct(*head, F.transform("a.contacts", contact).alias("contacts"), many(F.col("a.unassigned")).alias("unassigned"))))
            .otherwise(F.to_json(F.struct(*head, shown.alias("address"))))
        )

    return F.when(F.col("offsets") == "utf16", body(True)).otherwise(body(False))
