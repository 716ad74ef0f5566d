"""Writers: entities and contacts as JSON, shards as Parquet with parallel lists, reports, files that never overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions.offsets import utf16_offset
from gleaner.operators.policy import shown
from gleaner.schema import ADDRESS_LABELS
from gleaner.tables import written


def rendered(entity: Column, text: Column | None = None, utf16: bool = False) -> Column:
    """An entity as responses have it: four decimals, no empty components, offsets in UTF-16 if asked for."""
    at = (lambda c: utf16_offset(text, c)) if utf16 else (lambda c: c)
    parts = F.transform(entity["components"], lambda c: F.struct(c["label"].alias("label"), at(c["start"]).alias("start"), at(c["end"]).alias("end"), shown(c["confidence"]).alias("confidence")))
    return F.struct(
        entity["kind"].alias("kind"), at(entity["start"]).alias("start"), at(entity["end"]).alias("end"), shown(entity["confidence"]).alias("confidence"),
        entity["review_recommended"].alias("review_recommended"), entity["source"].alias("source"), F.when(F.size(parts) > 0, parts).alias("components"),
        entity["normalized"].alias("normalized"), entity["region"].alias("region"),
    )


def detection_json(found: DataFrame, keys: list[str], text_col: str | None = None, utf16: bool = False, model: str = "baseline") -> DataFrame:
    """(keys, json) of (keys, entities): nulls are left out."""
    text = F.col(text_col) if text_col else None
    entities = F.transform("entities", lambda e: rendered(e, text, utf16))
    return found.select(*keys, F.to_json(F.struct(F.lit(model).alias("model"), F.lit("detect").alias("operation"), entities.alias("entities"))).alias("json"))


def rendered_contact(text: Column | None = None, utf16: bool = False):
    """A function of a contact to what responses have: people and organizations are absent rather than null, lists always there."""
    at = (lambda c: utf16_offset(text, c)) if utf16 else (lambda c: c)
    many = lambda c: F.transform(c, lambda e: rendered(e, text, utf16))
    one = lambda c: F.when(c.isNotNull(), rendered(c, text, utf16))
    return lambda c: F.struct(
        at(c["start"]).alias("start"), at(c["end"]).alias("end"), shown(c["confidence"]).alias("confidence"), c["review_recommended"].alias("review_recommended"),
        one(c["person"]).alias("person"), one(c["org"]).alias("org"), many(c["addresses"]).alias("addresses"), many(c["emails"]).alias("emails"), many(c["phones"]).alias("phones"),
    )


def extraction_json(found: DataFrame, keys: list[str], text_col: str | None = None, utf16: bool = False, model: str = "baseline") -> DataFrame:
    """(keys, json) of (keys, contacts, unassigned)."""
    text = F.col(text_col) if text_col else None
    unassigned = F.transform("unassigned", lambda e: rendered(e, text, utf16))
    body = F.struct(F.lit(model).alias("model"), F.lit("extract_contacts").alias("operation"), F.transform("contacts", rendered_contact(text, utf16)).alias("contacts"), unassigned.alias("unassigned"))
    return found.select(*keys, F.to_json(body).alias("json"))


def address_shards(rows: DataFrame, path: str) -> None:
    """Examples by split, spans as three parallel lists of label number, start and end. Never overwrites."""
    place = F.map_from_arrays(F.array(*map(F.lit, ADDRESS_LABELS)), F.array(*[F.lit(i).cast("byte") for i in range(len(ADDRESS_LABELS))]))
    lists = {"span_label": F.transform("spans", lambda s: place[s["label"]]), "span_start": F.transform("spans", lambda s: s["start"]), "span_end": F.transform("spans", lambda s: s["end"])}
    rows.withColumns(lists).drop("spans").write.partitionBy("split").mode("error").parquet(path)


def report(rows: DataFrame, path: str) -> None:
    """Aggregates as JSON lines, in one file: for results whose number of rows has a bound of its own. Only writing that file is one task's."""
    written(rows, "report").coalesce(1).write.mode("error").json(path)
