"""What training and evaluation share: prose, surfaces, contact details, keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.functions import text as texts
from gleaner.tables import few, spread, written

#: Rows, and bytes of files, of a side that is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20


def small(rows: DataFrame, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """rows, worked out once, to be broadcast if they are few in number and in bytes."""
    side = written(rows, "side")
    held = side._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() <= size
    return F.broadcast(side) if held and few(side, limit) else side


def prose_overlap(docs: DataFrame, gold: DataFrame, doc_id: str, gold_id: str, doc_text: str = "text", gold_text: str = "text", size: int = 12) -> DataFrame:
    """(doc_id, gold ids in order) of documents that share a window of ``size`` words with gold items.

    Windows are exploded within the map side of the join; a checked number of gold windows
    is broadcast, so that documents' windows aren't shuffled. Each pair counts once.
    """
    left = spread(docs.select(F.col(doc_id).alias("doc"), F.col(doc_text).alias("t"))).select("doc", F.explode(texts.shingles(texts.ascii_words(F.col("t")), size)).alias("h"))
    right = gold.select(F.col(gold_id).alias("item"), F.explode(texts.shingles(texts.ascii_words(F.col(gold_text)), size)).alias("h"))
    pairs = left.join(small(right), "h").select("doc", "item").distinct()
    return pairs.groupBy("doc").agg(F.array_sort(F.collect_list("item")).alias("items")).withColumnRenamed("doc", doc_id)


def collisions(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """(left_id, keys, right ids): rows of both sides with equal keys, nulls apart."""
    other = right.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys, F.col(right_id).alias("__other")).distinct()
    met = left.select(left_id, *keys).distinct().join(small(other), keys)
    return met.groupBy(left_id, *keys).agg(F.array_sort(F.collect_set("__other")).alias("others"))


def surface_key(kind: Column, value: Column) -> Column:
    """How values of a kind are compared: emails by lower case, phones by digits, names by single spaces."""
    flat = F.regexp_replace(texts.trim(F.lower(value)), r"(?U)\s+", " ")
    return F.when(kind == "email", F.lower(value)).when(kind == "phone", F.regexp_replace(value, "[^0-9]", "")).otherwise(flat)


def without(rows: DataFrame, excluded: DataFrame, keys: list[str]) -> DataFrame:
    """rows that share no key with excluded."""
    return rows.join(small(excluded.select(*keys).distinct()), keys, "left_anti").select(*rows.columns)


def families(aliases: DataFrame, observed: DataFrame, family: str = "family", alias: str = "alias") -> DataFrame:
    """All aliases of families of which one is observed."""
    active = aliases.join(observed.select(alias).distinct(), alias).select(family).distinct()
    return aliases.join(active, family).select(family, alias)


def disjoint_or_fail(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    """Raises if the sides share a key."""
    if not left.select(*keys).join(right.select(*keys), keys, "left_semi").isEmpty():
        raise ValueError(f"training and evaluation share {what}")


SIGNALS = ("document", "surface", "contact", "prose")


def separation(train: DataFrame, gold: DataFrame, size: int = 12) -> DataFrame:
    """(signal, id, others): training documents that share something with gold ones, and what it is.

    Both sides have id, text, document (a key of the source) and entities (kind, text).
    Signals are an equal key, an equal surface of a name, an equal email or phone, and a
    window of ``size`` words. Null keys and entities meet nothing; without rows all is apart.
    """

    def surfaces(rows: DataFrame, contact: bool) -> DataFrame:
        found = rows.select("id", F.explode("entities").alias("e")).select("id", F.col("e.kind").alias("kind"), F.col("e.text").alias("value"))
        held = found.where(F.col("kind").isin("email", "phone") == F.lit(contact))
        return held.select("id", F.col("kind"), surface_key(F.col("kind"), F.col("value")).alias("key"))

    def met(signal: str, left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
        hit = collisions(left, right, keys, "id", "id").select("id", F.explode("others").alias("other"))
        return hit.groupBy("id").agg(F.array_sort(F.collect_set("other")).alias("others")).select(F.lit(signal).alias("signal"), "id", "others")

    found = met("document", train.select("id", "document"), gold.select("id", "document"), ["document"])
    for signal, contact in (("surface", False), ("contact", True)):
        found = found.unionByName(met(signal, surfaces(train, contact), surfaces(gold, contact), ["kind", "key"]))
    prose = prose_overlap(train, gold, "id", "id", size=size).select(F.lit("prose").alias("signal"), "id", F.col("items").alias("others"))
    return found.unionByName(prose)


def frozen_exclusions(parts: list[DataFrame], expected: int | None = None) -> DataFrame:
    """(name, text, expected) of several evaluation sets as one set of exclusions.

    A name or a text twice, a span unlike the text that it names, spans that overlap, and
    another number of cases than expected are errors.
    """
    every = parts[0].select("name", "text", "expected")
    for part in parts[1:]:
        every = every.unionByName(part.select("name", "text", "expected"))
    every = written(every, "exclusions")
    for column in ("name", "text"):
        if not every.groupBy(column).count().where("count > 1").isEmpty():
            raise ValueError(f"a {column} is there twice")
    data = F.encode("text", "UTF-8")
    unlike = F.exists("expected", lambda s: ~F.substring(data, s["start"] + 1, s["end"] - s["start"]).cast("string").eqNullSafe(s["text"]))
    ends = F.array_sort(F.transform("expected", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    steps = F.when(F.size(ends) > 1, F.sequence(F.lit(1), F.size(ends) - 1)).otherwise(F.array().cast("array<int>"))
    if not every.where(unlike | F.exists(steps, lambda i: F.get(ends, i)["start"] < F.get(ends, i - 1)["end"])).isEmpty():
        raise ValueError("a span differs from its text or overlaps another")
    n = every.count()
    if expected is not None and n != expected:
        raise ValueError(f"{n} cases instead of {expected}")
    return every
