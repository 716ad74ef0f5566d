"""Confidence bands and what follows from them, as DataFrame expressions. Confidences are floats of 32 bits throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
HIGH, MEDIUM = 0.85, 0.50
DETECT_MIN = {"person": 0.85, "org": 0.80, "address": 0.85, "email": 0.0, "phone": 0.0}
SINGLE_LABELS = ("house_number", "postcode", "country", "city")
SEPARATORS = r"[\s,;、，；。]"


def _float(x: float) -> Column:
    return F.lit(x).cast("float")


def shown(confidence: Column) -> Column:
    """Rounded for display: four decimals of the widened float."""
    return F.round(confidence.cast("double"), 4)


def bands(entities: DataFrame, include_uncertain: bool = False) -> DataFrame:
    """From 0.85 up as is, from 0.5 flagged for review, the rest only if asked for, flagged too."""
    sure = F.col("confidence").cast("float")
    flagged = entities.withColumn("review_recommended", sure < _float(HIGH))
    return flagged if include_uncertain else flagged.where(sure >= _float(MEDIUM))


def detector_thresholds(entities: DataFrame) -> DataFrame:
    """Model entities below their kind's least confidence go, whatever the caller wants; rules have none."""
    least = F.coalesce(*[F.when(F.col("kind") == k, _float(v)) for k, v in DETECT_MIN.items()], _float(0.0))
    return entities.where((F.col("source") == "rules") | (F.col("confidence").cast("float") >= least))


def kinds(entities: DataFrame, wanted: list[str]) -> DataFrame:
    """Requested kinds; to be applied after rules were merged, as phones need emails to lose to."""
    return entities.where(F.col("kind").isin(list(wanted)))


def trim_components(components: DataFrame) -> DataFrame:
    """(…, text, start, end): separators and white space cut from either end; what is nothing else goes."""
    head = F.octet_length(F.regexp_extract(F.col("text"), rf"(?U)^{SEPARATORS}*", 0))
    tail = F.octet_length(F.regexp_extract(F.col("text"), rf"(?U){SEPARATORS}*$", 0))
    cut = components.withColumns({"__head": head, "__tail": tail}).where(F.octet_length("text") > F.col("__head") + F.col("__tail"))
    inner = F.regexp_replace(F.regexp_replace(F.col("text"), rf"(?U)^{SEPARATORS}+", ""), rf"(?U){SEPARATORS}+$", "")
    return cut.withColumns({"start": F.col("start") + F.col("__head"), "end": F.col("end") - F.col("__tail"), "text": inner}).drop("__head", "__tail")


def merge_suburbs(components: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, label, start, end, confidence): suburbs that touch become one, of the least confidence."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    touches = (F.col("label") == "suburb") & (F.lag("label").over(order) == "suburb") & (F.lag("end").over(order) == F.col("start"))
    marked = components.withColumn("__new", F.when(F.coalesce(touches, F.lit(False)), 0).otherwise(1))
    islands = marked.withColumn("__island", F.sum("__new").over(order))
    merged = islands.groupBy(*keys, "__island").agg(F.first("label").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("confidence").alias("confidence"))
    return merged.drop("__island")


def unknown_components(components: DataFrame, keys: list[str], include_uncertain: bool = False) -> DataFrame:
    """Unsure components, and all but the surest (of equals the last) of labels that an address has once, become unknown; unsure ones go unless asked for."""
    sure = F.col("confidence").cast("float") >= _float(MEDIUM)
    known = components.withColumn("label", F.when(sure, F.col("label")).otherwise("unknown"))
    order = Window.partitionBy(*keys, "label").orderBy(F.desc("confidence"), F.desc("start"), F.desc("end"))
    single = F.col("label").isin(list(SINGLE_LABELS)) & (F.row_number().over(order) > 1)
    found = known.withColumn("label", F.when(single, "unknown").otherwise(F.col("label")))
    return found if include_uncertain else found.where(sure)


def address_confidence(components: DataFrame, keys: list[str]) -> DataFrame:
    """The least confidence of components that aren't unknown, else 0, for each key."""
    least = F.min(F.when(F.col("label") != "unknown", F.col("confidence").cast("float")))
    return components.groupBy(*keys).agg(F.coalesce(least, _float(0.0)).alias("confidence"))


def contact_bands(contacts: DataFrame, include_uncertain: bool = False) -> tuple[DataFrame, DataFrame]:
    """(kept, dissolved) of contacts; the members of dissolved ones are unassigned."""
    sure = F.col("confidence").cast("float")
    flagged = contacts.withColumn("review_recommended", sure < _float(HIGH))
    if include_uncertain:
        return flagged, flagged.where("false")
    return flagged.where(sure >= _float(MEDIUM)), flagged.where(sure < _float(MEDIUM))
