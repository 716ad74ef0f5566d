"""The data model: kinds, labels and the Spark types of entities, tokens and contacts. Offsets are UTF-8 bytes, end exclusive."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

KINDS = ("person", "org", "address", "email", "phone")
ADDRESS_LABELS = ("house_number", "road", "unit", "level", "suburb", "city", "district", "region", "postcode", "country", "po_box", "unknown")
RULE_KINDS = ("email", "phone")

COMPONENT = "struct<label:string,start:int,end:int,confidence:float>"
ENTITY = f"struct<kind:string,start:int,end:int,text:string,confidence:float,review_recommended:boolean,source:string,components:array<{COMPONENT}>,normalized:string,region:string>"
TOKEN = "struct<start:int,end:int,class:string,script:string>"


@dataclass(frozen=True)
class Component:
    label: str
    start: int
    end: int
    confidence: float


@dataclass(frozen=True)
class Entity:
    """A span of a text; see ENTITY."""

    kind: str
    start: int
    end: int
    confidence: float
    source: str = "rules"
    normalized: str | None = None
    region: str | None = None
    components: tuple[Component, ...] = ()
    review_recommended: bool = False

    def moved(self, start: int, end: int) -> Entity:
        return replace(self, start=start, end=end)

    def row(self, data: bytes) -> dict:
        """As ENTITY has it; data is the whole text."""
        parts = [vars(c) | {} for c in self.components]
        return {
            "kind": self.kind, "start": self.start, "end": self.end, "text": data[self.start : self.end].decode("utf-8", "replace"), "confidence": self.confidence,
            "review_recommended": self.review_recommended, "source": self.source, "components": parts, "normalized": self.normalized, "region": self.region,
        }


@dataclass
class Contact:
    start: int
    end: int
    confidence: float
    person: Entity | None = None
    org: Entity | None = None
    addresses: list[Entity] = field(default_factory=list)
    emails: list[Entity] = field(default_factory=list)
    phones: list[Entity] = field(default_factory=list)
    review_recommended: bool = False

    def members(self) -> list[Entity]:
        return [e for e in (self.person, self.org) if e] + self.addresses + self.emails + self.phones


EXAMPLE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("group_id", T.LongType()),
        T.StructField("country", T.StringType()),
        T.StructField("language", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("split", T.StringType()),
        T.StructField("augmented", T.BooleanType()),
    ]
)
