"""The regions that a text's national phone numbers most likely belong to, by what the text says of itself."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gleaner.arrow import explode_structs, per_text
from gleaner.functions.offsets import byte_offsets

from . import emails, phones

#: Weights of each kind of evidence, mentions of a name that count, and characters of a script that do.
WEIGHTS = {"number": 3, "domain": 2, "script": 2, "postcode": 2, "loose_postcode": 1, "name": 1}
MOST_MENTIONS, SCRIPT_CHARS = 3, 3
DOMAINS = {"uk": "GB", "de": "DE", "jp": "JP", "ge": "GE", "at": "AT", "ch": "CH", "nl": "NL", "be": "BE", "ie": "IE", "ca": "CA", "us": "US"}
NAMES = {
    "United Kingdom": "GB", "UK": "GB", "England": "GB", "Scotland": "GB", "Wales": "GB", "Germany": "DE", "Deutschland": "DE", "Japan": "JP", "日本": "JP", "საქართველო": "GE",
    "United States": "US", "USA": "US", "Austria": "AT", "Österreich": "AT", "Switzerland": "CH", "Schweiz": "CH", "Suisse": "CH", "Netherlands": "NL", "Nederland": "NL",
    "Belgium": "BE", "België": "BE", "Belgique": "BE", "Ireland": "IE", "Éire": "IE", "Canada": "CA",
}
STATES = (
    "AL AK AZ AR CA CO CT DE DC FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()

_PAIRS = (
    ("US", "postcode", re.compile(rf"(?:{'|'.join(STATES)}) [0-9]{{5}}(?:-[0-9]{{4}})?")),
    ("GB", "postcode", re.compile(r"[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}")),
    ("NL", "postcode", re.compile(r"[0-9]{4} [A-Z]{2}")),
)
_WORD, _FIVE, _DIGIT = re.compile(r"\S+"), re.compile(r"[0-9]{5}"), re.compile("[0-9]")
_SCRIPTS = (("GE", re.compile("[Ⴀ-ჿ]")), ("JP", re.compile("[぀-ヿ]")))
_LATIN = {n: all(c < "ɐ" for c in n) for n in NAMES}
_ANY_NAME = re.compile("|".join(map(re.escape, NAMES)))


def _town(word: str) -> bool:
    return len(word) > 2 and word[0].isupper() and all(c.islower() for c in word[1:])


def evidence(text: str | None) -> list[tuple[str, str, int]]:
    """(region, kind of evidence, character) of everything that counts, mentions of a name up to the third."""
    if not text:
        return []
    found = [(e.region, "number", e.start) for e in phones.Reader(text, ()).numbers() if e.region in DOMAINS.values()] if re.search("[0-9]", text) else []
    if "@" in text:
        place = {at: i for i, at in enumerate(byte_offsets(text))}
        for e in emails.scan(text):
            if region := DOMAINS.get(e.normalized.rsplit(".", 1)[-1]):
                found.append((region, "domain", place[e.start]))
    before = None
    for m in _WORD.finditer(text) if _DIGIT.search(text) else ():
        word = m[0].strip(",.;:()")
        if before:
            pair = f"{before[1]} {word}"
            shape = next(((r, k) for r, k, p in _PAIRS if p.fullmatch(pair)), None)
            if shape:
                found.append((*shape, before[0]))
            elif _FIVE.fullmatch(before[1]) and _town(word):
                found.append(("DE", "loose_postcode", before[0]))
        before = (m.start(), word) if _DIGIT.search(word) or word in STATES else None
    found += [("JP", "postcode", m.start()) for m in re.finditer("〒", text)]
    for region, pattern in _SCRIPTS:
        signs = [m.start() for m in pattern.finditer(text)]
        if len(signs) >= SCRIPT_CHARS:
            found.append((region, "script", signs[0]))
    if _ANY_NAME.search(text):
        for name, region in NAMES.items():
            edge = r"[^\W_]" if _LATIN[name] else "(?!)"
            places = [m.start() for m in re.finditer(rf"(?<!{edge}){re.escape(name)}(?!{edge})" if _LATIN[name] else re.escape(name), text)]
            found += [(region, "name", at) for at in places[:MOST_MENTIONS]]
    return found


def infer(text: str | None) -> list[str]:
    """Regions by weight, ties by what comes first."""
    weight: dict[str, int] = {}
    first: dict[str, int] = {}
    for region, kind, at in evidence(text):
        weight[region] = weight.get(region, 0) + WEIGHTS[kind]
        first[region] = min(first.get(region, at), at)
    return sorted(weight, key=lambda r: (-weight[r], first[r]))


EVIDENCE = "array<struct<region:string,kind:string,start:int>>"


def votes(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, region, weight, first, rank): what speaks for each region of a text, the heaviest first. Texts are read as Arrow batches, votes are counted natively."""

    def of(text: str | None) -> list[dict]:
        places = byte_offsets(text or "")
        return [{"region": r, "kind": k, "start": places[at]} for r, k, at in evidence(text)]

    rows = explode_structs(per_text(docs, [F.col(text_col)], of, EVIDENCE, "found", keys), "found", keys)
    weight = F.coalesce(*[F.when(F.col("kind") == k, w) for k, w in WEIGHTS.items()])
    counted = rows.groupBy(*keys, "region").agg(F.sum(weight).cast("int").alias("weight"), F.min("start").alias("first"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("weight"), "first", "region")))
