"""Labelled addresses: from tagged lines to pieces, texts with spans, keys and checks."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner.arrow import per_text
from gleaner.functions.hashing import fnv1a
from gleaner.schema import ADDRESS_LABELS

from .tokens import normalise, tokenize

#: What tags mean; a label, or outside, exclude, separator.
TAGS = {
    "house_number": "house_number", "road": "road", "unit": "unit", "level": "level", "staircase": "unit", "entrance": "unit", "po_box": "po_box", "postcode": "postcode",
    "suburb": "suburb", "city_district": "district", "city": "city", "island": "region", "state_district": "district", "state": "region", "country_region": "region", "country": "country",
    "house": "outside", "world_region": "outside", "attention": "outside", "care_of": "outside", "SEP": "outside", "category": "exclude", "near": "exclude", "FSEP": "separator",
}
ROAD_TYPES = "road street avenue drive lane place court close crescent terrace gardens boulevard parkway highway square circle".split()
SHORT_TYPES = frozenset("rd st str la cr ave av dr ln pl ct cl cres ter terr gdns blvd pkwy hwy sq cir park garden high".split())
LETTERED = frozenset("avenue ave road rd highway hwy route county street st lane".split())
STATISTICAL_REGIONS = frozenset(
    (
        "north east england", "north west england", "yorkshire and the humber", "east midlands", "west midlands", "east of england", "south east", "south east england",
        "south west england", "south west", "north west", "north east", "w midlands", "wst midlands", "e midlands", "w mids", "e mids", "west mids", "east mids",
    )
)
BOROUGHS = frozenset(("manhattan", "brooklyn", "queens", "the bronx", "bronx", "staten island"))
ABBREVIATIONS = {
    "GB": (
        ("street", "st"), ("road", "rd"), ("avenue", "ave"), ("lane", "ln"), ("drive", "dr"), ("court", "ct"), ("place", "pl"), ("square", "sq"), ("crescent", "cres"),
        ("gardens", "gdns"), ("terrace", "terr"),
    ),
    "DE": (("straße", "str."), ("strasse", "str."), ("platz", "pl.")),
    "US": (
        ("street", "st"), ("street", "str"), ("avenue", "ave"), ("avenue", "avnu"), ("avenue", "avnue"), ("boulevard", "blvd"), ("road", "rd"), ("drive", "dr"), ("drive", "dve"),
        ("mile", "mi"), ("lane", "ln"), ("court", "ct"), ("place", "pl"), ("parkway", "pkwy"), ("highway", "hwy"), ("north", "n"), ("south", "s"), ("east", "e"), ("west", "w"),
        ("west", "wst"),
    ),
    "GE": (("avenue", "ave"), ("street", "st"), ("გამზირი", "გამზ."), ("ქუჩა", "ქ.")),
}


def abbreviations(country: str) -> tuple[tuple[str, str], ...]:
    """(full, short) words of roads."""
    return ABBREVIATIONS.get(country, ())


@dataclass(frozen=True)
class Piece:
    label: str | None
    text: str


@dataclass
class Pieces:
    """items with seps[i] between items i and i + 1."""

    items: list[Piece] = field(default_factory=list)
    seps: list[str] = field(default_factory=list)

    def has(self, label: str) -> bool:
        return any(p.label == label for p in self.items)


class Rejected(ValueError):
    """A row that makes no example; its text is the reason."""


_CJK = "　-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿！-｠"
_IS_CJK = re.compile(f"[{_CJK}]")
_GLUE = re.compile(rf"[{_CJK}][{_CJK}0-9-]|[0-9-][{_CJK}]")
_KANA = (re.compile("[぀-ゟ]"), re.compile("[゠-ヿㇰ-ㇿｦ-ﾟ]"))
_CLOSES, _OPENS = frozenset(",.;:)]!?"), frozenset("([")


def glued(left: str, right: str, within: bool = False) -> bool:
    """Whether two texts are written without a space between; components of one kana script aren't."""
    if not left or not right or not _GLUE.fullmatch(left[-1] + right[0]):
        return False
    return within or not any(k.match(left[-1]) and k.match(right[0]) for k in _KANA)


def join_tokens(tokens: list[str]) -> str:
    out = ""
    for i, t in enumerate(tokens):
        tight = i == 0 or t in _CLOSES or tokens[i - 1] in _OPENS or glued(tokens[i - 1], t, True)
        out += t if tight else f" {t}"
    return out


def parse_line(line: str) -> tuple[str, str, list[tuple[str, str]]] | None:
    """(language, country, pairs of token and tag) of a tagged line; None if it isn't one."""
    columns = line.rstrip("\r\n").split("\t", 2)
    if len(columns) < 3:
        return None
    pairs = [p.rpartition("/") for p in columns[2].split(" ") if p]
    if not pairs or any(not slash for _, slash, _ in pairs):
        return None
    return columns[0], columns[1], [(token, tag) for token, _, tag in pairs]


def pieces_of(language: str, country: str, pairs: list[tuple[str, str]]) -> Pieces:
    """Neighbouring tokens of one tag as a piece, punctuation and line breaks as separators. An unknown tag is an error."""
    japanese = country.lower() == "jp"
    if japanese and language.startswith("ja_kana"):
        raise Rejected("kana_reading")
    made, run, tag_of_run, pending = Pieces(), [], None, ""

    def flush() -> None:
        nonlocal run, pending
        if run:
            text = join_tokens(run)
            if made.items:
                made.seps.append(pending or ("" if glued(made.items[-1].text, text) else " "))
            fate = TAGS[tag_of_run]
            made.items.append(Piece(None if fate == "outside" else fate, text))
            run, pending = [], ""

    for token, tag in pairs:
        if not token:
            raise Rejected("malformed")
        fate = TAGS[tag]
        if fate == "exclude":
            raise Rejected("excluded")
        if japanese and tag == "island":
            continue
        if fate == "separator" or tag == "SEP":
            flush()
            tag_of_run = None
            if fate == "separator":
                pending = "\n"
            elif pending != "\n":
                joins = token == "-" and made.items and _IS_CJK.match(made.items[-1].text[-1])
                pending = "-" if joins else " - " if token == "-" else f"{token} "
            continue
        if tag != tag_of_run:
            flush()
            tag_of_run = tag
        run.append(token)
    flush()
    if not made.items:
        raise Rejected("malformed")
    if not any(p.label for p in made.items):
        raise Rejected("no_component")
    return made


def _without(p: Pieces, unwanted) -> Pieces:
    """Pieces but for unwanted ones, each gone with the separator after it, the last with the one before."""
    kept = [k for k, i in enumerate(p.items) if not unwanted(i)]
    return Pieces([p.items[k] for k in kept], [p.seps[b - 1] for b in kept[1:]])


def normalise_source(country: str, p: Pieces) -> Pieces:
    """Fixes what a source writes as nobody does; and what rules a row out, by country."""
    if country in ("GB", "US"):
        for road in (i.text.split() for i in p.items if i.label == "road"):
            last, before = road[-1].lower().rstrip("."), road[-2].lower().rstrip(".") if len(road) > 1 else ""
            letter = len(last) == 1 and last.isalpha() and last not in "nsew" and before not in LETTERED
            if (letter or len(last) >= 2 and any(t.startswith(last) and t != last for t in ROAD_TYPES)) and last not in SHORT_TYPES:
                raise Rejected("truncated_road")
    if country == "US" and not p.has("city"):
        p = Pieces([replace(i, label="city") if i.label == "district" and i.text.lower().rstrip(".") in BOROUGHS else i for i in p.items], p.seps)
    if country == "GB":
        p = _without(p, lambda i: i.label == "district" and i.text.lower().rstrip(".") in STATISTICAL_REGIONS)
        for c in range(len(p.items) - 1):
            if (p.items[c].label, p.items[c + 1].label) == ("country", "postcode"):
                p.items[c], p.items[c + 1] = p.items[c + 1], p.items[c]
                break
        at = next((k for k, i in enumerate(p.items) if i.label == "country"), 0)
        if at and p.seps[at - 1] == " ":
            p.seps[at - 1] = "\n"
        if not any(i.label for i in p.items):
            raise Rejected("no_component")
    if country == "GE":
        if any(i.label == "country" and i.text == "AB" for i in p.items):
            raise Rejected("foreign_country")
        if any(i.label == "road" and (len(i.text) > 80 or ": " in i.text) for i in p.items):
            raise Rejected("mislabelled")
    if country == "JP":
        from . import japanese

        p = japanese.normalise(p)
        if not any(i.label for i in p.items):
            raise Rejected("no_component")
    if country == "DE":
        for k, i in enumerate(p.items):
            if i.label == "postcode" and (m := re.match("DE?-", i.text)):
                items = [*p.items[:k], Piece(None, m[0]), Piece("postcode", i.text[m.end() :]), *p.items[k + 1 :]]
                return Pieces(items, [*p.seps[:k], "", *p.seps[k:]])
    return p


_POSTCODES = {"GE": "[0-9]{4}", "DE": "(?:DE?-)?[0-9]{5}", "US": "[0-9]{5}(?:-[0-9]{4})?", "JP": "〒? ?[0-9０-９]{3}[-－−‐][0-9０-９]{4}"}


def check_country(country: str, p: Pieces) -> None:
    pattern = _POSTCODES.get(country)
    if pattern and not all(re.fullmatch(pattern, i.text) for i in p.items if i.label == "postcode"):
        raise Rejected("foreign_postcode")
    if country == "DE" and p.has("po_box") and p.has("road"):
        raise Rejected("po_box_with_road")


Span = tuple[str, int, int]


def render(p: Pieces) -> tuple[str, list[Span]]:
    """(text, spans in bytes): each labelled piece is a span."""
    text, spans = b"", []
    for i, item in enumerate(p.items):
        text += p.seps[i - 1].encode() if i else b""
        start = len(text)
        text += item.text.encode()
        if item.label:
            spans.append((item.label, start, len(text)))
    return text.decode(), spans


_GAP = re.compile(r"[\s,;-]*")


def decompose(text: str, spans: list[Span]) -> Pieces:
    """The pieces of what render() wrote."""
    data, made, pending, at = text.encode(), Pieces(), "", 0

    def put(piece: Piece) -> None:
        nonlocal pending
        if made.items:
            made.seps.append(pending)
        made.items.append(piece)
        pending = ""

    for label, start, end in [*spans, ("", len(data), len(data))]:
        gap = data[at:start].decode()
        lead = _GAP.match(gap).end()
        core = gap[lead:].rstrip(" \t\n\r,;-　\xa0")
        pending += gap[:lead]
        if core:
            put(Piece(None, core))
            pending = gap[lead + len(core) :]
        if label:
            put(Piece(label, data[start:end].decode()))
        at = end
    return made


def fold_road(country: str, normalised: str) -> str:
    full = {short.rstrip("."): word for word, short in reversed(abbreviations(country))}
    words = []
    for w in normalised.split(" "):
        w = full.get(w, w)
        if country == "DE" and w != "straße":
            w = re.sub("(?:strasse|str)$", "straße", w)
        words.append(w)
    return " ".join(words)


def group_key(country: str, text: str, spans: list[Span]) -> str:
    """What variants of one source record share: house number and road, else the other pieces in order."""
    data = text.encode()
    of = lambda label: normalise(" ".join(data[s:e].decode() for k, s, e in spans if k == label))
    if road := fold_road(country, of("road")):
        return f"{country}\x01{of('house_number')}\x01{road}"
    kept = [normalise(data[s:e].decode().replace("-", " ")) for k, s, e in spans if k not in ("postcode", "country", "region")]
    return f"{country}\x01\x02" + "\x01".join(sorted(k for k in kept if k))


def fingerprint(text: str) -> int:
    return fnv1a(normalise(text).encode())


def spans_valid(text: str, spans: list[Span]) -> bool:
    """In order, on characters, without white space at their edges, with a label."""
    data, last = text.encode(), 0
    for label, start, end in spans:
        try:
            part = data[start:end].decode()
        except UnicodeDecodeError:
            return False
        if not last <= start < end <= len(data) or part != part.strip() or label not in ADDRESS_LABELS[:-1]:
            return False
        last = end
    return True


def cuts_token(text: str, spans: list[Span]) -> bool:
    edges = {t.start for t in tokenize(text)} | {len(text.encode())}
    return any(s not in edges or e not in edges for _, s, e in spans)


EXAMPLE = "struct<country:string,language:string,text:string,spans:array<struct<label:string,start:int,end:int>>,group_key:string,fingerprint:string,reason:string>"


def example(line: str | None) -> dict:
    """One tagged line as an example, or the reason why it is none."""
    row: dict = dict.fromkeys(("country", "language", "text", "spans", "group_key", "fingerprint", "reason"))
    parsed = parse_line(line or "")
    if not parsed:
        return row | {"reason": "malformed"}
    language, country, pairs = parsed
    row |= {"language": language, "country": country.upper()}
    try:
        p = normalise_source(country.upper(), pieces_of(language, country, pairs))
        check_country(country.upper(), p)
        text, spans = render(p)
        if not spans_valid(text, spans):
            raise Rejected("invalid_span")
        if cuts_token(text, spans):
            raise Rejected("cuts_token")
    except Rejected as problem:
        return row | {"reason": str(problem)}
    listed = [{"label": k, "start": s, "end": e} for k, s, e in spans]
    return row | {"text": text, "spans": listed, "group_key": group_key(country.upper(), text, spans), "fingerprint": f"{fingerprint(text):016x}"}


def examples(lines: DataFrame, keys: list[str], line_col: str = "value", countries: list[str] | None = None) -> DataFrame:
    """(keys, country, language, text, spans, group_key, fingerprint, reason) of tagged lines; those of other countries go before they are parsed."""
    if countries:
        lines = lines.where(F.lower(F.get(F.split(line_col, "\t", 3), F.lit(1))).isin([c.lower() for c in countries]))
    return per_text(lines, [F.col(line_col)], example, EXAMPLE, "example", keys).select(*keys, "example.*")


def is_place_only(spans: Column) -> Column:
    """No house number, road or PO box."""
    return ~F.exists(spans, lambda s: s["label"].isin("house_number", "road", "po_box"))


def prepare(found: DataFrame, order: str, quota: int, seed: int = 0) -> DataFrame:
    """Examples split by group key, deduplicated and cut to a quota of each country and split, in file order."""
    from . import dedup, splits

    kept = found.where("reason is null").withColumn("split", splits.split_12(F.col("group_key"), seed))
    kept = dedup.same_place(dedup.keep_first(kept, F.col("fingerprint"), [order]), [order])
    return splits.quotas(kept, ["country", "split"], [order], quota, is_place_only(F.col("spans")))


def checks(rows: DataFrame) -> DataFrame:
    """One row of counts that have to be zero, of examples (id, group_key, split, augmented, original, text, spans, country)."""
    in_two = rows.where("not augmented").groupBy("group_key").agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("keys_in_two_splits"))
    outside = rows.where("augmented and split <> 'train'").agg(F.count("*").alias("copies_outside_train"))
    originals = rows.where("not augmented").select(F.col("id").alias("original"), F.col("country").alias("of"), F.col("split").alias("its"))
    copies = rows.where("augmented").join(originals, "original", "left")
    orphans = copies.where("its is null or its <> 'train' or of <> country").agg(F.count("*").alias("orphan_copies"))
    labelled = F.to_json(F.array_sort(F.transform("spans", lambda s: F.struct(s["label"], F.substring(F.encode("text", "UTF-8"), s["start"] + 1, s["end"] - s["start"])))))
    twice = rows.where("not augmented").groupBy("country", labelled.alias("c")).agg(F.countDistinct("split").alias("n")).where("n > 1").agg(F.count("*").alias("components_in_two_splits"))
    return in_two.crossJoin(outside).crossJoin(orphans).crossJoin(twice)


# Names of people and organizations.

_PRIVATE_TRUST, _PERSON_FIRST = re.compile(r"\btrusts?\b"), frozenset("mr mrs miss ms sir lady lord dr rev late".split())
_STREETS = frozenset("street st avenue ave road rd boulevard blvd drive dr lane ln way place court parkway highway terrace square plaza".split())
DISAMBIGUATORS = frozenset(("party", "publisher", "company", "georgia", "japan", "band", "magazine", "newspaper", "organization", "organisation", "business", "brand", "record label", "企業", "出版社", "პარტია"))


def _words(name: str) -> list[str]:
    return re.findall(r"[^\W_]+", name.lower())


def names_a_person(name: str) -> bool:
    """A title first, or the estate of someone deceased."""
    words = [w for w in _words(name) if w != "the"]
    joined = f" {' '.join(words)} "
    return bool(words) and (words[0] in _PERSON_FIRST or any(f" {p} " in joined for p in ("deceased", "decd", "estate of")))


def address_like(name: str) -> bool:
    """A company named after its street address."""
    words = _words(name)
    return bool(words) and re.fullmatch("[0-9]{1,6}", words[0]) is not None and any(w in _STREETS for w in words[1:7])


def without_disambiguator(name: str) -> str:
    m = re.search(r"\s*[(（]([^()（）]*)[)）]\s*$", name)
    return name[: m.start()].rstrip() if m and m[1].strip().lower() in DISAMBIGUATORS else name


def without_article(name: str) -> str:
    m = re.match("(?:The|THE) ", name)
    rest = name[m.end() :] if m else name
    return rest if " " in rest or len(rest) > 3 else name


def postal(spans: Column) -> Column:
    """Whether a letter could be sent there: a house number or PO box, a unit or floor on a road, or road, town and postcode."""
    has = lambda label: F.exists(spans, lambda s: s["label"] == label)
    return has("house_number") | has("po_box") | (has("unit") | has("level")) & has("road") | has("road") & has("postcode") & has("city")
