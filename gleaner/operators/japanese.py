"""Japanese addresses as they are written: from country to room, wards and counties apart from their cities, town and block as one suburb."""

from __future__ import annotations

import re
from dataclasses import replace

from .corpus import Piece, Pieces, Rejected, glued

#: Fixed values.
PREFECTURES = (
    "北海道 青森県 岩手県 宮城県 秋田県 山形県 福島県 茨城県 栃木県 群馬県 埼玉県 千葉県 東京都 神奈川県 新潟県 富山県 石川県 福井県 山梨県 長野県 岐阜県 静岡県 愛知県 三重県 滋賀県 京都府 大阪府 兵庫県 奈良県 "
    "和歌山県 鳥取県 島根県 岡山県 広島県 山口県 徳島県 香川県 愛媛県 高知県 福岡県 佐賀県 長崎県 熊本県 大分県 宮崎県 鹿児島県 沖縄県"
).split()
STREET_WORDS = frozenset(
    "dori dōri doori douri tori toori tōri suji michi lane street st avenue ave road rd kaido kaidō sen line bypass highway expressway route ku shi".split()
)
ORDER = ("country", "postcode", "region", "city", "district", "suburb", "road", "house_number", "po_box", None, "level", "unit")

_NUMERAL = "0-9０-９一二三四五六七八九十"
_CJK = "　-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿！-｠"
_ALL_CJK, _NAME = re.compile(f"[{_CJK}]+"), re.compile(f"(?=.*[^{_NUMERAL}])[{_CJK}{_NUMERAL}]+")
_GROUPING = re.compile("地方$|丁目なし|chiho|chihō|chuho|chūhō| region|région", re.I)
_BLOCK = re.compile(rf"[{_NUMERAL}]+\s*(?:丁目|chome)", re.I)
_STREET = re.compile(rf"(?:通り|通|線|街道|道|バイパス|筋)[{_NUMERAL}丁目]*$|^(?:国道|県道|府道|都道|道道)|[{_NUMERAL}]号$")
_TOWN = re.compile(rf"[{_CJK}{_NUMERAL}]*(?:町|村|丁目)|.*(?:-cho|-chō|-machi|[ -]chome)", re.I)
_ROMAN_TOWN = re.compile(r"(?:(?![぀-鿿])[^\W\d_]|[ -])+")
_WARD = re.compile(r"(?:.*(?<!地)区|.*[- ]ku)", re.I)
_HIRAGANA = re.compile("[぀-ゟ]+")
_LOT = re.compile(rf"([{_CJK}]*?[^0-9０-９])([0-9０-９][0-9０-９\-－−番号地の]*)")


def _first(p: Pieces, label: str, fits=lambda text: True) -> int | None:
    return next((k for k, i in enumerate(p.items) if i.label == label and fits(i.text)), None)


def _split(p: Pieces, k: int, cut: int, left: str, right: str) -> Pieces:
    """Piece k as two that touch."""
    text = p.items[k].text
    return Pieces([*p.items[:k], Piece(left, text[:cut]), Piece(right, text[cut:]), *p.items[k + 1 :]], [*p.seps[:k], "", *p.seps[k:]])


def _dropped(p: Pieces, places: set[int]) -> Pieces:
    kept = [k for k in range(len(p.items)) if k not in places]
    return Pieces([p.items[k] for k in kept], [p.seps[b - 1] for b in kept[1:]])


def _relabelled(p: Pieces, k: int, **changes) -> Pieces:
    return Pieces([replace(i, **changes) if n == k else i for n, i in enumerate(p.items)], list(p.seps))


def repeats_place(text: str) -> bool:
    """A whole address in one piece: it begins with a prefecture, or goes on after a city or ward."""
    return text.startswith(tuple(PREFECTURES)) or any(text[m.end() :] not in ("", "町", "村") for m in re.finditer("(?<=.)[市区]", text))


def is_street(text: str) -> bool:
    return bool(_STREET.search(text)) or repeats_place(text)


def is_town(text: str) -> bool:
    if _ROMAN_TOWN.fullmatch(text):
        return not STREET_WORDS & set(re.split("[ -]", text.lower()))
    return bool(_TOWN.fullmatch(text))


def in_japanese(p: Pieces) -> bool:
    """More labelled pieces in Japanese than in Latin script."""
    texts = [i.text for i in p.items if i.label]
    return sum(bool(re.search("[぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿]", t)) for t in texts) > sum(bool(re.search("[A-Za-z]", t)) for t in texts)


def separator(a: Piece, b: Piece) -> str:
    if b.label is None:
        return "\n"
    if a.label in ("postcode", "country") or b.label == "postcode":
        return " "
    return "" if glued(a.text, b.text) else " "


def _named(p: Pieces) -> Pieces:
    """Prefectures in full and out of their cities, wards and counties out of theirs, lots out of towns."""
    short = {f[:-1]: f for f in PREFECTURES if f != "北海道"} | {"北海": "北海道"}
    p = Pieces([replace(i, text=short.get(i.text, i.text)) if i.label == "region" else i for i in p.items], list(p.seps))
    p = Pieces([replace(i, text=re.sub(f"^([{_CJK}]{{2,}})\\1", r"\1", i.text)) if i.label == "suburb" else i for i in p.items], list(p.seps))
    c = _first(p, "city", lambda t: any(t.startswith(f) and t != f for f in PREFECTURES))
    if c is not None:
        n = len(next(f for f in PREFECTURES if p.items[c].text.startswith(f)))
        if p.has("region"):
            p = _relabelled(p, c, text=p.items[c].text[n:])
        else:
            p = _split(p, c, n, "region", "city")
    c = _first(p, "city", lambda t: _ALL_CJK.fullmatch(t) and re.fullmatch(".+?市.+区", t))
    if c is not None:
        n = p.items[c].text.index("市", 1) + 1
        ward = p.items[c].text[n:]
        if any(i.label == "district" and i.text == ward for i in p.items):
            p = _relabelled(p, c, text=p.items[c].text[:n])
        else:
            p = _split(p, c, n, "city", "district")
    c = _first(p, "city", lambda t: _ALL_CJK.fullmatch(t) and re.fullmatch(".+?郡.+[町村]", t))
    if c is not None:
        p = _split(p, c, p.items[c].text.index("郡", 1) + 1, "district", "city")
    c = _first(p, "road", lambda t: (m := _LOT.fullmatch(t)) and not is_street(m[1]))
    if c is not None and not p.has("house_number"):
        p = _split(p, c, _LOT.fullmatch(p.items[c].text).end(1), "road", "house_number")
    return p


def _labelled(p: Pieces) -> tuple[Pieces, list[bool]]:
    """Wards as districts (as cities in Tokyo), towns as suburbs; whether each was a road."""
    has_city = any(i.label == "city" and re.search("市$|[- ]shi$", i.text, re.I) for i in p.items)
    tokyo = any(i.label == "region" and re.match("東京|tokyo|tōkyō", i.text, re.I) for i in p.items)
    block = [i.label == "suburb" and bool(_BLOCK.fullmatch(i.text)) for i in p.items]
    named_town = any(i.label == "suburb" and not b for i, b in zip(p.items, block, strict=True))
    items, moved = [], []
    for k, i in enumerate(p.items):
        label = i.label
        if _WARD.fullmatch(i.text):
            if label == "suburb" or label == "city" and has_city:
                label = "district"
            if label == "district" and not p.has("city") and tokyo:
                label = "city"
        beside = not named_town and any(block[n] for n in (k - 1, k + 1) if 0 <= n < len(block)) and _ALL_CJK.fullmatch(i.text)
        town = label == "road" and not is_street(i.text) and (is_town(i.text) or _NAME.fullmatch(i.text) or beside)
        items.append(replace(i, label="suburb" if town else label))
        moved.append(bool(town))
    return Pieces(items, list(p.seps)), moved


def _once(p: Pieces, moved: list[bool]) -> tuple[Pieces, list[bool]]:
    """Without towns that a road repeats: of two that share their beginning the fuller stays, the source's own if they differ."""
    gone: set[int] = set()
    towns = [k for k, i in enumerate(p.items) if i.label == "suburb"]
    for c in towns:
        for o in towns:
            if c == o or c in gone or o in gone:
                continue
            road, town = p.items[c].text, p.items[o].text
            if road == town:
                gone.add(max(c, o))
            elif moved[c]:
                shared = next((n for n, (x, y) in enumerate(zip(road, town, strict=False)) if x != y), min(len(road), len(town)))
                if town.startswith(road) or shared >= 2 and not road.startswith(town):
                    gone.add(c)
                elif road.startswith(town):
                    gone.add(o)
    return _dropped(p, gone), [m for k, m in enumerate(moved) if k not in gone]


def _joined(p: Pieces) -> Pieces:
    """A town with its block, or with a further name if it has no number, as one; a second block of a town is dropped."""
    items, seps = p.items[:1], []
    for sep, i in zip(p.seps, p.items[1:], strict=True):
        last = items[-1]
        block = bool(_BLOCK.fullmatch(i.text))
        if last.label == i.label == "suburb" and sep == "" and not _BLOCK.fullmatch(last.text) and (block or not re.search(f"[{_NUMERAL}]", last.text)):
            items[-1] = last if block and last.text.endswith("丁目") else replace(last, text=last.text + i.text)
        else:
            items.append(i)
            seps.append(sep)
    return Pieces(items, seps)


def normalise(p: Pieces) -> Pieces:
    """An address of a Japanese source; readings in kana and pieces that hold several components rule it out. Romanised ones keep their order."""
    if any(i.label == "house_number" and re.search(f"(?![番号地丁目の－ー０-９])[{_CJK}]", i.text) for i in p.items):
        raise Rejected("mislabelled")
    if any(i.label in ("country", "region", "city") and _HIRAGANA.fullmatch(i.text) for i in p.items):
        raise Rejected("kana_reading")
    p = _dropped(p, {k for k, i in enumerate(p.items) if _GROUPING.search(i.text) or i.label == "po_box"})
    p, moved = _once(*_labelled(_named(p)))
    if in_japanese(p):
        sub = lambda i, m: (2 if _BLOCK.fullmatch(i.text) else int(m)) if i.label == "suburb" else 0
        order = sorted(range(len(p.items)), key=lambda k: (ORDER.index(p.items[k].label), sub(p.items[k], moved[k])))
        items = [p.items[k] for k in order]
        p = _joined(Pieces(items, [separator(a, b) for a, b in zip(items, items[1:], strict=False)]))
    if any(i.label == "city" and any(i.text[m.end() :] not in ("", "市", "町", "村") for m in re.finditer("(?<=.)市", i.text)) for i in p.items):
        raise Rejected("mislabelled")
    if any(i.label == "road" and _ALL_CJK.match(i.text) and repeats_place(i.text) for i in p.items):
        raise Rejected("mislabelled")
    return p
