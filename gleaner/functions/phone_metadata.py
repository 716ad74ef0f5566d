"""Numbering plans: which national numbers a region has. A parameter of the phone scanner.

The default plans below are rules of leading digits drawn up from the public numbering
plans; they don't list single exchanges. ``load()`` takes tables of leading digits instead.
"""

from __future__ import annotations

import functools
import json
import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Plan:
    """A region's national numbers: their lengths, those of fixed lines and mobiles, and a pattern of their leading digits."""

    id: str
    code: str
    trunk: str
    lengths: frozenset[int]
    core: frozenset[int]
    main: bool
    leading: str

    @functools.cached_property
    def pattern(self) -> re.Pattern:
        return re.compile(self.leading)

    def score(self, national: str) -> float | None:
        """0.99 for known leading digits at a possible length, 0.75 for an ordinary length alone."""
        n = len(national)
        if n in self.lengths and self.pattern.match(national):
            return 0.99
        return 0.75 if n in self.core else None


def _plan(id: str, code: str, trunk: str, lengths: range | tuple, core: range | tuple, leading: str, main: bool = False) -> Plan:
    return Plan(id, code, trunk, frozenset(lengths), frozenset(core), main, leading)


#: Area codes of Canada, and those of the plan shared with it that are neither Canada's nor of the United States and their territories.
_CANADA = "204|226|236|249|250|257|263|289|306|343|354|365|367|368|382|387|403|416|418|428|431|437|438|450|460|468|474|506|514|519|548|579|581|584|587|600|604|613|622|639|647|672|683|705|709|742|753|778|780|782|807|819|825|867|873|879|902|905|942"
_OTHERS = "242|246|264|268|284|345|441|473|649|658|664|721|758|767|784|809|829|849|868|869|876"
_FREE = "800|822|833|844|855|866|877|880|881|882|883|884|885|886|887|888|889|900"
_NANP = r"[2-9][0-8][0-9]"

#: Lengths and codes are fixed values.
PLANS = (
    _plan("AT", "43", "0", range(4, 14), range(4, 14), "[1-9]"),
    _plan("BE", "32", "0", (8, 9), (8, 9), "[1-9]"),
    _plan("CA", "1", "1", (7, 10), (10,), rf"(?:{_CANADA}|{_FREE})[2-9]|310"),
    _plan("CH", "41", "0", (9, 12), (9,), "[2-9]"),
    _plan("DE", "49", "0", range(4, 16), range(5, 16), "[1-9]"),
    _plan("GB", "44", "0", (7, 9, 10), (9, 10), "[1235789]", True),
    _plan("GE", "995", "0", (9,), (9,), "3[2-7]|4[1-479]|5[0-9]|70|79|80"),
    _plan("IE", "353", "0", range(7, 11), range(7, 11), "1|[24-9]"),
    _plan("JP", "81", "0", range(8, 18), (9, 10), "[1-9]"),
    _plan("NL", "31", "0", range(5, 12), (9, 11), "[1-9]"),
    _plan("US", "1", "1", (10,), (10,), rf"(?!(?:{_CANADA}|{_OTHERS})|[2-9]11){_NANP}[2-9]", True),
)

#: Other calling codes, their main regions and the lengths that national numbers may have.
OTHER_CODES = {
    "7": ("RU", (10, 14)), "20": ("EG", (8, 9, 10)), "27": ("ZA", (5, 6, 7, 8, 9, 10)), "30": ("GR", (10, 11, 12)), "33": ("FR", (9,)), "34": ("ES", (9,)),
    "36": ("HU", (8, 9)), "39": ("IT", (6, 7, 8, 9, 10, 11, 12)), "40": ("RO", (6, 9)), "45": ("DK", (8,)), "46": ("SE", (6, 7, 8, 9, 10, 12)), "47": ("NO", (5, 8)),
    "48": ("PL", (6, 7, 8, 9, 10)), "51": ("PE", (8, 9)), "52": ("MX", (10,)), "53": ("CU", (6, 7, 8, 10)), "54": ("AR", (10, 11)), "55": ("BR", (8, 9, 10, 11)),
    "56": ("CL", (9, 10, 11)), "57": ("CO", (8, 10, 11)), "58": ("VE", (10,)), "60": ("MY", (8, 9, 10)), "61": ("AU", (5, 6, 7, 8, 9, 10, 12)),
    "62": ("ID", (7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17)), "63": ("PH", (6, 8, 9, 10, 11, 12, 13)), "64": ("NZ", (5, 6, 7, 8, 9, 10)), "65": ("SG", (8, 10, 11)),
    "66": ("TH", (8, 9, 10, 13)), "82": ("KR", (5, 6, 8, 9, 10, 11, 12, 13, 14)), "84": ("VN", (7, 8, 9, 10)), "86": ("CN", (7, 8, 9, 10, 11, 12)),
    "90": ("TR", (7, 10, 12, 13)), "91": ("IN", (8, 9, 10, 11, 12, 13)), "92": ("PK", (8, 9, 10, 11, 12)), "93": ("AF", (9,)), "94": ("LK", (9,)),
    "95": ("MM", (6, 7, 8, 9, 10)), "98": ("IR", (4, 5, 6, 7, 10)), "211": ("SS", (9,)), "212": ("MA", (9,)), "213": ("DZ", (8, 9)), "216": ("TN", (8,)), "218": ("LY", (9,)),
    "220": ("GM", (7,)), "221": ("SN", (9,)), "222": ("MR", (8,)), "223": ("ML", (8,)), "224": ("GN", (8, 9)), "225": ("CI", (10,)), "226": ("BF", (8,)), "227": ("NE", (8,)),
    "228": ("TG", (8,)), "229": ("BJ", (8, 10)), "230": ("MU", (7, 8, 10)), "231": ("LR", (7, 8, 9)), "232": ("SL", (8,)), "233": ("GH", (8, 9)),
    "234": ("NG", (10, 11, 12, 13, 14)), "235": ("TD", (8,)), "236": ("CF", (8,)), "237": ("CM", (8, 9)), "238": ("CV", (7,)), "239": ("ST", (7,)), "240": ("GQ", (9,)),
    "241": ("GA", (7, 8)), "242": ("CG", (9,)), "243": ("CD", (7, 8, 9, 10)), "244": ("AO", (9,)), "245": ("GW", (7, 9)), "246": ("IO", (7,)), "247": ("AC", (5, 6)),
    "248": ("SC", (7,)), "249": ("SD", (9,)), "250": ("RW", (8, 9)), "251": ("ET", (9,)), "252": ("SO", (6, 7, 8, 9)), "253": ("DJ", (8,)), "254": ("KE", (7, 8, 9, 10)),
    "255": ("TZ", (9,)), "256": ("UG", (9,)), "257": ("BI", (8,)), "258": ("MZ", (8, 9)), "260": ("ZM", (9,)), "261": ("MG", (9,)), "262": ("RE", (9,)),
    "263": ("ZW", (5, 6, 7, 8, 9, 10)), "264": ("NA", (8, 9)), "265": ("MW", (7, 9)), "266": ("LS", (8,)), "267": ("BW", (7, 8, 10)), "268": ("SZ", (8, 9)),
    "269": ("KM", (7,)), "290": ("SH", (4, 5)), "291": ("ER", (7,)), "297": ("AW", (7,)), "298": ("FO", (6,)), "299": ("GL", (6,)), "350": ("GI", (8,)), "351": ("PT", (9,)),
    "352": ("LU", (4, 5, 6, 7, 8, 9, 10, 11)), "354": ("IS", (7, 9)), "355": ("AL", (6, 7, 8, 9)), "356": ("MT", (8,)), "357": ("CY", (8,)),
    "358": ("FI", (5, 6, 7, 8, 9, 10, 11, 12)), "359": ("BG", (6, 7, 8, 9, 12)), "370": ("LT", (8,)), "371": ("LV", (8,)), "372": ("EE", (7, 8, 10)), "373": ("MD", (8,)),
    "374": ("AM", (8,)), "375": ("BY", (6, 7, 8, 9, 10, 11)), "376": ("AD", (6, 8, 9)), "377": ("MC", (8, 9)), "378": ("SM", (8, 10)), "380": ("UA", (9, 10)),
    "381": ("RS", (6, 7, 8, 9, 10, 11, 12)), "382": ("ME", (8, 9)), "383": ("XK", (8, 9, 10, 11, 12)), "385": ("HR", (7, 8, 9)), "386": ("SI", (5, 6, 7, 8)),
    "387": ("BA", (8, 9)), "389": ("MK", (8,)), "420": ("CZ", (9, 10, 11, 12)), "421": ("SK", (6, 7, 9)), "423": ("LI", (7, 9)), "500": ("FK", (5,)), "501": ("BZ", (7, 11)),
    "502": ("GT", (8, 11)), "503": ("SV", (7, 8, 11)), "504": ("HN", (8, 11)), "505": ("NI", (8,)), "506": ("CR", (8, 10)), "507": ("PA", (7, 8, 10, 11)),
    "508": ("PM", (6, 9)), "509": ("HT", (8,)), "590": ("GP", (9,)), "591": ("BO", (8, 9)), "592": ("GY", (7,)), "593": ("EC", (8, 9, 10, 11)), "594": ("GF", (9,)),
    "595": ("PY", (6, 7, 8, 9, 10, 11)), "596": ("MQ", (9,)), "597": ("SR", (6, 7)), "598": ("UY", (4, 5, 6, 7, 8, 9, 10, 11, 12, 13)), "599": ("CW", (7, 8)),
    "670": ("TL", (7, 8)), "672": ("NF", (6,)), "673": ("BN", (7,)), "674": ("NR", (7,)), "675": ("PG", (7, 8)), "676": ("TO", (5, 7)), "677": ("SB", (5, 7)),
    "678": ("VU", (5, 7)), "679": ("FJ", (7, 11)), "680": ("PW", (7,)), "681": ("WF", (6, 9)), "682": ("CK", (5,)), "683": ("NU", (4, 7)), "685": ("WS", (5, 6, 7, 10)),
    "686": ("KI", (5, 8)), "687": ("NC", (6,)), "688": ("TV", (5, 6, 7)), "689": ("PF", (6, 8, 9)), "690": ("TK", (4, 5, 6, 7)), "691": ("FM", (7,)), "692": ("MH", (7,)),
    "850": ("KP", (8, 10)), "852": ("HK", (5, 6, 7, 8, 9, 11)), "853": ("MO", (7, 8)), "855": ("KH", (8, 9, 10)), "856": ("LA", (8, 9, 10)), "880": ("BD", (6, 7, 8, 9, 10)),
    "886": ("TW", (7, 8, 9, 10, 11)), "960": ("MV", (7, 10)), "961": ("LB", (7, 8)), "962": ("JO", (8, 9)), "963": ("SY", (8, 9)), "964": ("IQ", (8, 9, 10)),
    "965": ("KW", (7, 8)), "966": ("SA", (9, 10)), "967": ("YE", (7, 8, 9)), "968": ("OM", (7, 8, 9)), "970": ("PS", (8, 9, 10)), "971": ("AE", (5, 6, 7, 8, 9, 10, 11, 12)),
    "972": ("IL", (7, 8, 9, 10, 11, 12)), "973": ("BH", (8,)), "974": ("QA", (7, 8, 9, 11)), "975": ("BT", (7, 8)), "976": ("MN", (8, 9, 10)), "977": ("NP", (8, 10, 11)),
    "992": ("TJ", (9,)), "993": ("TM", (8,)), "994": ("AZ", (9,)), "996": ("KG", (9, 10)), "998": ("UZ", (9,)),
}


@functools.cache
def other_codes() -> dict[str, tuple[str, frozenset[int]]]:
    return {code: (region, frozenset(lengths)) for code, (region, lengths) in OTHER_CODES.items()}


def load(path: str) -> tuple[Plan, ...]:
    """Plans from a JSON list of {id, code, trunk, lengths, core, main, prefixes}; ``x`` in a prefix is any digit."""
    with open(path, encoding="utf-8") as f:
        rows = json.load(f)
    leading = lambda prefixes: "|".join(p.replace("x", "[0-9]") for p in prefixes)
    return tuple(_plan(r["id"], str(r["code"]), r.get("trunk") or "", r["lengths"], r["core"], leading(r["prefixes"]), bool(r.get("main"))) for r in rows)
