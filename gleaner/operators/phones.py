"""Phone numbers in running text: what is phone-shaped is read as groups of digits, ruled out by what it stands next to, and held against numbering plans.

A number without its country code is read in the hinted regions only, in their order.
"""

from __future__ import annotations

import functools
import re
from dataclasses import dataclass, field, replace

from gleaner.functions import phone_metadata
from gleaner.functions.offsets import byte_offsets
from gleaner.functions.phone_metadata import Plan
from gleaner.schema import Entity

#: Fixed values.
DASHES = "-‐‒–—―−－ー"
MOST_GROUPS, MOST_SEPARATORS, MOST_IN_BRACKETS, MOST_UNSEPARATED, MOST_DIGITS = 8, 2, 5, 11, 15
RUN_GROUPS, RUN_DIGITS = 4 * MOST_GROUPS, 8 * MOST_DIGITS
PHONE_WORDS = frozenset(
    "tel phone telephone fax mobile mob cell call hotline telefon telefonnummer handy handynummer mobil mobilnummer ruf rufnummer whatsapp contact kontakt service services care line support "
    "office desk enquiries inquiries queries reception switchboard home work landline daytime evening direct festnetz mobiel telefoon gsm natel portable fon ph t m free tollfree freephone "
    "textphone helpline tty tdd relay voice text sms dial zentrale durchwahl ტელ ტელეფონი მობ მობილური ფაქსი 代表 直通 tél téléphone 電話 電話番号 携帯 携帯電話 ファックス番号 ファクス番号 fax番号".split()
)
OTHER_NUMBER_WORDS = frozenset(
    "isbn issn ean upc gtin sku serial sn imei routing aba iban bic swift account acct konto kto blz sort stnr ust idnr vat ein tin ssn company registration reg hrb hra case aktenzeichen "
    "order bestellung invoice rechnung ticket tracking ref reference customer kd art part patient policy claim passport licence license vin flight pin postcode zip plz facture commande "
    "référence client tva btw kvk factuur klant referentie bestelling".split()
)
MARKERS = frozenset("no nr number num id code nummer n° nº № numéro numero ნომერი კოდი კოდით".split())
PHONE_STEMS = "telefon mobil handy service hotline festnetz telefoon mobiel fax".split()
CURRENCY_WORDS = tuple("ლარ თეთრ gel eur usd euro dollar pound".split())
CALL_WORDS = frozenset("dial dialing dialling call calling ring phone text tel wählen anrufen notruf".split())
SERVICE_NUMBERS = {
    "US": "711 7-1-1 911 988", "CA": "711 911", "GB": "999 111 101 112 18001", "IE": "999 112", "DE": "110 112 115 116117", "AT": "112 133 144", "CH": "112 117 118 144",
    "NL": "112", "BE": "112 101", "GE": "112", "JP": "110 119 118",
}
RELAY = "18001"
RELAY_NAMES = ("federal information relay service", "federal information relay service (firs)", "firs", "telecommunications relay service", "telecommunications relay services")

_L = r"[^\W\d_]"
_SEPARATOR = rf"[ \xa0./{re.escape(DASHES)}]"
_START = re.compile(r"(?<![0-9A-Za-z@#+])(?<![0-9]:)(?<![0-9A-Za-z]/)(?<![0-9]\.)[+(0-9]")
_CODE = re.compile(rf"(?:\(\+|\+\()([0-9]{{1,3}})(?:([ \xa0]{{1,2}})([0-9]{{1,4}}))?\)({_SEPARATOR}{{0,2}})(?=[0-9])")
_BRACKETS, _DIGITS, _SEPARATORS = re.compile(r"\(([0-9]{1,5})\)"), re.compile(r"[0-9]+"), re.compile(rf"{_SEPARATOR}*")
_FULL_STOP = re.compile(r"\.\s")
_WORD_BEFORE = re.compile(rf"((?:{_L}|[°º№])+)([ .:#/\-\xa0：\u3000]*)\Z")
_BLANK = " \xa0\t"


@dataclass
class Run:
    """Groups of digits read together. spans are characters, brackets included."""

    start: int
    end: int
    digits: list[str]
    spans: list[tuple[int, int]]
    gaps: list[str]
    dial: str = ""
    international: bool = False
    plus: bool = False
    capped: bool = False
    labelled: bool = False
    own_line: bool = False
    sizes: list[int] = field(default_factory=list)

    def spaced(self) -> bool:
        return any(map(_only_spaces, self.gaps))


def _only_spaces(gap: str) -> bool:
    return bool(gap) and gap.isspace()


def _dialled(digits: str, plus: bool, sizes: list[int]) -> tuple[str, bool]:
    """(digits after the international prefix, True) or (digits, False); 00 is a prefix with ten digits or more, in a longer group or alone before the rest."""
    if plus:
        return digits, True
    if digits.startswith("00") and len(digits) >= 10 and sizes and (sizes[0] > 2 or sizes[0] == 2 and len(sizes) > 1):
        return digits[2:], True
    return digits, False


class Reader:
    """One text, the hinted plans, and what was read of it."""

    def __init__(self, text: str, hints: list[str] | tuple[str, ...], plans: tuple[Plan, ...] = phone_metadata.PLANS):
        self.text, self.plans = text, plans
        by_id = {p.id: p for p in plans}
        self.hint_ids = [h.upper() for h in hints]
        self.hints = [by_id[h] for h in self.hint_ids if h in by_id]
        self._labels: dict[int, tuple[str, str]] = {}

    # Reading.

    def read(self, i: int, limit: int) -> tuple[Run | None, int]:
        """The run that begins at i and where to go on; None if there is none."""
        text = self.text
        digits: list[str] = []
        spans: list[tuple[int, int]] = []
        gaps: list[str] = []
        pending, bracketed, capped = "", False, False
        international = text[i] == "+"
        plus = international or text.startswith("(+", i)
        j = i + international
        if text.startswith(("(+", "+("), i):
            m = _CODE.match(text, i, limit)
            if not m:
                return None, i + 1
            digits.append(m[1])
            if m[3]:
                digits.append(m[3])
                gaps.append(m[2])
                spans += [(i, m.end(1)), (m.start(3), m.start(4))]
            else:
                spans.append((i, m.start(4)))
            international = bracketed = True
            pending, j = m[4], m.end()
            end = m.start(4)
        else:
            end = j

        def code_only() -> bool:
            return len(digits) == 1 and len(digits[0]) <= 3 and not digits[0].startswith("0")

        def may_open() -> bool:
            if bracketed:
                return False
            if not digits:
                return not international
            return len(digits) == 1 and len(digits[0]) <= (3 if international else 5) and (international or digits[0].startswith("0"))

        total = sum(map(len, digits))
        while True:
            if not international and not bracketed and text.startswith("(0)", j) and j + 3 <= limit and code_only():
                international = True
            m = _BRACKETS.match(text, j, limit) if text.startswith("(", j, limit) and may_open() else None
            group = m or (None if text.startswith("(", j, limit) else _DIGITS.match(text, j, limit))
            if not group:
                break
            found = m[1] if m else group[0]
            if total + len(found) > RUN_DIGITS:
                capped = True
                break
            if not (m and international and found == "0"):  # a bracketed trunk prefix is dialled inside the country only
                if digits:
                    gaps.append(pending)
                    pending = ""
                digits.append(found)
                spans.append(group.span())
                total += len(found)
            bracketed |= bool(m)
            j = end = group.end()
            if len(digits) == RUN_GROUPS:
                capped = True
                break
            run = _SEPARATORS.match(text, j, limit)
            gap, j = run[0], run.end()
            if _FULL_STOP.search(gap) or len(gap) > MOST_SEPARATORS and gap not in (" / ", " - "):
                break
            following = text[j : j + 1] if j < limit else ""
            opens = following == "(" and not bracketed and (may_open() or text.startswith("(0)", j) and j + 3 <= limit and code_only())
            if not (following.isascii() and following.isdigit() or opens):
                break
            pending += gap
        resume = max(end, i + 1)
        after = text[end : end + 1]
        if after and after.isascii() and after.isalnum() and not (after in "xX" and text[end + 1 : end + 2].isascii() and text[end + 1 : end + 2].isdigit()):
            # The last group belongs to the word that it is glued to.
            if not gaps or not _only_spaces(gaps[-1]):
                return None, resume
            gaps.pop()
            spans.pop()
            digits.pop()
            end = spans[-1][1]
        joined = "".join(digits)
        if not (8 if international else 7) <= len(joined) <= RUN_DIGITS:
            return None, resume
        sizes = list(map(len, digits))
        dial, abroad = _dialled(joined, international, sizes)
        return Run(i, end, digits, spans, gaps, dial, abroad, plus, capped, sizes=sizes), end

    def checked(self, i: int, limit: int) -> tuple[Run | None, bool, int]:
        """(run, whether it may be a phone, where to go on)."""
        run, after = self.read(i, limit)
        if not run:
            return None, False, after
        if self.ruled_out(run):
            return run, False, after
        run.labelled, run.own_line = self.phone_label(i), self.alone(run)
        return run, True, after

    def alone(self, run: Run) -> bool:
        before, after = self.text[: run.start].rstrip(_BLANK)[-1:], self.text[run.end :].lstrip(_BLANK)[:1]
        return before in ("", "\n") and after in ("", "\n")

    # What rules a run out.

    def ruled_out(self, run: Run) -> bool:
        text, sizes, gaps = self.text, run.sizes, run.gaps
        if len(sizes) == 4 and max(sizes) <= 3 and set(gaps) == {"."}:
            return True
        if sizes[0] == 1 and run.dial.startswith("0") and gaps and gaps[0].startswith("."):
            return True
        if _times_or_dates(run) or sum("/" in g for g in gaps) > 1 and not _slash_list(run) or _date(run):
            return True
        if not run.international and self.identifier(run.start):
            return True
        before, after = text[max(0, run.start - 2) : run.start], text[run.end : run.end + 2]
        beside = (before[:-1] if before.endswith(" ") else before)[-1:], (after[1:] if after.startswith(" ") else after)[:1]
        if any(c and c in "$€£¥円₾%" for c in beside):
            return True
        word = re.compile(rf" ?({_L}+)").match(text, run.end)
        if word and word[1].lower().startswith(CURRENCY_WORDS) and not (run.plus and "(" in text[run.start : run.end]):  # no amount has both
            return True
        return not run.international and len(sizes) == 1 and len(run.dial) > MOST_UNSEPARATED

    def identifier(self, at: int) -> bool:
        """Whether digits go on an identifier: labelled as another number, glued by a hyphen, or after parts of an account number or code."""
        text = self.text
        if self.other_label(at):
            return True
        if at >= 2 and text[at - 1] == "-" and text[at - 2].isalnum():
            return True
        words = re.search(r"(?:([^\W_]*)( ))?([^\W_]*) \Z", text[max(0, at - 80) : at])
        if not words or at < 2:
            return False
        previous, joined, word = words[1] or "", bool(words[2]), words[3]
        head = re.compile(r"[A-Z]{2}[0-9]{2}")
        if joined and re.fullmatch("[A-Z]{4}", word) and head.fullmatch(previous):
            return True
        if not (any(c.isalpha() for c in word) and re.search("[0-9]", word)):
            return False
        if head.fullmatch(word):
            return True
        return joined and bool(re.search("[0-9]", previous)) and not _postcode_pair(previous, word)

    def _words_before(self, at: int) -> tuple[str, str]:
        """The kinds (phone, other, marker or nothing) of the two words before a place, nearest first."""
        if at in self._labels:
            return self._labels[at]
        text, kinds, country, marker, end = self.text, ["", ""], False, None, at
        for k in range(2):
            m = _WORD_BEFORE.search(text[max(0, end - 120) : end])
            if not m:
                break
            base = max(0, end - 120)
            word, start, stop = m[1], base + m.start(1), base + m.end(1)
            lower = word.lower()
            if k == 0 and lower == "ნომერი":
                marker = start
            if k == 1 and lower == "საკონტაქტო" and marker is not None and text[stop:marker].strip(" \xa0") == "" and stop < marker:
                kinds[1] = "phone"
            else:
                kinds[k] = _label(lower, text[stop : stop + 1] == ".")
            if k == 0:
                country = not kinds[0] and bool(re.fullmatch("[A-Z]{2}", word))
            end = start
        found = ("other", "") if country and kinds[1] == "other" else (kinds[0], kinds[1])
        self._labels[at] = found
        return found

    def _dial_in(self, at: int) -> bool:
        before = self.text[max(0, at - 96) : at].lower().rstrip(" \t")
        return bool(re.search(r"dial-in(?:(?!dial-in)[^\n;.])*number:\Z", before))

    def other_label(self, at: int) -> bool:
        first, second = self._words_before(at)
        return first == "other" or first == "marker" and second != "phone" and not self._dial_in(at)

    def phone_label(self, at: int) -> bool:
        first, second = self._words_before(at)
        return first == "phone" or first == "marker" and (second == "phone" or self._dial_in(at))

    # Numbering plans.

    def _readings(self, dial: str, international: bool, bare: bool):
        """(plan, national number) of each region that a number may belong to."""
        for plan in self.plans if international else self.hints:
            if international:
                if not dial.startswith(plan.code):
                    continue
                national = dial[len(plan.code) :]
                if plan.code != "1" and plan.trunk:
                    national = national.removeprefix(plan.trunk)
            elif plan.code == "1":
                if bare:  # as often an id as a number
                    continue
                national = dial.removeprefix(plan.trunk) if plan.trunk else dial
            elif not plan.trunk or plan.id == "GE" and dial.startswith(("5", "790")):
                national = dial
            elif dial.startswith(plan.trunk):
                national = dial[len(plan.trunk) :]
            else:
                continue
            if not national.startswith("0") and len(plan.code) + len(national) <= MOST_DIGITS:
                yield plan, national

    def _best(self, dial: str, international: bool, plus: bool, bare: bool) -> tuple[float, str, str] | None:
        """(confidence, E.164, region); of equals the main region of a code, then the first."""
        best: tuple[float, bool] = (0.0, False)
        found = None
        for plan, national in self._readings(dial, international, bare):
            score = plan.score(national)
            if score is not None and (score, plan.main) > best and (score > best[0] or plan.main):
                best, found = (score, plan.main), (score, f"+{plan.code}{national}", plan.id)
                if not international and score >= 0.99:
                    break
        if found or not plus:
            return found
        for width in (1, 2, 3):
            if (known := phone_metadata.other_codes().get(dial[:width])) and len(dial) > width:
                region, lengths = known
                rest = dial[width:]
                if rest.startswith("0") and len(rest) - 1 in lengths:
                    rest = rest[1:]
                if len(rest) in lengths and not rest.startswith("0"):
                    return 0.75, f"+{dial[:width]}{rest}", region
        return None

    def validate(self, run: Run) -> tuple[float, str, str] | None:
        bare = not run.gaps and not run.labelled
        if found := self._best(run.dial, run.international, run.plus, bare):
            return found
        if run.gaps and run.sizes[-1] <= 5 and run.gaps[-1].strip() == "-":  # a direct-dial extension
            cut = len(run.dial) - run.sizes[-1]
            base = self._best(run.dial[:cut], run.international, run.plus, bare) if cut >= 0 else None
            if base and base[2] in ("DE", "AT"):
                return base[0], base[1] + run.dial[cut:], base[2]
        return self._tbilisi(run)

    def _tbilisi(self, run: Run) -> tuple[float, str, str] | None:
        """A local number of Tbilisi without its area code, in a grouping that only phones have or with a sign that it is one."""
        marked, year = run.labelled or run.own_line, re.search(r"(?:19|20)[0-9]{2}\Z", run.dial)
        shapes = {(3, 2, 2): True, (1, 2, 2, 2): marked, (7,): run.labelled, (1, 2, 4): marked and not year}
        if run.international or not run.dial.startswith("2") or not shapes.get(tuple(run.sizes)) or all(p.id != "GE" for p in self.hints):
            return None
        found = self._best("032" + run.dial, False, False, False)
        return (min(found[0], 0.9), *found[1:]) if found else None

    # Whole texts.

    def _reread(self, run: Run, first: int, last: int) -> tuple[Run | None, bool]:
        """Groups first..last read on their own: (run or None if the read covers others, whether it may be a phone)."""
        start = run.start if first == 0 else run.spans[first][0]
        limit = run.spans[last - 1][1]
        piece, ok, after = self.checked(start, limit)
        if not piece or after != limit:
            return None, False
        piece.labelled |= run.labelled and ok
        return piece, ok

    def _cut(self, run: Run) -> tuple[list[tuple[Run, tuple]], int | None]:
        """The numbers of a run that isn't one itself, and where to read on if it was cut short."""
        n = len(run.sizes)
        if n >= 4 and set(run.sizes) == {4}:
            return [], None
        cuts = [0, *(k + 1 for k, g in enumerate(run.gaps) if _only_spaces(g) or g == " / "), n]
        m = len(cuts)
        upto = [0]
        for size in run.sizes:
            upto.append(upto[-1] + size)
        near = next((x for x in range(1, m) if n - cuts[x] <= MOST_GROUPS and upto[n] - upto[cuts[x]] <= MOST_DIGITS + 3), m - 1) if run.capped else m - 1
        go_on = lambda x: run.spans[cuts[x]][0] if run.capped and x < m - 1 else None
        years = [True] * m
        for x in range(m - 2, -1, -1):
            years[x] = years[x + 1] and self._year(run, cuts[x], cuts[x + 1])
        pieces: dict[tuple[int, int], tuple] = {}
        for y in range(1, m):
            for x in range(y):
                if cuts[y] - cuts[x] <= MOST_GROUPS and (x, y) != (0, m - 1) and not (run.capped and y == m - 1):
                    pieces[x, y] = self._piece(run, cuts[x], cuts[y], upto)
        if not any(p[0] == "valid" for p in pieces.values()):
            return [], go_on(near)
        path = _best_cutting(pieces, m, near, lambda x, y: x == 0 or y == m - 1 or years[x])
        if run.capped and path:
            path = [k for k in path[:-1] if k[1] <= near]
        kept = [pieces[k][1:] for k in path if pieces[k][0] == "valid"]
        return kept, go_on(path[-1][1]) if path else go_on(near)

    def _piece(self, run: Run, first: int, last: int, upto: list[int]) -> tuple:
        """("valid", run, reading), ("negative",), ("short",) or ("nothing",)."""
        if upto[last] - upto[first] >= 7 and self._worth_reading(run, first, last):
            piece, ok = self._reread(run, first, last)
            if piece and not ok:
                return ("negative",)
            if piece and (found := self.validate(piece)):
                return "valid", piece, found
        short = run.sizes[first] <= 4 if last - first == 1 else self._year(run, first, last)
        return ("short",) if short else ("nothing",)

    def _worth_reading(self, run: Run, first: int, last: int) -> bool:
        """False if groups, joined by spaces alone, can't be ruled out for more than the run was and no plan has their digits."""
        if any(not g.isspace() for g in run.gaps[first : last - 1]) or last - first == 1 and run.sizes[first] > MOST_UNSEPARATED:
            return True
        if any(p.id == "GE" for p in self.hints) or first == 0 and (run.plus or run.international):
            return True
        dial, abroad = _dialled("".join(run.digits[first:last]), False, run.sizes[first:last])
        return self._best(dial, abroad, False, last - first == 1 and not run.labelled) is not None

    def _year(self, run: Run, first: int, last: int) -> bool:
        """A year, or two joined by a dash, the earlier first."""
        if last - first > 2 or any(s != 4 for s in run.sizes[first:last]) or last - first == 2 and run.gaps[first] not in ("-", "‐", "–"):
            return False
        values = [int(d) for d in run.digits[first:last]]
        return all(1900 <= v <= 2099 for v in values) and values == sorted(values)

    def _without_tail(self, run: Run, found: tuple) -> tuple[Run, tuple]:
        """One or two digits before a word are the word's if the rest is a number without them."""
        n = len(run.sizes)
        if n >= 2 and run.sizes[-1] <= 2 and run.sizes[-2] >= 3 and _only_spaces(run.gaps[-1]) and re.compile(rf"[ \xa0]+{_L}").match(self.text, run.end):
            piece, ok = self._reread(run, 0, n - 1)
            if piece and ok and (shorter := self.validate(piece)):
                return piece, shorter
        return run, found

    def numbers(self, begin: int = 0) -> list[Entity]:
        """Numbers read by their plans, in characters."""
        out, i, carried = [], begin, (-1, False)
        while m := _START.search(self.text, i):
            at = m.start()
            run, ok, after = self.checked(at, len(self.text))
            if not run or not ok:
                i = self._label_covers(run) or after if run else after
                continue
            run.labelled |= carried == (at, True)
            whole = None if run.capped else self.validate(run)
            parts, resume = ([(run, whole)], None) if whole else self._cut(run)
            for part, found in parts:
                part, (confidence, e164, region) = self._without_tail(part, found)
                out.append(self._expanded(Entity("phone", part.start, part.end, confidence, normalized=e164, region=region)))
            i = after if resume is None else resume
            carried = (i, run.labelled) if resume is not None else (-1, False)
        return out

    def _label_covers(self, run: Run) -> int | None:
        """Where a number starts afresh after the first group of a run, if a label for another number means that group alone."""
        if len(run.sizes) > 1 and run.sizes[0] >= 4 and run.sizes[:2] != [4, 4] and _only_spaces(run.gaps[0]) and self.text[run.spans[1][0]] == "0" and self.other_label(run.start):
            return run.spans[1][0]
        return None

    _EXTENSION = re.compile(r"(?:[ \xa0]{0,2},[ \xa0]{0,2}|[ \xa0]{1,2})(?![ \xa0])(?i:extension|ext)\.?[ \xa0]{0,2}([0-9]{1,5})(?![^\W_]|-)")
    _GOES_ON = re.compile(rf"[^\S\n\r\u2028\u2029]*[/.,‑{re.escape(DASHES)}][^\S\n\r\u2028\u2029]*[0-9]")

    def _expanded(self, e: Entity) -> Entity:
        """A number of the United States with the brackets around it and its extension."""
        if e.region != "US":
            return e
        start, end, text = e.start, e.end, self.text
        if text[start - 1 : start] == "(" and text[end : end + 1] == ")":
            start, end = start - 1, end + 1
        m = self._EXTENSION.match(text, end)
        if m and not self._GOES_ON.match(text, m.end()):
            end = m.end()
        return e.moved(start, end)

    _VANITY = re.compile(r"(?<![^\W_])(?<!\+)\(([0-9]{3})\) ([0-9]{3})-([A-Za-z]{4}) \(([0-9]{4})\)(?![^\W_])")
    _KEYS = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "22233344455566677778889999")

    def vanity(self) -> list[Entity]:
        """Letters with their digits in brackets, where the keypad agrees."""
        found = []
        if all(p.id != "US" for p in self.hints):
            return found
        for m in self._VANITY.finditer(self.text):
            before = self.text[: m.start()].rstrip(" \t\xa0")[-1:]
            if m[3].upper().translate(self._KEYS) != m[4] or self.other_label(m.start()) or before.isnumeric() or before == "+" or self._GOES_ON.match(self.text, m.end()):
                continue
            reading = self._best(m[1] + m[2] + m[4], False, False, False)
            if reading and reading[2] == "US":
                found.append(self._expanded(Entity("phone", m.start(), m.end(), reading[0], normalized=reading[1], region="US")))
        return found

    def _service(self, start: int, end: int, region: str) -> Entity:
        return Entity("phone", start, end, 0.9, normalized=self.text[start:end].replace("-", ""), region=region)

    def _relayed(self, found: list[Entity]) -> list[Entity]:
        """A relay prefix with the number after it, as one."""
        joined = []
        for m in re.finditer(rf"(?<![^\W_]){RELAY} ", self.text):
            rest = Reader(self.text[m.end() :], (), self.plans)
            rest.hints = self.hints
            first = next(iter(rest.numbers()), None)
            if first and first.start == 0:
                joined.append(replace(first, start=m.start(), end=m.end() + first.end))
        return [e for e in found if not _overlaps(e, joined)] + joined

    def _called(self, at: int) -> bool:
        m = re.search(rf"({_L}+)[ :\xa0]+\Z", self.text[max(0, at - 60) : at])
        return bool(m) and m[1].lower() in CALL_WORDS

    def _named_relay(self, at: int, end: int) -> bool:
        """``call the federal information relay service at``, and nothing after it that makes it another number."""
        clause = re.split(r"[\n\r;:.\u2028\u2029]", self.text[max(0, at - 128) : at])[-1]
        words = [w.lower() for w in re.split("[ \xa0]+", clause) if w]
        calls = [k for k, w in enumerate(words) if w in ("call", "dial")]
        if not words or words[-1] != "at" or not calls:
            return False
        name = " ".join(words[calls[-1] + 1 : -1]).removeprefix("the ")
        rest = self.text[end:].lstrip(" \xa0")
        ends = not rest or rest[0] in "\n\r.;)]!?" or rest[0] == "," and not _identifies(rest[1:]) or re.split("[ \xa0]", rest)[0].lower() in ("to", "for", "from", "now", "today")
        return name in RELAY_NAMES and ends

    def services(self, found: list[Entity]) -> list[Entity]:
        """found with short numbers that the text says to call."""
        numbers: dict[str, str] = {}
        for h in self.hint_ids:
            for n in SERVICE_NUMBERS.get(h, "").split():
                numbers.setdefault(n, h)
        if RELAY in numbers:
            found = self._relayed(found)
        extra: list[Entity] = []
        if numbers:
            any_of = "|".join(map(re.escape, sorted(numbers, key=len, reverse=True)))
            for m in re.finditer(rf"(?<![^\W_])(?:{any_of})(?![^\W_])(?![-./,][0-9])", self.text):
                called = self._called(m.start()) or numbers[m[0]] == "US" and m[0] in ("711", "7-1-1") and self._named_relay(m.start(), m.end())
                e = self._service(m.start(), m.end(), numbers[m[0]])
                if called and not _overlaps(e, found):
                    extra.append(e)
        if "GE" in self.hint_ids:
            for m in re.finditer(r"(?<![^\W_])(?:199|1[0-8][0-9]{2})(?![^\W_])(?![- ./,][0-9])", self.text):
                lines = self.text[: m.start()].rstrip(" \t\r")
                line = (lines[:-1] if lines.endswith("\n") else lines).rsplit("\n", 1)[-1].strip()
                called = line in ("ცხელი ხაზი", "ცხელი ხაზი:") if m[0] == "199" else self.phone_label(m.start())
                e = self._service(m.start(), m.end(), "GE")
                if called and not _overlaps(e, found + extra):
                    extra.append(e)
        return sorted(found + extra, key=lambda e: e.start)


def _overlaps(e: Entity, others: list[Entity]) -> bool:
    return any(e.start < o.end and o.start < e.end for o in others)


def _label(word: str, dotted: bool) -> str:
    """phone, other, marker or nothing, of a word in lower case."""
    if word in PHONE_WORDS:
        return "phone"
    if word in MARKERS or not word.isascii() and word.endswith("id"):
        return "marker"
    if word.endswith(("nummer", "nr")):
        stem = word.removesuffix("nummer") if word.endswith("nummer") else word.removesuffix("nr")
        return "phone" if any(s in stem for s in PHONE_STEMS) or stem.startswith("tel") or stem.endswith("fon") else "other"
    if word in OTHER_NUMBER_WORDS or word.endswith("zeichen") or word == "az" and dotted or word.endswith("番号") and "電話" not in word:
        return "other"
    return ""


def _postcode_pair(outward: str, inward: str) -> bool:
    """Two groups of a British, Canadian or Irish postcode."""
    pair = f"{outward} {inward}"
    return bool(re.fullmatch(r"[A-Z]{1,2}[0-9][0-9A-Z]? [0-9][A-Z]{2}|[A-Z][0-9][A-Z] [0-9][A-Z][0-9]|[A-Z][0-9][0-9A-Z] [0-9A-Z]{4}", pair))


def _identifies(tail: str) -> bool:
    """Whether what follows a comma is a street or a count, so that the number before is no phone."""
    words = [w.rstrip(".,;").lower() for w in re.split("[ \xa0]+", tail) if w][:4]
    if not words or words[0] in ("for", "to", "from"):
        return False
    counted = words[0].isnumeric() and words[1:2] and words[1] in ("cases", "events", "tickets", "records", "requests")
    return bool(counted) or any(w in "street st road rd avenue ave drive dr lane ln boulevard blvd highway hwy court ct".split() for w in words)


def _date(run: Run) -> bool:
    """A date, alone, before an hour, or in a version number."""
    sizes, gaps = run.sizes, run.gaps
    if len(sizes) < 3 or gaps[0] != gaps[1] or gaps[0] not in ("-", "/", ".") or tuple(sizes[:3]) not in {(4, 2, 2), (2, 2, 4), (1, 2, 4), (2, 1, 4), (1, 1, 4), (2, 2, 2)}:
        return False
    hour = len(sizes) == 4 and gaps[2].isspace() and sizes[3] <= 2 or len(sizes) == 4 and not gaps[2] and sizes[3] <= 2
    version = not run.international and 4 in sizes[:3] and set(gaps[:3]) == {"."}
    return len(sizes) == 3 or hour or version


def _slash_list(run: Run) -> bool:
    """Whole numbers side by side, a spaced slash between them."""
    n = run.sizes[0]
    for gap, size in zip(run.gaps, run.sizes[1:], strict=True):
        if "/" in gap:
            if gap != " / " or n < 7:
                return False
            n = 0
        n += size
    return n >= 7 or run.capped


_TIME = re.compile(r"(?:0?[0-9]|1[0-9]|2[0-4])\.+[ \xa0]*[0-5][0-9]")


def _times_or_dates(run: Run) -> bool:
    """Times or dates from and to, split at a dash; full dates split at a space too."""
    sizes, gaps, values = run.sizes, run.gaps, [int(d) for d in run.digits]
    if run.international and not run.plus and run.digits[0].startswith("00"):
        values[0] = int(run.digits[0][2:] or 0)
    dash = [any(c in DASHES for c in g) for g in gaps]
    space = [not g or g.isspace() for g in gaps]
    if len(sizes) < 2 or not any(map(max, zip(dash, space, strict=True))) or max(sizes) > 4 or len(sizes) > 2 and not any(g.startswith(".") for g in gaps):
        return False
    if sizes == [4, 4]:
        return dash[0] and all(v // 100 <= 24 and v % 100 < 60 for v in values)
    segments, at_space = [[0]], False
    for k, gap in enumerate(gaps):
        if dash[k] or space[k]:
            at_space |= not dash[k]
            segments.append([])
        elif not gap.startswith("."):
            return False
        segments[-1].append(k + 1)
    day_month = lambda s: sizes[s[0]] <= 2 and sizes[s[1]] <= 2 and 1 <= values[s[0]] <= 31 and 1 <= values[s[1]] <= 12
    full = lambda s: len(s) == 3 and day_month(s) and sizes[s[2]] in (2, 4)
    time = lambda s: len(s) == 2 and sizes[s[0]] <= 2 and sizes[s[1]] == 2 and values[s[0]] <= 24 and values[s[1]] < 60
    fits = full if at_space else lambda s: full(s) or len(s) == 2 and day_month(s) or time(s)
    return len(segments) >= 2 and all(map(fits, segments))


def _best_cutting(pieces: dict[tuple[int, int], tuple], m: int, least_end: int, edge) -> list[tuple[int, int]]:
    """The pieces, in order, of the cutting of the highest sum of confidences.

    A piece may go for a reason: it is ruled out; or it is short, at an edge, and all that stay
    show that they are phones; or whatever it is, all that stay have no spaces in them.
    Stricter reasons win ties; a short piece rather goes than lengthens the number before.
    """
    top, path = 0.0, []
    for drop_short, drop_any in ((False, False), (True, False), (False, True), (True, True)):

        def gain(key, p, drop_short=drop_short, drop_any=drop_any) -> float | None:
            if p[0] == "valid":
                run, found = p[1], p[2]
                anchored = run.international or run.dial.startswith("0") or run.labelled and run.sizes in ([3, 3, 4], [10])
                return None if drop_short and not anchored or drop_any and run.spaced() else found[0]
            if p[0] == "negative" or drop_any or p[0] == "short" and drop_short and edge(*key):
                return 0.0
            return None

        reach: list[tuple[float, tuple[int, int] | None] | None] = [(0.0, None), *[None] * (m - 1)]
        for (x, y), p in pieces.items():
            more = gain((x, y), p)
            if reach[x] is None or more is None:
                continue
            score = reach[x][0] + more
            if reach[y] is None or score > reach[y][0] or p[0] == "short" and score == reach[y][0]:
                reach[y] = (score, (x, y))
        ends = [(r[0], y) for y, r in enumerate(reach) if y >= least_end and r is not None]
        if not ends or max(ends)[0] <= top:
            continue
        top, y = max(ends)
        path = []
        while reach[y][1]:
            path.append(reach[y][1])
            y = path[-1][0]
        path.reverse()
    return path


def scan(text: str | None, hints: list[str] | tuple[str, ...] = (), plans: tuple[Plan, ...] = phone_metadata.PLANS) -> list[Entity]:
    """Every phone number of a text, in order, none overlapping, in bytes."""
    if not text or not re.search("[0-9]", text):
        return []
    reader = Reader(text, hints, plans)
    found = reader.services(reader.numbers() + reader.vanity())
    places = byte_offsets(text)
    return [e.moved(places[e.start], places[e.end]) for e in found]


def whole(candidate: str, hints: list[str] | tuple[str, ...] = (), plans: tuple[Plan, ...] = phone_metadata.PLANS) -> Entity | None:
    """The candidate as one number, if it is that throughout."""
    found = scan(candidate, hints, plans)
    return found[0] if len(found) == 1 and found[0].start == 0 and found[0].end == len(candidate.encode()) else None


@functools.cache
def plan_rows(plans: tuple[Plan, ...] = phone_metadata.PLANS) -> list[tuple]:
    """(id, code, trunk, lengths, core, main) as a dimension table has them."""
    return [(p.id, p.code, p.trunk, sorted(p.lengths), sorted(p.core), p.main) for p in plans]
