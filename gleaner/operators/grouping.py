"""Contacts: people and organizations with the details that belong to them, by blocks of lines."""

from __future__ import annotations

import bisect
import re
from dataclasses import dataclass, field

import numpy as np

from gleaner.functions.unicode import INVISIBLE
from gleaner.schema import Contact, Entity

from .lines import Block, split_blocks

#: Fixed values.
FLOOR = 0.50
DETAILS = ("address", "email", "phone")
ROLES = frozenset("admin billing ceo cfo contact cs cto hello help hr info it legal mail office ops pr press qa sales support team".split())
TITLES = frozenset("dr mr mrs ms mx prof sir herr frau hr".split())
_FOLDS = {
    "a": "àáâãäåāăąÀÁÂÃÄÅĀ", "c": "çćčÇĆČ", "e": "èéêëēěęÈÉÊËĒ", "i": "ìíîïīÌÍÎÏ", "n": "ñńňÑ", "o": "òóôõöøōőÒÓÔÕÖØ", "u": "ùúûüūůűÙÚÛÜ", "y": "ýÿÝ", "g": "ğĞ", "s": "şšśŞŠ",
    "z": "žźżŽ", "l": "łŁ", "r": "řŘ", "t": "ťŤ", "d": "ďĎ",
}
_FOLD = {ord(c): to for to, letters in _FOLDS.items() for c in letters} | {ord("ß"): "ss"} | {ord(c): None for c in INVISIBLE}


def name_parts(person: str) -> list[str] | None:
    """Folded parts of a name; None if there are none, or letters that can't be folded."""
    folded = person.translate(_FOLD)
    if any(c.isalpha() and not c.isascii() for c in folded):
        return None
    return re.findall("[a-z]+", folded.lower()) or None


def name_match(local: str, person: str) -> bool:
    """Whether a mailbox spells a person: both names either way round, one of them and an initial, one alone if long, or all initials."""
    parts = [p for p in name_parts(person) or () if p not in TITLES]
    pieces = [p for p in re.split("[._-]", re.sub("[0-9]+$", "", local).lower()) if p]
    joined = "".join(pieces)
    if not parts or not joined or joined in ROLES:
        return False
    given, family = parts[0], parts[-1]
    spelled = {given + family, family + given, given[0] + family, given + family[0], family + given[0]} | {n for n in (given, family) if len(n) >= 4}
    if len(parts) >= 2:
        spelled.add("".join(p[0] for p in parts))
    if len(pieces) >= 3:
        spelled.add("".join(parts))
    return joined in spelled or pieces in ([given, family], [family, given], [given[0], family], [given, family[0]])


def distance_factor(lines: int) -> np.float32:
    return np.float32(1.0 if lines <= 3 else 0.9 if lines <= 6 else 0.7)


@dataclass
class _Draft:
    anchor: int
    block: int
    line: int
    person: int | None
    org: int | None
    members: list[int] = field(default_factory=list)


class _Grouper:
    def __init__(self, text: str, entities: list[Entity], blocks: list[Block]):
        self.data, self.entities, self.blocks = text.encode(), entities, blocks
        starts = [b.start for b in blocks]
        lines = [[x.start for x in b.lines] for b in blocks]
        self.place: list[tuple[int, int] | None] = []
        for e in entities:
            b = bisect.bisect_right(starts, e.start) - 1
            self.place.append((b, bisect.bisect_right(lines[b], e.start) - 1) if b >= 0 else None)
        self.owner: list[int | None] = [None] * len(entities)
        self.confidence = [np.float32(1)] * len(entities)
        self.drafts: list[_Draft] = []
        self.in_block: dict[int, list[int]] = {}

    def text_of(self, i: int) -> str:
        e = self.entities[i]
        return self.data[e.start : e.end].decode("utf-8", "replace")

    def anchors(self) -> None:
        by_block: dict[int, list[int]] = {}
        for i, at in enumerate(self.place):
            if at:
                by_block.setdefault(at[0], []).append(i)
        for block in sorted(by_block):
            kinds = {i: self.entities[i].kind for i in by_block[block]}
            wanted = "person" if "person" in kinds.values() else "org"
            for i in by_block[block]:
                if kinds[i] == wanted:
                    self.owner[i], self.confidence[i] = len(self.drafts), np.float32(self.entities[i].confidence)
                    self.in_block.setdefault(block, []).append(len(self.drafts))
                    self.drafts.append(_Draft(i, block, self.place[i][1], i if wanted == "person" else None, i if wanted == "org" else None))

    def assign(self, i: int, draft: int, factor: np.float32) -> bool:
        sure = np.float32(self.entities[i].confidence) * np.float32(factor)
        if sure < np.float32(FLOOR):
            return False
        self.owner[i], self.confidence[i] = draft, sure
        self.drafts[draft].members.append(i)
        return True

    def orgs(self) -> None:
        """An organization goes to the nearest person, within three lines, without another name between, preceding on a tie."""
        named = [i for i, e in enumerate(self.entities) if e.kind in ("person", "org")]
        rank = {i: r for r, i in enumerate(named)}
        for i, at in enumerate(self.place):
            if not at or self.entities[i].kind != "org" or self.owner[i] is not None:
                continue
            beside = [named[r] for r in (rank[i] - 1, rank[i] + 1) if 0 <= r < len(named)]
            options = []
            for d in self.in_block.get(at[0], ()):
                draft = self.drafts[d]
                away = abs(draft.line - at[1])
                if draft.person in beside and draft.org is None and away <= 3:
                    options.append((away, draft.person > i, d))
            if options:
                away, _, d = min(options)
                if self.assign(i, d, distance_factor(away)):
                    self.drafts[d].org = i

    def details(self) -> None:
        on_line: dict[tuple[int, int], list[int]] = {}
        for i, at in enumerate(self.place):
            if at and self.entities[i].kind in DETAILS:
                on_line.setdefault(at, []).append(i)
        for i, at in enumerate(self.place):
            if at and self.entities[i].kind in DETAILS and self.owner[i] is None:
                found = self._named(i, *at, on_line)
                if found:
                    self.assign(i, *found)

    def _named(self, i: int, block: int, line: int, on_line: dict) -> tuple[int, np.float32] | None:
        """The contact that the first rule which applies names, and what of the confidence stays."""
        one = np.float32(1)
        here = [(d, self.drafts[d].line) for d in self.in_block.get(block, ())]
        start = self.entities[i].start
        begin = lambda d: self.entities[self.drafts[d].anchor].start
        same = [d for d, x in here if x == line]
        if len(same) == 1:
            return same[0], one
        if self.entities[i].kind == "email":
            local = (self.entities[i].normalized or self.text_of(i)).split("@")[0]
            spelled = [d for d, _ in here if self.drafts[d].person is not None and name_match(local, self.text_of(self.drafts[d].person))]
            if len(spelled) == 1:
                return spelled[0], one
        if line > 0 and not any(begin(d) < start for d in same):
            owners = {self.owner[j] for j in on_line.get((block, line - 1), ()) if self.owner[j] is not None}
            if len(owners) == 1:
                return owners.pop(), one
        before = [(x, begin(d), d) for d, x in here if x <= line and begin(d) <= start]
        if before:
            x, _, d = max(before)
            return d, distance_factor(line - x)
        below = [(x, d) for d, x in here if 0 < x - line <= 2]
        if below and self.blocks[block].short_lines:
            return min(below)[1], np.float32(0.9)
        return None

    def orphans(self) -> None:
        """A short block without a name, one blank line under a signature with a contact, gives its details to that block's last contact."""
        for b in range(1, len(self.blocks)):
            block, above = self.blocks[b], self.blocks[b - 1]
            if not (block.short_lines and block.gap_lines == 1 and above.short_lines and above.kind in ("signature", "quoted_reply")) or b in self.in_block or b - 1 not in self.in_block:
                continue
            last = max(self.in_block[b - 1], key=lambda d: self.entities[self.drafts[d].anchor].start)
            for i, at in enumerate(self.place):
                if at and at[0] == b and self.entities[i].kind in DETAILS and self.owner[i] is None:
                    self.assign(i, last, np.float32(0.8))

    def assembled(self) -> tuple[list[Contact], list[Entity]]:
        contacts, taken = [], set()
        for draft in self.drafts:
            block = self.blocks[draft.block]
            if not draft.members and not block.short_lines and block.kind not in ("header", "table_row"):
                continue
            members = sorted([draft.anchor, *draft.members])
            taken |= set(members)
            own = [self.entities[i] for i in members]
            one = lambda kind: next((e for e in own if e.kind == kind), None)
            listed = lambda kind: [e for e in own if e.kind == kind]
            sure = float(min(self.confidence[i] for i in members))
            contacts.append(Contact(min(e.start for e in own), max(e.end for e in own), sure, one("person"), one("org"), listed("address"), listed("email"), listed("phone")))
        rest = [e for i, e in enumerate(self.entities) if i not in taken]
        return sorted(contacts, key=lambda c: c.start), sorted(rest, key=lambda e: e.start)


def group(text: str, entities: list[Entity]) -> tuple[list[Contact], list[Entity]]:
    """(contacts, unassigned) of entities sorted by start; no bands are applied."""
    work = _Grouper(text, entities, split_blocks(text))
    work.anchors()
    work.orgs()
    work.details()
    work.orphans()
    return work.assembled()


def apply_bands(contacts: list[Contact], unassigned: list[Entity], include_uncertain: bool = False) -> tuple[list[Contact], list[Entity]]:
    """Contacts below 0.5 dissolve unless asked for; below 0.85 they are for review."""
    kept, rest = [], list(unassigned)
    for c in contacts:
        c.review_recommended = np.float32(c.confidence) < np.float32(0.85)
        if np.float32(c.confidence) < np.float32(FLOOR) and not include_uncertain:
            rest += c.members()
        else:
            kept.append(c)
    return kept, sorted(rest, key=lambda e: e.start)
