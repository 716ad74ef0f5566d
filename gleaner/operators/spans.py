"""Spans: masks, windows over long texts, greedy merges."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from gleaner.schema import Entity

from .tokens import Token

#: Fixed values.
MOST_ENTITY_TOKENS, MARGIN, WINDOW, UNBROKEN, CUT_SEARCH, SKIP_SPLIT = 256, 64, 2048, 4096, 256, 32
OVERLAP = MOST_ENTITY_TOKENS + 2 * MARGIN


class InputTooLarge(ValueError):
    """A run of tokens without white space is longer than windows can cut."""


class Mask:
    """Disjoint byte ranges that are content: those scanned without those skipped."""

    def __init__(self, scanned: list[tuple[int, int]], skipped: list[tuple[int, int]] = ()):
        self.ranges: list[tuple[int, int]] = []
        skips = sorted(skipped)
        for start, end in scanned:
            at = start
            for s, e in skips[max(0, bisect.bisect_left(skips, (start, -1)) - 1) :]:
                if s >= end:
                    break
                if e > at:
                    if s > at:
                        self.ranges.append((at, s))
                    at = e
            if at < end:
                self.ranges.append((at, end))
        self._ends = [e for _, e in self.ranges]

    def contains(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self._ends, start)
        return i < len(self.ranges) and self.ranges[i][0] <= start and end <= self.ranges[i][1]


def retained(tokens: list[Token]) -> list[int]:
    """Places of tokens that aren't white space."""
    return [i for i, t in enumerate(tokens) if t.is_content]


def breaks(tokens: list[Token], kept: list[int]) -> list[int]:
    """What stands before each retained token: 0 nothing, 1 space, 2 a line break, 3 more of them; the first one has 3."""
    out = []
    for n, i in enumerate(kept):
        between = tokens[kept[n - 1] + 1 : i] if n else []
        out.append(3 if not n else 0 if not between else 1 + min(2, sum(t.kind == "newline" for t in between)))
    return out


@dataclass(frozen=True)
class Window:
    """Retained positions start..end of the piece piece_start..piece_end."""

    start: int
    end: int
    piece_start: int
    piece_end: int

    def trusts(self, first: int, last: int, margin: int = MARGIN) -> bool:
        """Whether first..last is far enough from every edge that isn't the piece's own."""
        return (self.start == self.piece_start or first >= self.start + margin) and (self.end == self.piece_end or last + margin < self.end)


def _pieces(masked: list[bool] | None, n: int) -> list[tuple[int, int]]:
    """What long masked runs leave."""
    if masked is None:
        return [(0, n)]
    out, start, i = [], 0, 0
    while i < n:
        if masked[i]:
            run = i
            while i < n and masked[i]:
                i += 1
            if i - run >= SKIP_SPLIT:
                out.append((start, run))
                start = i
        else:
            i += 1
    return [(a, b) for a, b in [*out, (start, n)] if a < b]


def windows(before: list[int], window: int = WINDOW, overlap: int = OVERLAP, masked: list[bool] | None = None) -> list[Window]:
    """Windows of at most ``window`` positions that overlap by ``overlap`` or more, cut at paragraphs before lines before spaces; before: what breaks() gives."""
    out: list[Window] = []
    if not before:
        return out
    for a, b in _pieces(masked, len(before)):
        run = 0
        for x in before[a:b]:
            run = run + 1 if x == 0 else 0
            if run > UNBROKEN:
                raise InputTooLarge(f"more than {UNBROKEN} tokens without white space")
    inside = lambda i: masked is not None and 0 < i < len(masked) and masked[i] and masked[i - 1]
    for a, b in _pieces(masked, len(before)):
        start = a
        while start + window < b:
            target = start + window
            low = max(start + 1, target - CUT_SEARCH)
            cut = next((i for wanted in (3, 2, 1) for i in range(target, low - 1, -1) if before[i] == wanted), target)
            back = cut
            while back > start and inside(back):
                back -= 1
            if back == start:
                back = cut
                while back < len(before) and masked[back]:
                    back += 1
            out.append(Window(start, back, a, b))
            following = max(start + 1, back - overlap)
            low = max(start + 1, following - MARGIN)
            while following > low and before[following] == 0:
                following -= 1
            start = following
        out.append(Window(start, b, a, b))
    return out


def merge(spans: list[Entity], mask: Mask | None = None) -> list[Entity]:
    """Of overlapping spans the best: rules, then the longer, the surer, the earlier; of equal ones the best alone."""
    rank = lambda e: (e.source != "rules", e.start - e.end, -e.confidence, e.start)
    starts: list[int] = []
    kept: dict[int, Entity] = {}
    for e in sorted((e for e in spans if mask is None or mask.contains(e.start, e.end)), key=rank):
        at = bisect.bisect_left(starts, e.end)
        if at == 0 or kept[starts[at - 1]].end <= e.start:
            starts.insert(at, e.start)
            kept[e.start] = e
    return [kept[s] for s in starts]


def fold_merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """By start and then the longer: what overlaps the last one kept goes."""
    kept: list[tuple[int, int]] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1])):
        if not kept or s[0] >= kept[-1][1]:
            kept.append(s)
    return kept


def owned_windows(text: str, stride: int = 1200, overlap: int = 300) -> list[tuple[int, int, int]]:
    """(start, end, owned_to) of overlapping windows of characters, cut at spaces; each start is owned by one window."""
    out, start, n = [], 0, len(text)
    while True:
        end = min(n, start + stride + overlap)
        if end < n:
            space = text.rfind(" ", start + stride, end)
            end = space if space > start else end
        owned = n if end >= n else min(end, start + stride)
        out.append((start, end, owned))
        if owned >= n:
            return out
        start = owned
