"""Email addresses as people write them in running text: no quoted local parts, comments or IP literals."""

from __future__ import annotations

import re

from gleaner.schema import Entity

_LETTERS = b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: What a local part may hold, what marks where one begins, what is cut from a domain's end.
LOCAL = _LETTERS + b"!#$%&'*+/=?^_`{|}~-."
DELIMITERS = b"`*{}|="
TRAILING = b".,;:)]>'\"-"
MOST_LOCAL, MOST_LABEL, MOST_DOMAIN = 64, 63, 253

_AFTER_DELIMITER = LOCAL.translate(None, DELIMITERS)
_DOMAIN = re.compile(rb"[A-Za-z0-9.-]*")
_LABEL = re.compile(rb"(?!-)[A-Za-z0-9-]{1,%d}(?<!-)" % MOST_LABEL)
_COMMON_END = re.compile(rb"[A-Za-z]{2,24}")


def confidence(local: bytes, domain: bytes) -> float | None:
    """None for what isn't an address, 0.99 with an alphabetic top-level domain, else 0.7."""
    if not 0 < len(local) <= MOST_LOCAL or local.startswith(b".") or local.endswith(b".") or b".." in local or len(domain) > MOST_DOMAIN:
        return None
    labels = domain.split(b".")
    if len(labels) < 2 or not all(map(_LABEL.fullmatch, labels)):
        return None
    return 0.99 if _COMMON_END.fullmatch(labels[-1]) else 0.7


def scan(text: str | bytes | None) -> list[Entity]:
    """All addresses of a text, in order, none overlapping. Linear: what lies between two signs is looked at once."""
    data = text if isinstance(text, bytes) else (text or "").encode()
    found: list[Entity] = []
    at, seen, space, scheme, done = data.find(b"@"), 0, -1, -1, 0
    while at >= 0:
        gap = data[seen:at]
        space = max(space, *(seen + k if (k := gap.rfind(c)) >= 0 else -1 for c in (b" ", b"\t", b"\n", b"\x0c", b"\r")))
        if (k := gap.rfind(b"://")) >= 0:
            scheme = seen + k
        seen = at
        before = data[max(done, found[-1].end if found else 0) : at]
        local = before[len(before.rstrip(_AFTER_DELIMITER)) :].lstrip(b"'")
        start = at - len(local)
        last = _DOMAIN.match(data, at + 1).end()
        end = at + 1 + len(data[at + 1 : last].rstrip(TRAILING))
        done, following = at + 1, data.find(b"@", max(end, at + 1))
        left = data[start - 1 : start] if start else b""
        if left != b"@" and data[end : end + 1] != b"@" and left not in (b"/", b"\\") and not local.startswith(b"/") and scheme <= space:
            domain = data[at + 1 : end]
            if (score := confidence(local, domain)) is not None:
                found.append(Entity("email", start, end, score, normalized=f"{local.decode()}@{domain.decode().lower()}"))
        at = following
    return found


def whole(candidate: str) -> Entity | None:
    """The candidate as one address, if it is that throughout."""
    found = scan(candidate)
    return found[0] if len(found) == 1 and found[0].start == 0 and found[0].end == len(candidate.encode()) else None
