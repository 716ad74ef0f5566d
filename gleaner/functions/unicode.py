"""Classes and scripts of characters. The ranges are fixed values: they decide where tokens end."""

from __future__ import annotations

SCRIPTS = ("latin", "cyrillic", "georgian", "arabic", "hebrew", "greek", "han", "hiragana", "katakana", "hangul", "thai", "devanagari", "other")

#: Hexadecimal ranges of code points.
RANGES = {
    "latin": "0041-005A 0061-007A 00AA 00B5 00BA 00C0-00D6 00D8-00F6 00F8-024F 0250-02AF 1E00-1EFF 2C60-2C7F A720-A7FF FF21-FF3A FF41-FF5A",
    "cyrillic": "0400-0482 048A-052F 1C80-1C8F 2DE0-2DFF A640-A69F",
    "georgian": "10A0-10FA 10FC-10FF 1C90-1CBF 2D00-2D2F",
    "arabic": "0620-064A 066E-066F 0671-06D3 06D5 06EE-06EF 06FA-06FC 06FF 0750-077F 08A0-08C9 FB50-FBFF FC00-FDFF FE70-FEFC",
    "hebrew": "05D0-05EA 05EF-05F2 FB1D-FB4F",
    "greek": "0370-0373 0376-037D 037F-0383 0386-03FF 1F00-1FFF",
    "hiragana": "3041-3096 309D-309F",
    "katakana": "30A1-30FF 31F0-31FF FF66-FF9D",
    "han": "2E80-2FDF 3005-3007 3021-3029 3038-303B 3400-4DBF 4E00-9FFF F900-FAFF 20000-2FA1F",
    "hangul": "1100-11FF 3131-318E A960-A97F AC00-D7A3 D7B0-D7FF",
    "thai": "0E01-0E30 0E32-0E33 0E40-0E46",
    "devanagari": "0904-0939 093D 0950 0958-0961 0972-097F A8E0-A8FF",
}
COMBINING = (
    "0300-036F 0483-0489 0591-05BD 05BF 05C1-05C2 05C4-05C5 05C7 0610-061A 064B-065F 0670 06D6-06DC 06DF-06E4 06E7-06E8 06EA-06ED 0900-0903 093A-093C 093E-094F 0951-0957 0962-0963 "
    "0E31 0E34-0E3A 0E47-0E4E 1AB0-1AFF 1DC0-1DFF 20D0-20FF 3099-309A FE00-FE0F FE20-FE2F 1F3FB-1F3FF E0100-E01EF"
)
PUNCTUATION = (
    "00A1-00A9 00AB-00B4 00B6-00B9 00BB-00BF 00D7 00F7 055A-055F 0589-058A 05BE 05C0 05C3 05C6 05F3-05F4 0609-060D 061B-061F 066A-066D 06D4 0964-0965 0970 0E4F 0E5A-0E5B 10FB "
    "2010-2027 2030-205E 20A0-20CF 2100-214F 2190-21FF 2200-22FF 2300-23FF 2500-27BF 2E00-2E7F 3001-3004 3008-3020 3030-3037 303D-303F 30FB FE30-FE4F FE50-FE6B FF01-FF0F FF1A-FF20 "
    "FF3B-FF40 FF5B-FF65"
)
INVISIBLE = "\u00ad\u200c\u200d\u2060"
SPACES = " \t\x0b\x0c\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\ufeff\u202f\u205f\u3000"
NEWLINES = "\n\r\x85\u2028\u2029"


def _ranges(spec: str) -> list[tuple[int, int]]:
    return [(int(a, 16), int(b or a, 16)) for a, _, b in (x.partition("-") for x in spec.split())]


_SCRIPT_RANGES = [(name, _ranges(spec)) for name, spec in RANGES.items()]
COMBINING_RANGES = _ranges(COMBINING)
_OTHERS = [("combining", COMBINING_RANGES), ("punct", _ranges(PUNCTUATION))]
_DIGITS = [("digit", [(0x30, 0x39)]), ("wide_digit", [(0xFF10, 0xFF19)]), ("arabic_digit", [(0x660, 0x669), (0x6F0, 0x6F9)])]


def classify(code: int) -> str:
    """newline, space, a kind of digit, combining, punct, a script, or other."""
    c = chr(code)
    if c in NEWLINES:
        return "newline"
    if c in INVISIBLE:
        return "combining"
    if c in SPACES:
        return "space"
    if code < 0x80 and not c.isalnum() and c.isprintable():
        return "punct"
    for name, ranges in (*_DIGITS, *_OTHERS, *_SCRIPT_RANGES):
        if any(a <= code <= b for a, b in ranges):
            return name
    return "other"
