"""What of a Markdown document may be scanned, as byte ranges of the source: runs of inline content, what in them is skipped, and link targets.

Reads the blocks and inlines that people write: front matter, fenced and indented code, HTML
blocks, headings, rules, quotes, lists, tables, reference definitions; code spans, links,
images, autolinks, inline HTML. Nested lists and quotes are read line by line, so a paragraph
that goes on lazily across containers may be cut where a full parser would join it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from gleaner.functions.offsets import byte_offsets
from gleaner.schema import Entity

from . import regions, rules
from .spans import Mask


@dataclass(frozen=True)
class Options:
    include_code: bool = False
    include_html: bool = False
    gfm_tables: bool = True


@dataclass(frozen=True)
class Link:
    dest: str
    start: int
    end: int
    text_start: int
    text_end: int


@dataclass
class Selection:
    scan: list[tuple[int, int]] = field(default_factory=list)
    skip: list[tuple[int, int]] = field(default_factory=list)
    links: list[Link] = field(default_factory=list)

    def mask(self) -> Mask:
        return Mask(self.scan, self.skip)


MOST_FRONT = 64 * 1024
_FRONT = re.compile(r"(---|\+\+\+)[ \t]*\r?\n(?:.*\r?\n)*?(?:\1|(?<=)\.\.\.)[ \t]*(?:\r?\n|\Z)")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\n|\r|\Z)")
_FENCE = re.compile(r" {0,3}(`{3,}(?=[^`]*\Z)|~{3,})")
_HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]+|\Z)")
_HEADING_END = re.compile(r"(?:(?:[ \t]+|\A)#+)?[ \t]*\Z")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})\Z")
_SETEXT = re.compile(r" {0,3}(?:=+|-+)[ \t]*\Z")
_QUOTE = re.compile(r" {0,3}> ?")
_BULLET = re.compile(r"( {0,3})([-+*]|[0-9]{1,9}[.)])( {1,4}(?! )|\t| (?= {4})|(?=\Z))")
_DEFINITION = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:[ \t]*(?:<([^<>]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*\Z")
_FOOTNOTE = re.compile(r" {0,3}\[\^[^\]\s]+\]:[ \t]*")
_HTML_BLOCK = re.compile(
    r" {0,3}<(?:(?P<raw>(?i:script|pre|style|textarea))(?=[\s>]|\Z)|(?P<comment>!--)|(?P<pi>\?)|(?P<cdata>!\[CDATA\[)|(?P<decl>![A-Za-z])|/?(?i:address|article|aside|base|basefont|blockquote|"
    r"body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|"
    r"menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul)(?=[\s/>]|\Z)|(?P<any>/?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>\s*\Z))"
)
_HTML_ENDS = {"raw": re.compile(r"</(?:script|pre|style|textarea)>", re.I), "comment": re.compile("-->"), "pi": re.compile(r"\?>"), "cdata": re.compile(r"\]\]>"), "decl": re.compile(">")}
_CELL_RULE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*\Z")
_CELL = re.compile(r"(?:\\.|`[^`]*`|[^|\\])+")
_INLINE = re.compile(
    r"\\[!-/:-@\[-`{-~]|(?P<code>(?<!`)(?P<ticks>`+)(?!`)(?s:.+?)(?<!`)(?P=ticks)(?!`))|<(?P<mail>[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*)>|"
    r"<(?P<uri>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*)>|(?P<html></?[A-Za-z][A-Za-z0-9-]*(?:\s[^<>]*)?/?>|<!--(?s:.*?)-->|<\?(?s:.*?)\?>|<![A-Za-z][^>]*>)|(?P<open>!?\[)|(?P<close>\])"
)
_TARGET = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
_REFERENCE = re.compile(r"\[((?:[^\[\]\\]|\\.)*)\]")


def _label(text: str) -> str:
    return " ".join(text.split()).lower()


class _Selector:
    def __init__(self, text: str, options: Options):
        self.text, self.options = text, options
        self.runs: list[tuple[int, int]] = []
        self.skips: list[tuple[int, int]] = []
        self.links: list[Link] = []
        self.pending: list[list[tuple[int, int]]] = []
        self.definitions: dict[str, str] = {}

    # Blocks.

    def blocks(self, at: int) -> None:
        """Reads lines; what a paragraph, heading or cell holds is kept for inlines()."""
        open_lines: list[tuple[int, int]] = []
        fence, html, depth_indent, blank_before, table = "", None, 0, True, False
        block_start, code_start, depth, code_end = at, at, 0, -1

        def close() -> None:
            nonlocal open_lines
            if open_lines:
                self.pending.append(open_lines)
            open_lines = []

        for m in _LINE.finditer(self.text, at):
            start, stop = m.start(), m.end()
            if start == stop:
                break
            end = start + len(m[0].rstrip("\r\n"))
            if fence:
                inner = self.text[start:end]
                if re.fullmatch(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*", inner[min(len(inner), depth_indent) :] if inner[:depth_indent].isspace() else inner):
                    self._opaque("code", block_start, end, code_start, start)
                    fence = ""
                continue
            if html:
                ended = html.search(self.text, start, end) if html is not True else not self.text[start:end].strip()
                if ended:
                    last = start if html is True else end
                    self._opaque("html", block_start, last, block_start, start if html is True else stop)
                    html = None
                    if self.text[start:end].strip():
                        continue
                else:
                    continue
            p, quotes = start, 0
            while q := _QUOTE.match(self.text, p, end):
                p, quotes = q.end(), quotes + 1
            if quotes > depth or not open_lines:
                close()
                depth = quotes
            line = self.text[p:end]
            if not line.strip():
                close()
                blank_before, table = True, False
                continue
            indent = len(line) - len(line.lstrip(" "))
            if depth_indent and indent >= depth_indent:
                p, indent = p + depth_indent, indent - depth_indent
            elif depth_indent and blank_before and indent < depth_indent and not _BULLET.match(line):
                depth_indent = 0
            line = self.text[p:end]
            if table and "|" in line:
                self._cells(p, end)
                continue
            table = False
            if not open_lines and (indent >= 4 or line.startswith("\t")) and blank_before:
                first = p + (4 if indent >= 4 else 1)
                mine = self.runs if self.options.include_code else self.skips
                if code_end >= 0 and mine and mine[-1][1] == code_end and not self.text[code_end:p].strip():
                    mine[-1] = (mine[-1][0], stop)
                else:
                    mine.append((first, stop))
                code_end = stop
                continue
            while not (_RULE.match(line) and not open_lines) and (b := _BULLET.match(line)) and (not open_lines or b[3]) and not (open_lines and _SETEXT.match(line)):
                if _RULE.match(line):
                    break
                close()
                depth_indent += b.end() if b[3].strip() == "" and b[3] else b.end() + 1
                p, line = p + b.end(), line[b.end() :]
            blank_before, setext = False, open_lines and _SETEXT.match(line)
            if setext or _RULE.match(line):
                close()
            elif h := _HEADING.match(line):
                close()
                tail = _HEADING_END.search(line, h.end())
                if tail.start() > h.end():
                    self.pending.append([(p + h.end(), p + tail.start())])
            elif f := _FENCE.match(line):
                close()
                fence, block_start, code_start = f[1], p, stop
            elif (x := _HTML_BLOCK.match(line)) and not (open_lines and x["any"]):
                close()
                kind = next((k for k in _HTML_ENDS if x[k]), None)
                block_start = p
                if kind and _HTML_ENDS[kind].search(line, x.end()):
                    self._opaque("html", p, end, p, stop)
                else:
                    html = _HTML_ENDS[kind] if kind else True
            elif not open_lines and (d := _DEFINITION.match(line)) and not d[1].startswith("^"):
                self.definitions.setdefault(_label(d[1]), d[2] if d[2] is not None else d[3])
            elif len(open_lines) == 1 and self.options.gfm_tables and _CELL_RULE.match(line) and "|" in self.text[slice(*open_lines[0])]:
                self._cells(*open_lines[0])
                open_lines, table = [], True
            else:
                if not open_lines and (n := _FOOTNOTE.match(line)):
                    p, line = p + n.end(), line[n.end() :]
                lead = len(line) - len(line.lstrip(" \t"))
                open_lines.append((p + lead, end))
        close()
        if fence or html:
            self._opaque("code" if fence else "html", block_start, len(self.text), code_start if fence else block_start, len(self.text))

    def _opaque(self, kind: str, start: int, end: int, inner: int, inner_end: int) -> None:
        """A block of code or HTML: skipped, or if asked for scanned from inner on, as it is."""
        if not (self.options.include_code if kind == "code" else self.options.include_html):
            self.skips.append((start, end))
        elif inner < inner_end:
            self.runs.append((inner, inner_end))

    def _cells(self, start: int, end: int) -> None:
        for m in _CELL.finditer(self.text, start, end):
            inner = m[0].strip()
            if inner:
                at = m.start() + m[0].index(inner)
                self.pending.append([(at, at + len(inner))])

    # Inlines.

    def inlines(self, lines: list[tuple[int, int]]) -> None:
        """One run, with what in it is skipped."""
        start, end = lines[0][0], lines[-1][0] + len(self.text[slice(*lines[-1])].rstrip())
        if start >= end:
            return
        self.runs.append((start, end))
        opened: list[tuple[int, bool]] = []
        at = start
        while m := _INLINE.search(self.text, at, end):
            at = m.end()
            if m["code"]:
                if not self.options.include_code:
                    self.skips.append(m.span())
            elif m["mail"] or m["uri"]:
                a, b = m.span("mail" if m["mail"] else "uri")
                self._link(f"mailto:{m['mail']}" if m["mail"] else m["uri"], m.start(), m.end(), a, b)
            elif m["html"]:
                if not self.options.include_html:
                    self.skips.append(m.span())
            elif m["open"]:
                opened.append((m.start(), m["open"] == "!["))
            elif m["close"] and opened:
                at = self._closed(opened, m.start(), end) or at

    def _closed(self, opened: list[tuple[int, bool]], close: int, end: int) -> int | None:
        """Ends a link or image at a closing bracket, if it is one; where it ends."""
        start, image = opened.pop()
        inner = start + (2 if image else 1)
        target = _TARGET.match(self.text, close + 1, end)
        reference = None if target else _REFERENCE.match(self.text, close + 1, end)
        if target:
            dest, after = target[1] if target[1] is not None else target[2], target.end()
        else:
            label = reference[1] if reference and reference[1] else self.text[inner:close]
            dest, after = self.definitions.get(_label(label)), reference.end() if reference else close + 1
            if dest is None:
                return None
        if image:
            self.skips = [s for s in self.skips if not (start <= s[0] and s[1] <= after)]
            self.links = [x for x in self.links if not (start <= x.start and x.end <= after)]
            self.skips.append((start, after))
        elif inner < close:
            self._link(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", dest), start, after, inner, close)
            opened[:] = [o for o in opened if o[1]]  # no links within links
        else:
            self.skips.append((start, after))
        return after

    def _link(self, dest: str, start: int, end: int, text_start: int, text_end: int) -> None:
        self.skips += [s for s in ((start, text_start), (text_end, end)) if s[0] < s[1]]
        self.links.append(Link(dest, start, end, text_start, text_end))


def select(text: str, options: Options = Options()) -> Selection:
    work, at, places = _Selector(text, options), 0, byte_offsets(text)
    front = _FRONT.match(text[:MOST_FRONT]) if text.startswith(("---", "+++")) else None
    if front:
        at = front.end()
        work.skips.append((0, len(front[0].rstrip("\r\n"))))
    work.blocks(at)
    for lines in work.pending:
        work.inlines(lines)
    byte = lambda spans: sorted({(places[a], places[b]) for a, b in spans})
    links = [Link(x.dest, places[x.start], places[x.end], places[x.text_start], places[x.text_end]) for x in work.links]
    return Selection(byte(work.runs), byte(work.skips), sorted(links, key=lambda x: (x.start, x.end)))


def scan(text: str, selected: Selection, hints: list[str]) -> tuple[list[str], list[Entity]]:
    """(regions, entities) of the visible text and its links; what is hidden neither counts as evidence nor is found."""
    data, mask = text.encode(), selected.mask()
    used = hints
    if not used:
        seen = bytearray(b if b in b"\r\n" else 32 for b in data)
        for a, b in mask.ranges:
            seen[a:b] = data[a:b]
        mails = "\n".join(x.dest[7:] for x in selected.links if x.dest.lower().startswith("mailto:"))
        numbers = "\n".join(x.dest[4:] for x in selected.links if x.dest.lower().startswith("tel:"))
        used = regions.infer(f"{seen.decode('utf-8', 'replace')}\n{mails}\n{numbers}")
    found = [e for e in rules.scan(text, used)[1] if mask.contains(e.start, e.end)] if used else [e for e in rules.scan(text, ["ZZ"])[1] if mask.contains(e.start, e.end)]
    linked = [e for x in selected.links if (e := rules.from_link(x.dest, x.text_start, x.text_end, used))]
    return list(used), rules.merge_links(found, linked)
