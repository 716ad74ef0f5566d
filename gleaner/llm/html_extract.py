"""Main text of web pages: boosted trees over DOM nodes, decoded so that no kept node hangs under a dropped one."""

from __future__ import annotations

import functools
import html as entities
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_batches

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_NAMES = re.compile(r"(?:^|\s)(?:class|id|role|itemprop|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Whose content browsers never show as text: scripts, styles, form controls, and what stands in for frames.
_SILENT = frozenset("head title script style template iframe noframes noembed select textarea datalist".split())
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "iframe", "noembed", "noframes")}
#: Whose begin and end part text; all others, unknown ones too, are within a line.
_BLOCK = frozenset(
    (
        "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt embed fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 head header "
        "hgroup hr html legend li link main menu meta nav ol optgroup option p param pre script search section source style summary table tbody td template tfoot th thead title tr track ul"
    ).split()
)
#: Links and controls: in a line, but maybe all there is of a menu or form.
_DECIDED = frozenset("a button label input output img picture".split())
_ENDS_SAME = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
_SAME = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}

_TAG_GROUPS = (
    "article", "main", "section", "div", "p", "h1", "h2", "h3 h4 h5 h6", "ul ol dl menu", "li dt dd", "a", "nav", "header", "footer", "aside", "form fieldset",
    "button input label legend option output", "figure figcaption img picture", "table tbody thead tfoot tr td th caption", "blockquote pre", "span b i em strong small u", "html body",
)
_GROUP_OF = {t: i for i, names in enumerate(_TAG_GROUPS) for t in names.split()}
_OTHER_TAG = len(_TAG_GROUPS)
_NAME_GROUPS = (
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager tabs toc hamburger skip",
    "header masthead topbar logo branding brand hero toolbar",
    "footer foot copyright legal colophon bottom imprint",
    "sidebar aside side rail widget widgets related recommended recommendations popular trending teaser teasers more secondary complementary",
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner adsense dfp adslot outbrain taboola affiliate commercial",
    "cookie cookies consent gdpr notice alert popup modal overlay paywall toast announcement disclaimer privacy dialog message",
    "form search login signin signup register newsletter subscribe subscription contact input poll survey",
    "comment comments commenter reply replies respond discussion disqus thread reader readers reviews",
    "share sharing social follow tweet like buttons",
    "meta byline author date published timestamp tags tag category categories",
    "content article post entry story text prose paragraph copy body articlebody",
    "main page wrapper container wrap layout site",
)
_NAME_OF = {w: 1 << i for i, words in enumerate(_NAME_GROUPS) for w in words.split()}
_N_NAMES = len(_NAME_GROUPS) + 1  # and hidden
_ABOVE = ("article", "main", "nav", "header", "footer", "aside", "form fieldset", "ul ol dl menu", "table tbody thead tfoot tr td th caption")
_ABOVE_OF = {_GROUP_OF[x.split()[0]]: 1 << i for i, x in enumerate(_ABOVE)}


@dataclass
class Page:
    """Elements in page order, as columns; follows: elements within a line that nothing names, which go with what they are in; texts: (element, text) and (-1, "") where a block begins or ends."""

    parent: list[int] = field(default_factory=list)
    end: list[int] = field(default_factory=list)
    group: list[int] = field(default_factory=list)
    names: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    silent: list[bool] = field(default_factory=list)
    marked: list[bool] = field(default_factory=list)
    follows: list[bool] = field(default_factory=list)
    texts: list[tuple[int, str]] = field(default_factory=list)


@functools.lru_cache(maxsize=20_000)
def _name_bits(attributes: str) -> int:
    bits = 0
    for value in _NAMES.findall(attributes):
        for word in _PARTS.findall(value):
            bits |= _NAME_OF.get(word.lower(), 0)
    if _HIDDEN.search(attributes):
        bits |= 1 << len(_NAME_GROUPS)
    return bits


def parse(html: str | None) -> Page:
    """The element tree of any text that browsers would show something for; an empty page has its root only."""
    page = Page([-1], [0], [_OTHER_TAG], [0], [0], [False], [False], [False])
    stack: list[tuple[int, str]] = [(0, "")]
    html = html or ""
    at, n = 0, len(html)
    texts = page.texts

    def pop_to(k: int) -> None:
        while len(stack) > k:
            i, name = stack.pop()
            page.end[i] = len(page.parent)
            if name in _BLOCK:
                texts.append((-1, ""))

    while at < n:
        m = _TAG.search(html, at)
        stop = m.start() if m else n
        if stop > at and not page.silent[stack[-1][0]]:
            texts.append((stack[-1][0], html[at:stop]))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        if m[1] or m[4]:  # an end tag; one of an inline element doesn't end blocks
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == name:
                    pop_to(k)
                    break
                if name not in _BLOCK and stack[k][1] in _BLOCK:
                    break
            continue
        if name in _BLOCK or name == "br":
            if name != "br":  # a paragraph ends where a block begins
                k = len(stack) - 1
                while k > 0 and stack[k][1] not in _BLOCK:
                    k -= 1
                if stack[k][1] == "p":
                    pop_to(k)
            if name in _ENDS_SAME:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k][1] in _SAME.get(name, (name,)):
                        pop_to(k)
                        break
                    if stack[k][1] in _ENDS_SAME[name]:
                        break
            texts.append((-1, ""))
        if name == "br":
            continue
        attributes = m[3] or m[6] or ""
        above, i = stack[-1][0], len(page.parent)
        page.parent.append(above)
        page.end.append(i + 1)
        page.group.append(_GROUP_OF.get(name, _OTHER_TAG))
        page.names.append(_name_bits(attributes) if attributes else 0)
        page.depth.append(len(stack))
        page.silent.append(page.silent[above] or name in _SILENT)
        page.marked.append("data-y" in attributes)
        page.follows.append(name not in _BLOCK and not page.names[i] and name not in _DECIDED)
        if name in _VOID or attributes.endswith("/") and name not in _GROUP_OF:
            continue
        stack.append((i, name))
        if name in _RAW:
            close = _RAW[name].search(html, at)
            at = close.start() if close else n
    pop_to(0)
    return page


_COUNTED = ("article", "main", "p", "h1", "h2", "h3 h4 h5 h6", "li dt dd", "a", "button input label legend option output", "figure figcaption img picture")
_COUNTED_OF = [_GROUP_OF[x.split()[0]] for x in _COUNTED]


def features(pages: list[Page]) -> np.ndarray:
    """A row of numbers for each element of all pages: its tag and names, those above it, what its subtree holds, and its siblings."""
    sizes = np.array([len(p.parent) for p in pages])
    base = np.concatenate(([0], np.cumsum(sizes)))
    n = int(base[-1])
    column = lambda f: np.fromiter((x for p in pages for x in getattr(p, f)), np.int64, n)
    root = np.repeat(base[:-1], sizes)
    parent, end, group, names, depth = column("parent"), column("end") + root, column("group"), column("names"), column("depth")
    top = parent < 0
    parent = np.where(top, root, parent + root)
    text, marks, words = np.zeros(n), np.zeros(n), np.zeros(n)
    for k, page in enumerate(pages):
        for i, t in page.texts:
            if i >= 0:
                j = base[k] + i
                text[j] += len(t) - t.count(" ") if not t.isspace() else 0
                words[j] += t.count(" ") + 1 if not t.isspace() else 0
                marks[j] += t.count(".") + t.count(",")
    over, chain = np.zeros(n, np.int64), np.zeros(n, np.int64)
    own = np.array([_ABOVE_OF.get(g, 0) for g in range(_OTHER_TAG + 1)])[group]
    linked = group == _GROUP_OF["a"]
    in_link = np.zeros(n, bool)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.flatnonzero(np.diff(depth[order])) + 1) if n else []
    if len(levels) <= 400:
        for level in levels[1:]:
            up = parent[level]
            over[level] = over[up] | names[up]
            chain[level] = chain[up] | own[up]
            in_link[level] = in_link[up] | linked[up]
    else:  # very deep pages, element by element
        for i in range(n):
            if not top[i]:
                up = parent[i]
                over[i], chain[i], in_link[i] = over[up] | names[up], chain[up] | own[up], in_link[up] or linked[up]
    in_link |= linked

    def below(x: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(x)))
        return total[end] - total[np.arange(n)]

    inside, in_links, nodes, dots, many = below(text), below(text * in_link), end - np.arange(n), below(marks), below(words)
    page_text = np.maximum(inside[root], 1)
    before = np.concatenate(([0], np.cumsum(text)))[:-1]
    before = before - before[root]
    siblings = np.bincount(parent[~top], minlength=n)
    alike = np.bincount(parent * (_OTHER_TAG + 1) + group, minlength=n * (_OTHER_TAG + 1)) if n else np.zeros(0)
    first = np.full(n, -1)
    kids = np.flatnonzero(~top)
    if len(kids):
        by = kids[np.argsort(parent[kids], kind="stable")]
        runs = np.concatenate(([0], np.flatnonzero(np.diff(parent[by])) + 1))
        lengths = np.diff(np.concatenate((runs, [len(by)])))
        first[by] = np.arange(len(by)) - np.repeat(runs, lengths)
    bits = lambda x, k: [(x >> i) & 1 for i in range(k)]
    rows = [
        *[group == g for g in range(_OTHER_TAG + 1)], *bits(names, _N_NAMES), *bits(over, _N_NAMES), *bits(chain, len(_ABOVE)),
        *[np.minimum(below(group == g), 8) for g in _COUNTED_OF],
        depth, np.log1p(inside), in_links / np.maximum(inside, 1), inside / nodes, dots / np.maximum(many, 1), many / nodes, np.log1p(text), inside / page_text,
        inside / np.maximum(inside[parent], 1), before / page_text, siblings[parent], np.maximum(first, 0), alike[parent * (_OTHER_TAG + 1) + group] if n else alike,
        (inside[parent] - inside) / np.maximum(siblings[parent] - 1, 1),
    ]
    return np.stack([np.asarray(r, np.float32) for r in rows], axis=1) if n else np.zeros((0, len(rows)), np.float32)


@dataclass
class Forest:
    """Boosted trees that ask one question a level: at most 2 ** depth leaves each."""

    edges: list[np.ndarray]
    questions: list[list[tuple[int, int]]]
    leaves: list[np.ndarray]
    bias: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left").astype(np.uint8) for f, e in enumerate(self.edges)]) if len(x) else np.zeros((len(self.edges), 0), np.uint8)

    def logit(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.bias)
        for questions, leaves in zip(self.questions, self.leaves, strict=True):
            code = np.zeros(len(x), np.intp)
            for f, t in questions:
                code = code * 2 + (b[f] > t)
            total += leaves[code]
        return total


def boost(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 5, rate: float = 0.3, penalty: float = 1.0, seed: int = 11) -> Forest:
    """Gradient boosting of log loss; each tree sees half the features, and each level takes the question of largest gain."""
    rng = np.random.default_rng(seed)
    edges = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        edges.append((values[:-1] + values[1:]) / 2 if len(values) <= 16 else np.unique(np.quantile(x[:, f], np.linspace(0.04, 0.96, 24))))
    mean = y.mean()
    forest = Forest(edges, [], [], float(np.log(mean / (1 - mean))))
    b, z = forest.bins(x), np.full(len(x), forest.bias)
    useful = np.array([f for f, e in enumerate(edges) if len(e)])
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        code, questions = np.zeros(len(x), np.int64), []
        chosen = rng.choice(useful, max(1, len(useful) // 2), replace=False)
        for level in range(depth):
            n, best = 1 << level, (0.0, 0, 0)
            for f in chosen:
                k = len(edges[f]) + 1
                at = code * k + b[f]
                gs, hs = (np.bincount(at, w, n * k).reshape(n, k).cumsum(axis=1) for w in (g, h))
                right, weight = gs[:, -1:] - gs, hs[:, -1:] - hs
                gain = (gs**2 / (hs + penalty) + right**2 / (weight + penalty))[:, :-1].sum(axis=0)
                t = int(gain.argmax())
                if gain[t] > best[0]:
                    best = (float(gain[t]), int(f), t)
            questions.append(best[1:])
            code = code * 2 + (b[best[1]] > best[2])
        sums = [np.bincount(code, w, 1 << depth) for w in (g, h)]
        leaves = rate * sums[0] / (sums[1] + penalty)
        forest.questions.append(questions)
        forest.leaves.append(leaves)
        z += leaves[code]
    return forest


# Pages to learn from: made up, with the layouts and names that sites use, and each part's role known.

_SYLLABLES = "ka to ri ne sol ma der ing est un lo pa vi che qua mi ber os al en tra po sten li".split()


def _words(rng, n: int) -> str:
    sizes = rng.integers(1, 4, n)
    parts, marks = iter(rng.integers(0, len(_SYLLABLES), sizes.sum()).tolist()), rng.random(n).tolist()
    made = ["".join(_SYLLABLES[next(parts)] for _ in range(k)) for k in sizes.tolist()]
    return " ".join(w + ("," if m < 0.06 else "." if m < 0.1 else "") for w, m in zip(made[:-1], marks, strict=False)) + (" " if n > 1 else "") + "".join(made[-1:])


def _sentence(rng, low: int = 5, high: int = 60) -> str:
    n = int(np.exp(rng.uniform(np.log(low), np.log(high))))
    return _words(rng, n).capitalize() + ("." if rng.random() < 0.85 else "")


def _el(rng, tag: str, names: str, inner: str, mark: bool = False, extra: str = "") -> str:
    """An element; one of the names, or now and then none, as class or id."""
    attributes = extra
    if names and rng.random() < 0.9:
        attributes += f' {rng.choice(["class", "id", "class"])}="{rng.choice(names.split("|"))}"'
    return f"<{tag}{attributes}{' data-y' if mark else ''}>{inner}</{tag}>"


def _links(rng, low: int, high: int) -> str:
    items = "".join(f'<li><a href="/{i}">{_words(rng, int(rng.integers(1, 5)))}</a></li>' for i in range(int(rng.integers(low, high))))
    return f"<ul>{items}</ul>" if rng.random() < 0.7 else re.sub("</?li>", " ", items)


def _furniture(rng, kind: str) -> str:
    plain = rng.random() < 0.4
    if kind == "nav":
        return _el(rng, "div" if plain else "nav", "menu|main-nav|navbar|navigation|breadcrumbs|top-menu|site-nav" if plain or rng.random() < 0.5 else "", _links(rng, 2, 9))
    if kind == "header":
        inner = _el(rng, "a", "logo|brand", _words(rng, 2)) + (_furniture(rng, "nav") if rng.random() < 0.5 else _el(rng, "p", "tagline", _sentence(rng, 3, 10)))
        return _el(rng, "div" if plain else "header", "site-header|masthead|top-header|page-header" if plain or rng.random() < 0.5 else "", inner)
    if kind == "footer":
        inner = "&copy; " + _words(rng, 2) + " &middot; " + _sentence(rng, 3, 20) if rng.random() < 0.5 else _el(rng, "p", "copyright|legal", _sentence(rng, 3, 25)) + (_links(rng, 2, 6) if rng.random() < 0.5 else "")
        return _el(rng, "div" if plain else "footer", "footer|site-footer|page-footer|bottom" if plain or rng.random() < 0.5 else "", inner)
    if kind == "side":
        parts = "".join(_el(rng, "div", "widget|box|", _el(rng, "h3", "", _words(rng, 2)) + (_links(rng, 2, 7) if rng.random() < 0.6 else _el(rng, "p", "", _sentence(rng, 4, 30)))) for _ in range(int(rng.integers(1, 4))))
        return _el(rng, "div" if plain else "aside", "sidebar|related|right-rail|secondary|widget-area|recommended|popular-posts" if plain or rng.random() < 0.6 else "", parts)
    if kind == "ad":
        inner = _sentence(rng, 3, 25) if rng.random() < 0.6 else _el(rng, "p", "", _sentence(rng, 3, 25)) + _el(rng, "a", "", _words(rng, 2))
        return _el(rng, str(rng.choice(["div", "div", "section", "aside", "p", "ins"])), "ad|ads|advert|ad-slot|advertisement|sponsored|promo|banner-ad|ad-box|sponsor", inner)
    if kind == "notice":
        inner = (_sentence(rng, 4, 30) if rng.random() < 0.5 else _el(rng, "p", "", _sentence(rng, 4, 30))) + (_el(rng, "button", "", _words(rng, 1)) if rng.random() < 0.6 else "")
        return _el(rng, str(rng.choice(["div", "section", "div", "p"])), "cookie-notice|cookie-banner|consent|notice|alert|popup|gdpr|announcement|modal|newsletter-popup|paywall|privacy-notice", inner)
    if kind == "form":
        fields = "".join(f"<label>{_words(rng, 1)}</label><input name=q>" for _ in range(int(rng.integers(1, 4))))
        inner = (_el(rng, "p", "", _sentence(rng, 3, 15)) if rng.random() < 0.6 else "") + fields + _el(rng, "button", "", _words(rng, 1))
        form = _el(rng, "form", "search|newsletter|login|subscribe|contact-form|", inner)
        return _el(rng, "div", "newsletter|search-box|signup|subscribe|", form) if rng.random() < 0.4 else form
    if kind == "comments":
        one = lambda: _el(rng, str(rng.choice(["div", "li", "article", "div"])), "comment|comment-item|reply|comment-body", _el(rng, "span", "author|commenter|user", _words(rng, 2)) + _el(rng, "p", "comment-text|", _sentence(rng, 4, 50)))
        inner = (_el(rng, "h3", "", _words(rng, 2)) if rng.random() < 0.7 else "") + "".join(one() for _ in range(int(rng.integers(1, 7))))
        return _el(rng, str(rng.choice(["div", "section", "ul", "ol", "aside"])), "comments|comment-list|discussion|reader-comments|responses|replies|disqus_thread", inner)
    return _el(rng, "div", "share|social|share-buttons|follow", "".join(_el(rng, "a", "", _words(rng, 1)) for _ in range(int(rng.integers(2, 5)))))


_KINDS = ("nav", "header", "footer", "side", "ad", "notice", "form", "comments", "share")


_MARKUP = "b b i em strong span code small sub mark a math noscript object abbr".split()


def _marked_up(rng, text: str) -> str:
    """Text with a few of its words in inline elements."""
    words = text.split(" ")
    for _ in range(int(rng.integers(1, 4))):
        i = int(rng.integers(0, len(words)))
        j, tag = min(len(words), i + int(rng.integers(1, 5))), str(rng.choice(_MARKUP))
        words[i:j] = [f"<{tag}{' href=/x' if tag == 'a' else ''} data-y>{' '.join(words[i:j])}</{tag}>"]
    return " ".join(words)


def _article(rng) -> str:
    parts = []
    if rng.random() < 0.85:
        title = _el(rng, "h1" if rng.random() < 0.75 else "h2", "title|entry-title||", _words(rng, int(rng.integers(1, 12))), True)
        parts.append(_el(rng, "header", "entry-header|article-header|", title, True) if rng.random() < 0.15 else title)
    for _ in range(int(np.exp(rng.uniform(0, np.log(14))))):
        r = rng.random()
        if r < 0.58:
            text = _sentence(rng, 1 if rng.random() < 0.3 else 6, 120)
            if rng.random() < 0.25:
                text = f"<b data-y>{text}" + ("<br>" if rng.random() < 0.5 else "</b>")
            elif rng.random() < 0.4:
                text = _marked_up(rng, text)
            parts.append(f"<p data-y>{text}" + ("</p>" if rng.random() < 0.8 else ""))
        elif r < 0.74:
            parts.append(_el(rng, str(rng.choice(["h2", "h3"])), "", _words(rng, int(rng.integers(1, 7))), True))
        elif r < 0.82:
            parts.append("<ul data-y>" + "".join(f"<li data-y>{_sentence(rng, 2, 20)}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>")
        elif r < 0.88:
            parts.append(f"<blockquote data-y>{_sentence(rng)}</blockquote>" if rng.random() < 0.5 else f"<blockquote data-y><p data-y>{_sentence(rng)}</p></blockquote>")
        elif r < 0.92:
            parts.append("<table data-y>" + "".join("<tr data-y>" + "".join(f"<td data-y>{_words(rng, int(rng.integers(1, 4)))}</td>" for _ in range(3)) + "</tr>" for _ in range(int(rng.integers(2, 5)))) + "</table>")
        elif r < 0.96:
            parts.append(f"<div data-y>{_sentence(rng)}</div>" if rng.random() < 0.6 else f"<section data-y><h2 data-y>{_words(rng, 3)}</h2><p data-y>{_sentence(rng)}</p></section>")
        else:
            parts.append(f'<figure data-y><img src="a.png"><figcaption data-y>{_sentence(rng, 3, 15)}</figcaption></figure>')
        if rng.random() < 0.07:
            parts.append(_furniture(rng, str(rng.choice(["ad", "ad", "notice", "share", "side", "form", "comments"]))))
    if rng.random() < 0.25:
        parts.append(_furniture(rng, str(rng.choice(["comments", "share", "ad", "form", "side"]))))
    tag = str(rng.choice(["article", "article", "article", "div", "div", "main", "section"]))
    names = "content|post|entry-content|article-body|story|main-content|post-body" if tag == "div" or rng.random() < 0.3 else ""
    return _el(rng, tag, names, "".join(parts), True)


def example(rng) -> str:
    """One made-up page; attributes data-y mark its main text."""
    count = {"nav": 0.8, "header": 0.5, "footer": 0.85, "side": 0.4, "ad": 0.6, "notice": 0.35, "form": 0.25, "comments": 0.3, "share": 0.15}
    before = [k for k in ("notice", "header", "nav", "ad", "form", "side") if rng.random() < count[k] * (0.7 if k in ("ad", "notice", "form", "side") else 1)]
    after = [k for k in ("share", "ad", "side", "form", "comments", "notice", "footer") if rng.random() < count[k] * (0.5 if k == "ad" else 1)]
    if rng.random() < 0.3:
        rng.shuffle(before)
    body = _article(rng)
    if rng.random() < 0.06:  # without a frame of its own
        body = body[body.index(">") + 1 : body.rindex("<")]
    if rng.random() < 0.3:
        body = _el(rng, str(rng.choice(["main", "div"])), "content-wrap|main|container|page|layout|", body + (_furniture(rng, str(rng.choice(["side", "comments", "ad"]))) if rng.random() < 0.5 else ""))
    inner = "".join(_furniture(rng, k) for k in before) + body + "".join(_furniture(rng, k) for k in after)
    if rng.random() < 0.3:
        inner = _el(rng, "div", "wrapper|page|site|container|root", inner)
    return f"<html><head><title>{_words(rng, 3)}</title><script>var a='</p>';</script></head><body>{inner}</body></html>"


def labels(page: Page) -> np.ndarray:
    """1 for elements that are marked or hold marked ones."""
    marked = np.concatenate(([0], np.cumsum(page.marked)))
    return (marked[np.array(page.end)] > marked[np.arange(len(page.end))]).astype(float)


@functools.lru_cache(maxsize=2)
def train(pages: int = 800, seed: int = 3) -> Forest:
    """A forest from made-up pages; the same one each time."""
    rng = np.random.default_rng(seed)
    made = [parse(example(rng)) for _ in range(pages)]
    says = ~np.concatenate([p.follows for p in made])
    return boost(features(made)[says], np.concatenate([labels(p) for p in made])[says])


def decode(page: Page, logit: np.ndarray) -> np.ndarray:
    """Which elements to keep: the most likely choice in which all above a kept element are kept.

    Elements that follow have no say of their own. From the leaves up, an element is worth keeping if its own log odds and the best
    choices below it sum to more than nothing; from the root down, only what hangs under kept elements stays.
    """
    n = len(page.parent)
    best, parent = np.where(page.follows, 1e-9, logit).tolist(), page.parent
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    keep = [True] * n
    for i in range(1, n):
        keep[i] = keep[parent[i]] and best[i] > 0
    return np.array(keep)


def render(page: Page, keep: np.ndarray) -> str:
    """The kept text: references decoded, white space one space, blocks joined by one space."""
    out = []
    for i, t in page.texts:
        if i < 0:
            out.append(" ")
        elif keep[i]:
            out.append(entities.unescape(t) if "&" in t else t)
    return " ".join("".join(out).split())


def extract(forest: Forest, htmls: list[str | None], group: int = 200) -> list[str]:
    """Main texts of pages; features are made for a group at a time."""
    found = []
    for k in range(0, len(htmls), group):
        pages = [parse(h) for h in htmls[k : k + group]]
        logit, at = forest.logit(features(pages)), 0
        for page in pages:
            n = len(page.parent)
            found.append(render(page, decode(page, logit[at : at + n])))
            at += n
    return found


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", forest: Forest | None = None) -> DataFrame:
    """The main text of every page, from its whole html: (page_id, url, text, n_chars).

    Null and empty pages, and pages without main text, have an empty text. n_chars counts
    code points. Repeated rows are each extracted; ids and urls may be null; an empty
    table gives no rows; other columns are not read.
    """
    text_batches(pages.sparkSession)
    sent = pages.sparkSession.sparkContext.broadcast(forest or train())

    def run(batches):
        for b in slices(batches):
            texts = extract(sent.value, b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=_TEXT)

    source = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
