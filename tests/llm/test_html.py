import numpy as np
import pytest

from gleaner.llm import html_extract as h

PAGES = "page_id long, url string, html string, text string, n_chars int"
PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a = "</p>"; x < y;</script></head><body>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">About us</a></li></ul></nav>
<div class="cookie-notice">We use cookies to improve your visit. <button>Accept</button></div>
<article><h1>A title here</h1><p>First   paragraph with an &eacute; and <b>bold</b> text, long enough to be one.</p>
<p>Second paragraph &amp; more of it, also a sentence.<p>Third one, never closed
<div class="ad-slot">Buy this now at a low price</div></article>
<div class="comments"><div class="comment">I disagree with it all.</div></div>
<footer>&copy; Somebody, all rights reserved</footer></body></html>"""


def test_keeps_the_article_alone(spark):
    rows = [(1, "u", PAGE, "x", 0), (1, "u", PAGE, "x", 0), (2, None, None, None, None), (3, "v", "", "", 0), (None, "w", "plain words", "", 0), (4, "x", "<" * 5000, "", 0)]
    found = h.main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert len(found) == len(rows)
    texts = [r["text"] for r in found if r["page_id"] == 1]
    assert texts[0] == texts[1]
    assert "First paragraph with an é and bold text" in texts[0] and "Second paragraph & more of it" in texts[0] and "Third one, never closed" in texts[0]
    for gone in ("Home", "cookies", "Accept", "Buy this", "disagree", "rights reserved", "var a", "<"):
        assert gone not in texts[0]
    by_id = {r["page_id"]: r for r in found}
    assert by_id[2]["text"] == by_id[3]["text"] == "" and by_id[2]["n_chars"] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert h.main_text(spark.createDataFrame([], PAGES)).count() == 0


#: Pages marked by hand: (html, main text).
MARKED = [
    ("""<html><head><title>Heat</title></head><body><header><a href="/">Daily Science</a><nav><a href="/n">News</a> <a href="/s">Science</a></nav></header>
<main><article><h1>How heat moves</h1><p>The flow through a wall is <math><mi>q</mi><mo>=</mo><mi>k</mi></math> times the difference, as <em>Fourier</em> found.</p>
<noscript><p>Figures need no scripts to be understood, and this one has none at all.</p></noscript><p>Wood&nbsp;&amp; wool carry little of it, which is why houses are built of the one and filled with the other.</p></article></main>
<aside class="related"><h3>Related</h3><ul><li><a href="/1">Cold</a></li><li><a href="/2">Wind</a></li></ul></aside><footer><p>Copyright Daily Science</p></footer></body></html>""",
     "How heat moves The flow through a wall is q=k times the difference, as Fourier found. Figures need no scripts to be understood, and this one has none at all. Wood & wool carry little of it, which is why houses are built of the one and filled with the other."),
    ("""<body><div class="cookie-banner"><p>We use cookies.</p><button>Fine</button></div><div id="content" class="post"><h1>A lamp for the desk</h1>
<p class="review">This lamp has been on our desk for a year, and we would buy it again without much thought.</p><p>It is bright, it is cheap, and the x-part <x-note>called</x-note> an arm bends where you want it to.</p>
<form class="newsletter"><label>Mail</label><input name="m"><button>Join</button></form></div><div class="comments"><h3>Comments</h3><div class="comment"><p>Mine broke within a week, sadly.</p></div></div></body>""",
     "A lamp for the desk This lamp has been on our desk for a year, and we would buy it again without much thought. It is bright, it is cheap, and the x-part called an arm bends where you want it to."),
    ("""<body><nav class="menu"><ul><li><a href="/">Home</a></li></ul></nav><article><h2>Counting sheep</h2><p>There were three farms in the valley, and each kept its own count of sheep through the year.</p>
<table><tr><th>Farm</th><th>Sheep</th></tr><tr><td>North</td><td>41</td></tr></table><blockquote>Nobody ever counted them twice, said the eldest of the farmers.</blockquote>
<script>count(1)</script><style>td{color:red}</style><p>Then came the flood<br>and they were one farm.</p></article><div class="ad">Sheep for sale, today only.</div></body>""",
     "Counting sheep There were three farms in the valley, and each kept its own count of sheep through the year. Farm Sheep North 41 Nobody ever counted them twice, said the eldest of the farmers. Then came the flood and they were one farm."),
    ("<body><p>Only a paragraph, with no frame around it, and yet it is what the page says.</p></body>", "Only a paragraph, with no frame around it, and yet it is what the page says."),
]


@pytest.mark.parametrize("page, text", MARKED)
def test_pages_marked_by_hand(page, text):
    assert h.extract(h.train(), [page]) == [text]


def test_held_out_made_up_pages():
    forest, rng = h.train(), np.random.default_rng(99)
    right = total = 0
    for _ in range(60):
        page = h.parse(h.example(rng))
        keep = h.decode(page, forest.logit(h.features([page])))
        wanted = h.labels(page) > 0
        for i, t in page.texts:
            if i >= 0 and t.strip():
                total += len(t)
                right += len(t) if keep[i] == wanted[i] else 0
    assert right / total > 0.95


def test_decoding_never_keeps_what_hangs_under_a_dropped_node():
    page = h.parse("<div><p>a</p><div><p>b</p></div></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        keep = h.decode(page, rng.normal(size=len(page.parent)))
        assert all(keep[page.parent[i]] for i in range(1, len(page.parent)) if keep[i])


@pytest.mark.parametrize("html", ["<p>", "</p></div>", "<p <b>x", "<!-- never closed", "<script>never closed", "a < b > c", "<table><tr><td>x<td>y", "&#xFFFFFFFF; &unknown;", "<p>" * 3000 + "deep"])
def test_broken_markup_is_read(html):
    h.extract(h.train(), [html])


def test_decoding_is_the_best_choice_by_brute_force():
    page = h.parse("<div><p>a<b>c</b></p><div><p>b</p></div></div>")
    n, rng = len(page.parent), np.random.default_rng(5)
    for _ in range(20):
        logit = np.where(page.follows, 0.0, rng.normal(size=n))
        best = max(
            sum(logit[i] for i in range(1, n) if m >> i & 1)
            for m in range(1 << n)
            if m & 1 and all(m >> page.parent[i] & 1 for i in range(1, n) if m >> i & 1)
        )
        keep = h.decode(page, logit)
        assert sum(logit[i] for i in range(1, n) if keep[i]) == pytest.approx(best)
        assert all(keep[i] == keep[page.parent[i]] for i in range(1, n) if page.follows[i])
