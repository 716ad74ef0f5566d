import numpy as np
import pytest

from gleaner.operators import baseline, decode, features, grouping, lines, markdown, neural, postal, regions, rules, spans, tokens
from gleaner.operators.features import BIT
from gleaner.schema import Entity


def kinds(text):
    return [(t.text, t.kind) for t in tokens.tokenize(text)]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Hello, world", ["Hello", ",", " ", "world"]),
        ("O’Neil HMRC's Jean-Luc well-known", ["O’Neil", " ", "HMRC", "'", "s", " ", "Jean", "-", "Luc", " ", "well-known"]),
        ("221B 3.14 1-2 ２３", ["221B", " ", "3.14", " ", "1", "-", "2", " ", "２３"]),
        ("東京都\r\nx", ["東", "京", "都", "\r\n", "x"]),
        ("Te­le­kom éa", ["Te­le­kom", " ", "éa"]),
        ("abcабв", ["abc", "абв"]),
        ("", []),
    ],
)
def test_tokens(text, want):
    assert [t for t, _ in kinds(text)] == want


@pytest.mark.parametrize("text", ["", "a\r\nb\rc\n\n", "📞 +1", "́x", "مرحبا ١٢٣ שלום ไทย हिन्दी 한국 カナかな", "a​b c", "''-'-’’", "漢-字"])
def test_tokens_cover_every_byte(text):
    found = tokens.tokenize(text)
    assert "".join(t.text for t in found) == text
    at = 0
    for t in found:
        assert t.start == at and t.end > at
        at = t.end
    assert at == len(text.encode())


def test_ngrams_are_the_published_hashes():
    # The first ids of a word in 32768 buckets.
    assert list(features.ngram_ids("Hello", features.Config(buckets=32_768))[:7]) == [14859, 342, 17220, 32261, 30956, 1966, 18666]
    assert len(features.ngram_ids("x" * 100)) == 64


def test_flags():
    text = "Dear Dr Smith\n\nBaker Street 221B\nLondon NW1 6XE\nACME Ltd\tx"
    toks = tokens.tokenize(text)
    found = features.featurize(toks, [(0, 4)], tab_cells=True)
    flags = {t.text: f for t, f in zip(toks, found, strict=True)}
    assert flags["Dear"].has("salutation") and flags["Dear"].has("in_rule_span") and flags["Dr"].has("honorific") and flags["Street"].has("road")
    assert flags["221B"].has("house_number_like") and flags["NW1"].has("postcode_like") and flags["6XE"].has("postcode_like") and flags["Ltd"].has("legal_form", "before_tab")
    assert flags["Baker"].has("after_blank_line") and flags["Baker"].has("line_start") and flags["x"].flags & BIT["after_tab"]
    assert flags["London"].has("in_short_line_block") and flags["ACME"].shape == 1 and flags["Smith"].shape == 2


def test_blocks():
    text = "From: a\nTo: b\n\n> quoted\n> more\ntext after\n---\na | b | c\n[10:02] Ana: hi\nand on\n\nNino B\nACME\n"
    assert [(b.kind, len(b.lines), b.gap_lines) for b in lines.split_blocks(text)] == [
        ("header", 2, 0), ("quoted_reply", 2, 1), ("paragraph", 1, 0), ("separator", 1, 0), ("table_row", 1, 0), ("chat_turn", 2, 0), ("signature", 2, 1),
    ]
    assert lines.split_blocks("") == [] and lines.split_blocks("\n\n") == []


def entities(text, *parts):
    out, at = [], 0
    data = text.encode()
    for kind, part in parts:
        start = data.index(part.encode(), at)
        out.append(Entity(kind, start, start + len(part.encode()), 0.99))
        at = start
    return sorted(out, key=lambda e: e.start)


def test_contacts():
    text = "Nino Beridze\nACME Ltd\nnino@acme.ge\n+995 32 2 25 04 84\n\nWritten by Tom Hall to nino@x.ge and t.hall@x.ge\n"
    es = entities(text, ("person", "Nino Beridze"), ("org", "ACME Ltd"), ("email", "nino@acme.ge"), ("phone", "+995 32 2 25 04 84"), ("person", "Tom Hall"), ("email", "nino@x.ge"), ("email", "t.hall@x.ge"))
    contacts, rest = grouping.group(text, es)
    data = text.encode()
    shown = [[data[e.start : e.end].decode() for e in c.members()] for c in contacts]
    assert shown[0] == ["Nino Beridze", "ACME Ltd", "nino@acme.ge", "+995 32 2 25 04 84"]
    assert shown[1] == ["Tom Hall", "nino@x.ge", "t.hall@x.ge"] and rest == []
    assert grouping.group("", []) == ([], [])


@pytest.mark.parametrize("local, person, want", [("nino.beridze", "Nino Beridze", True), ("nberidze", "Nino Beridze", True), ("hr", "Hans Richter", False), ("jm", "José Müller", True), ("nino7", "Nino Beridze", True), ("x", "Nino", False), ("info", "Ina Fo", False), ("мария", "Мария И", False)])
def test_names_in_addresses(local, person, want):
    assert grouping.name_match(local, person) == want


def test_regions():
    assert regions.infer("London NW1 6XE, United Kingdom") == ["GB"]
    assert regions.infer("Denver, CO 80202. Call +49 30 1234567") == ["DE", "US"]
    assert regions.infer("10115 Berlin") == ["DE"] and regions.infer("Wales WALES x@y.co.uk") == ["GB"] and regions.infer("") == [] and regions.infer(None) == []
    assert regions.infer("UK UK UK UK a@b.de") == ["GB", "DE"]


def test_rules_merge():
    used, found = rules.scan("mail 030.1234567@x.de or 030 1234567")
    assert used == ["DE"] and [(e.kind, e.start) for e in found] == [("email", 5), ("phone", 25)]


def test_markdown():
    text = "---\ntitle: x\n---\n# Head\n\nSee [mail me](mailto:a%40b.com) and `c@d.com` or <e@f.com>.\n\n```\nhidden@x.com\n```\n\n| a | g@h.com |\n|---|---|\n| 1 | i@j.com |\n"
    selected = markdown.select(text)
    data = text.encode()
    assert [data[a:b].decode() for a, b in selected.scan] == ["Head", "See [mail me](mailto:a%40b.com) and `c@d.com` or <e@f.com>.", "a", "g@h.com", "1", "i@j.com"]
    _, found = markdown.scan(text, selected, [])
    assert [(data[e.start : e.end].decode(), e.normalized) for e in found] == [("mail me", "a@b.com"), ("e@f.com", "e@f.com"), ("g@h.com", "g@h.com"), ("i@j.com", "i@j.com")]
    assert markdown.select("") == markdown.Selection()


@pytest.mark.parametrize("text", ["[", "![", "[a](", "`", "<", "- - -\n> > [x]: y", "    \n\t\n", "***", "|\n|-\n|", "```", "<div>", "\\", "é" * 10 + "[é](x)"])
def test_broken_markdown_is_read(text):
    s = markdown.select(text)
    assert all(0 <= a < b <= len(text.encode()) for a, b in s.scan)


def test_masks_windows_and_merge():
    m = spans.Mask([(0, 10), (20, 30)], [(3, 5), (8, 22)])
    assert m.ranges == [(0, 3), (5, 8), (22, 30)] and m.contains(5, 8) and not m.contains(2, 4)
    before = [3] + [1] * 4999
    found = spans.windows(before)
    assert found[0].start == 0 and found[-1].end == 5000 and all(a.end - b.start >= spans.OVERLAP for a, b in zip(found, found[1:]))
    assert all(any(w.trusts(i, i + spans.MOST_ENTITY_TOKENS - 1) for w in found) for i in range(0, 5000 - spans.MOST_ENTITY_TOKENS, 7))
    with pytest.raises(spans.InputTooLarge):
        spans.windows([3] + [0] * 5000)
    es = [Entity("org", 0, 10, 0.9, "model"), Entity("person", 5, 8, 0.99, "model"), Entity("email", 8, 12, 0.5), Entity("org", 20, 22, 0.9, "model"), Entity("org", 20, 22, 0.95, "model")]
    assert [(e.kind, e.start, e.confidence) for e in spans.merge(es)] == [("person", 5, 0.99), ("email", 8, 0.5), ("org", 20, 0.95)]


def test_viterbi_is_the_best_legal_path_by_brute_force():
    import itertools

    rng = np.random.default_rng(0)
    for _ in range(20):
        p = decode.softmax(rng.normal(0, 2, (4, 5)))
        masked, paragraph = [False, False, rng.random() < 0.3, False], [False, False, False, rng.random() < 0.3]

        def legal(path, masked=masked, paragraph=paragraph):
            for t, x in enumerate(path):
                if masked[t] and x:
                    return False
                if x and x % 2 == 0 and (t == 0 or paragraph[t] or not path[t - 1] or (path[t - 1] - 1) // 2 != (x - 1) // 2):
                    return False
            return True

        score = lambda path, p=p, masked=masked: sum(0 if masked[t] else np.log(p[t, x]) for t, x in enumerate(path))
        best = max((q for q in itertools.product(range(5), repeat=4) if legal(q)), key=score)
        assert tuple(decode.viterbi(p, np.array(masked), np.array(paragraph))) == best
    assert list(decode.viterbi(np.full((2, 7), np.nan), [False] * 2, [False] * 2)) == [0, 0]


def test_bio_round_trip_and_quantisation():
    bounds = [(0, 1), (2, 3), (4, 5), (6, 7)]
    labels = decode.encode_bio(bounds, [(0, 3, 0), (6, 7, 2)])
    assert labels == [1, 2, 0, 5]
    with pytest.raises(ValueError):
        decode.encode_bio([(0, 4), (5, 9)], [(2, 9, 0)])
    w = np.random.default_rng(0).normal(size=(4, 6)).astype(np.float32)
    q, scale = decode.quantise(w)
    assert np.abs(decode.dequantise(q, scale) - w).max() <= scale.max() / 2 + 1e-6 and np.abs(q).max() == 127


def test_baseline():
    text = "Flat 4, 221B Baker Street, London NW1 6XE, UK"
    assert [(c.label, text[c.start : c.end]) for c in baseline.parse_address(text, "GB")] == [
        ("unit", "Flat 4"), ("house_number", "221B"), ("road", "Baker Street"), ("city", "London"), ("postcode", "NW1 6XE"), ("country", "UK"),
    ]
    text = "Nino Beridze\nKavkaz Freight LLC\n14 Rustaveli Avenue, Tbilisi 0108, Georgia\n"
    assert [(e.kind, text[e.start : e.end]) for e in baseline.detect(text, [])] == [("person", "Nino Beridze"), ("org", "Kavkaz Freight LLC"), ("address", "14 Rustaveli Avenue, Tbilisi 0108, Georgia")]


def test_postal_rules():
    assert postal.complete_block("PO Box 944\nNewton IA  50208") and postal.complete_block("101 1st Street N.\nNewton, IA 50208-1234")
    assert not postal.complete_block("101 Main Street and 5 Oak Road\nNewton IA 50208") and not postal.complete_block("Newton IA 50208")
    assert postal.postal_tail("123 Main Street\nDenver, CO 80202") is False and postal.postal_tail("Room 12, 123 Main Street\nDenver, CO 80202") is True
    assert postal.postal_tail("Main Street\nDenver, CO 80202") is None
    assert postal.zip_end("CO 80202.,", 0, 10) == 8 and postal.zip_end("CO 80202-1234", 0, 8) == 13


def _tagger(labels, flags, dilations, rng):
    f = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
    return neural.Tagger(f(1025, 48), f(13, 8), f(64, 8), (f(96, 64 + flags), f(96)), [(f(96, 96, 3), f(96)) for _ in dilations], (f(labels, 96), f(labels)), dilations, flags, True)


def test_any_weights_keep_the_invariants():
    rng = np.random.default_rng(0)
    scorer = neural.LogitScorer(_tagger(7, 25, neural.DETECTOR_DILATIONS, rng), _tagger(23, 23, neural.PARSER_DILATIONS, rng), features.Config(buckets=1024))
    text = "Ana Lee, ana@x.com\n\nPhysical Address 5 Oak Road, Newton IA 50208. 東京 é +1 202-555-0143 " * 30
    _, found = rules.scan(text)
    merged = spans.merge(found + scorer.detect(text, found, [], None))
    assert all(a.end <= b.start for a, b in zip(merged, merged[1:])) and {(e.kind, e.start) for e in found} <= {(e.kind, e.start) for e in merged}
    data = text.encode()
    for e in merged:
        data[e.start : e.end].decode()
    assert all(c.start < c.end for c in scorer.parse("5 Oak Road", None)) and scorer.parse("", None) == []


def test_convolution_matches_the_sum():
    rng = np.random.default_rng(1)
    x, w, b = rng.normal(size=(9, 4)), rng.normal(size=(5, 4, 3)), rng.normal(size=5)
    for d in (1, 2, 16):
        want = np.array([b + sum(w[:, :, k] @ x[t + (k - 1) * d] for k in range(3) if 0 <= t + (k - 1) * d < 9) for t in range(9)])
        assert np.allclose(neural.convolve(x, w, b, d), want, atol=1e-5)


def test_bundles():
    import hashlib
    import json

    head = json.dumps({"__metadata__": {"v": "1"}, "a": {"dtype": "I8", "shape": [2, 2], "data_offsets": [0, 4]}, "a.scale": {"dtype": "F32", "shape": [2], "data_offsets": [4, 12]}}).encode()
    data = len(head).to_bytes(8, "little") + head + bytes([1, 2, 255, 0]) + np.array([0.5, 2], "<f4").tobytes()
    meta, tensors = neural.read_bundle(data, "sha256-" + hashlib.sha256(data).hexdigest())
    assert meta == {"v": "1"} and neural.weights(tensors, "a").tolist() == [[0.5, 1.0], [-2.0, 0.0]]
    for bad in (b"", data[:-1], data + b"x", (1 << 40).to_bytes(8, "little"), b"\x02" + bytes(7) + b"[]"):
        with pytest.raises(neural.BundleError):
            neural.read_bundle(bad)
    with pytest.raises(neural.BundleError):
        neural.read_bundle(data, "sha256-00")


def test_detection_reads_only_lines_that_can_hold_something(monkeypatch):
    read = []
    monkeypatch.setattr(baseline, "tokenize", lambda t: read.append(len(t)) or tokens.tokenize(t))
    prose = "\n".join(["der lange Satz mit vielen Worten, in dem gar nichts steht, und noch mehr."] * 500)
    text = f"{prose}\nMr. John Smith\n12 Oak Street\nDenver, CO 80202\n{prose}\nbest regards\nAnn Lee\n{prose}"
    found = baseline.detect(text, [])
    assert [(e.kind, text[e.start : e.end]) for e in found] == [("person", "Mr. John Smith"[4:]), ("address", "12 Oak Street\nDenver, CO 80202"), ("person", "Ann Lee")]
    assert sum(read) < len(text) / 10 and found == baseline._detect(text, [], None)


def test_detection_by_lines_equals_that_of_whole_texts():
    import random

    r = random.Random(3)
    words = (
        ["Mr", "Ltd", "GmbH", "Dear", "Kind  regards", "12 Oak Street", "Denver, CO 80202", "SW1A", "1AA", "­Ltd", "é", "\tJohn\t", " ", "Anna Smith", "1017 AB", "co.", "de", "heer", "\r\n", "x​Ltd"]
        + ["a@b.com", "+1 (202) 555-0143", "ბატონი", "De  Heer", "united states", "L­td", "5", "Main Road 7"] + ["foo", "Bar", "baz,", "Straße"] * 4
    )
    for _ in range(400):
        text = "".join(r.choice(words) + r.choice([" ", " ", " ", "\n", "\n\n", "  ", ", ", ""]) for _ in range(r.randint(1, 70)))
        found = rules.scan(text)[1]
        assert baseline.detect(text, found) == baseline._detect(text, sorted((e.start, e.end) for e in found), None), text


def test_counting_reads_each_run_once_and_equals_tokens(monkeypatch):
    import collections
    import random

    r = random.Random(9)
    bits = ["foo", "Bär", "O'Neil's", "-", "3.14", "221B", "東京", "é", "\u00ad", "\t", "\x0b", "\u200b", "\r\n", "\r", "\x85", "😀", "x" * 70, "ა", "", ".", "co-Op", "\u3000"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " ", "  ", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(1500)] + [" ", "  ", "\n", " a", "a ", "", "\n \n  x"]
    n, size, work = collections.Counter(), collections.Counter(), tokens._Counting()
    for text in texts:
        work.add(text)
        for t in tokens.tokenize(text):
            n[t.kind, t.script] += 1
            size[t.kind, t.script] += t.end - t.start
    work.flush()
    assert work.n == n and work.bytes == size
    read, plain = [], tokens.tokenize
    monkeypatch.setattr(tokens, "tokenize", lambda t: read.append(len(t)) or plain(t))
    work.add("the same few words again and again\n" * 1000)
    work.flush()
    assert sum(read) < 100


def test_parts_are_handed_over_few_at_a_time(spark):
    from gleaner import arrow

    texts = spark.createDataFrame([(i, "a b " * 5000) for i in range(8)], "id long, text string").coalesce(1)
    sizes = features.token_features(texts, ["id"]).mapInArrow(lambda bs: bs, "id long, pos int, start int, end int, ngram_ids array<int>, script tinyint, shape tinyint, flags int")
    assert sizes.count() == 8 * 20_000 and sizes.select("id", "pos").distinct().count() == 8 * 20_000
    assert arrow.MOST_PARTS <= 10_000 and features.ngram_ids.cache_info().maxsize <= 50_000
