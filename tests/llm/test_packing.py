import bisect
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from gleaner.llm import packing

TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "one two"), (4, "one two"), (5, "x " * 5000), (6, "日本語のテキスト " * 300), (7, "a  b\n\n c\t d   "), (8, "<s> special </s> <unk>"), (9, "naïve café ŀ ẞ 1234567 it's don't"),
    (None, "no id"), (10, "q" * 20000), (11, "  x​ y"), (12, " lead and trail "),
]


@pytest.fixture(scope="module")
def exact():
    t = Tokenizer.from_file(packing.default_tokenizer())
    return lambda text: [*(t.encode(text, add_special_tokens=False).ids if text else []), 2]


@pytest.mark.parametrize("text", [t for _, t in TEXTS if t])
def test_encoder_equals_the_tokenizer_file(exact, text):
    assert np.frombuffer(packing.encoder(packing.default_tokenizer()).encode(text), "<u4").tolist() == exact(text)[:-1]


def test_round_trip_of_pieces(docs, exact):
    found = packing.pack_documents(docs(TEXTS)).collect()
    by_doc = {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, text in {i: t for i, t in TEXTS}.items():
        ids, copies = exact(text), sum(1 for j, _ in TEXTS if j == i)
        rows = sorted(by_doc[i], key=lambda r: (r["piece"], r["sequence_id"]))
        assert len(rows) == copies * -(-len(ids) // 1024)
        for r in rows:
            part = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(part.tobytes())
        starts = sorted({(r["start"], r["length"]) for r in rows})
        assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and sum(starts[-1]) == len(ids)
        assert all(n == 1024 for _, n in starts[1:])
    used = {}
    for r in found:
        used.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in used.values():
        places.sort()
        assert places[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(places, places[1:])) and sum(places[-1]) <= 1024


def test_sequences_hold_the_ids(docs, exact):
    rows = [(1, "one two three"), (2, None), (3, "x y " * 900), (1, "one two three"), (1, "another"), (None, "no id"), (None, "no id " * 1100)]
    found = packing.sequences(docs(rows)).collect()
    joined = sorted(i for r in found for i in r["ids"])
    assert joined == sorted(i for _, t in rows for i in exact(t))
    assert all(r["n_tokens"] == len(r["ids"]) <= 1024 for r in found)
    assert sorted(str(i) for r in found for i in set(r["doc_ids"]) if i != 1)[:2] == ["2", "3"] and sum(r["doc_ids"].count(1) for r in found) == 3


def test_few_bins_and_brute_force_of_the_rule():
    rng = np.random.default_rng(0)
    sizes = sorted(rng.integers(1, 1025, 3000).tolist(), reverse=True)
    bins, gaps, best_fit = packing.SumOfSquares(1024), [], 0
    for s in sizes:
        bins.place(s)
        i = bisect.bisect_left(gaps, s)
        best_fit += i == len(gaps)
        gap = gaps.pop(i) if i < len(gaps) else 1024
        if gap > s:
            bisect.insort(gaps, gap - s)
    assert bins.opened <= 1.005 * best_fit
    small, open_gaps = packing.SumOfSquares(10), []
    for s in rng.integers(1, 11, 200).tolist():
        def after(g, s=s):
            gaps = [*open_gaps]
            gaps.remove(g)
            gaps += [g - s] if g > s else []
            return sum(gaps.count(x) ** 2 for x in set(gaps))

        options = [g for g in sorted(set(open_gaps)) if g >= s]
        _, offset = small.place(s)
        if options:
            best = min(options, key=lambda g: (after(g), g))
            assert offset == 10 - best
            open_gaps.remove(best)
            open_gaps += [best - s] if best > s else []
        else:
            assert offset == 0
            open_gaps += [10 - s] if s < 10 else []


def test_shards_and_empty_table(docs):
    rows = [(i, f"text number {i} " * (i % 9)) for i in range(200)]
    found = packing.pack_documents(docs(rows), shard_docs=20)
    assert found.select("doc_id").distinct().count() == 200
    again = packing.pack_documents(docs(rows), shard_docs=20)
    key = ["doc_id", "piece", "sequence_id", "offset"]
    assert sorted(map(tuple, found.select(key).collect())) == sorted(map(tuple, again.select(key).collect()))
    assert packing.pack_documents(docs([])).count() == 0
