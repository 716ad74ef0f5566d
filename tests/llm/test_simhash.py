import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from gleaner.llm import graph, simhash


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    distinct = sorted(set(fps.values()))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if (a ^ b).bit_count() <= 4:
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for d in sorted(fps):
        least.setdefault(find(fps[d]), d)
    return {d: least[find(f)] for d, f in fps.items()}


TEXTS = ["", None, "one", "One\tTWO three", "É é a b c d e", "a b c d e f g h a b c d", " x y\x0bz", "w " * 3000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_matches_definition(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == slow_fingerprint(text)


def test_groups_match_brute_force(spark):
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    docs = []
    for i in range(60):
        base = [rnd.choice(words) for _ in range(200)]
        for _ in range(rnd.choice([1, 1, 3, 6])):
            copy = list(base)
            for _ in range(rnd.choice([0, 1, 2])):
                copy[rnd.randrange(200)] = "zz"
            docs.append(" ".join(copy))
    docs += ["", None, " ", docs[0], docs[0].upper()]
    rows = list(enumerate(docs))
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], "doc_id long, text string, fp string, component_id string")
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash.groups(df).collect()}
    fps = {i: slow_fingerprint(t) for i, t in enumerate(docs)}
    assert {i: f for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == slow_components(fps)


def test_links_join_what_the_radius_joins(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for k in (1, 2, 3, 4, 5):
            for _ in range(3):
                fps.add(f ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    chain = 12345
    for b in range(0, 60, 4):  # a long chain, each link exactly four bits
        chain ^= 0xF << b
        fps.add(chain)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    want = slow_components({f: f for f in fps})
    for made in (simhash.links(df), simhash.ball_links(df)):
        roots = {r.node: r.root for r in graph.components(made).collect()}
        pairs = {(a, b) for a, b in ((r.a % (1 << 64), r.b % (1 << 64)) for r in made.collect())}
        signed = lambda f: f - (1 << 64) if f >> 63 else f
        got = {f: roots.get(signed(f), signed(f)) for f in fps}
        assert len({(got[f], want[f]) for f in fps}) == len({got[f] for f in fps}) == len({want[f] for f in fps})
        assert pairs


def test_crowded_keys_take_whole_balls(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 30)
    rng = np.random.default_rng(4)
    fps = {0xABCDEF << 32 | int(x) for x in rng.integers(0, 1 << 32, 300)}
    fps |= {f ^ 0b1011 for f in list(fps)[:50]}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in graph.components(simhash.links(df)).collect()}
    assert {f: roots.get(f, f) for f in fps} == slow_components({f: f for f in fps})


def test_canonical_key_reports_each_pair_once():
    rng = np.random.default_rng(6)
    for _ in range(300):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 5), replace=False))
        keys = {}
        for x in (a, b):
            for side, half in ((0, x >> 32), (1, x & 0xFFFFFFFF)):
                for m in (0, *(1 << i for i in range(32))):
                    keys.setdefault(side << 32 | half ^ m, set()).add(x)
        shared = [k for k, v in keys.items() if len(v) == 2]
        u = lambda x: np.array([x], np.uint64)
        lo, hi = sorted((a, b))
        assert sum(bool(simhash._canonical(u(k), u(lo), u(hi))[0]) for k in shared) == 1


def test_empty_table_null_ids_and_keep_one(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.groups(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c d e", 1), (3, "a b c d e", 2), (3, "a b c d e", 2), (4, "q r s t u v", 3)], "doc_id long, text string, extra int")
    assert sorted((r.doc_id is None, r.component_id) for r in simhash.groups(df).collect()) == [(False, 3), (False, 3), (False, 4), (True, 3)]
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 700)] + [(7, 3), (3, 7), (9, 9)]
    roots = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{i: 100 for i in range(101, 161)}, **{i: 500 for i in range(501, 700)}, 7: 3}
