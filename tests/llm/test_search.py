import numpy as np
import pandas as pd
import pytest

from gleaner.llm import ann, mtree

SCHEMA = "vec_id long, embedding array<float>, label int, rank int"


def made(n, d=16, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, d))
    x = (centres[rng.integers(0, 5, n)] + 0.3 * rng.normal(size=(n, d))).astype(np.float32)
    return [(i, v.tolist(), 0, 1) for i, v in enumerate(x)]


EDGES = [(9001, None, 0, 1), (9020, [], 0, 1), (9040, [None] * 16, 0, 1), (9060, [float("nan")] * 16, 0, 1), (9080, [float("inf")] * 16, 0, 1), (9100, [1.0] * 3, 0, 1), (None, [1.0] * 16, 0, 1)]


def brute(rows, every, k, of, zero=True):
    kept = {}
    for i, v, *_ in rows:
        if i is None or v is None or None in v or not np.isfinite(np.array(v, float)).all():
            continue
        x = np.zeros(16)
        x[: len(v)] = v
        if zero or x.any():
            kept[i] = of(x)
    found = {}
    for q in kept:
        if q % every == 0:
            scored = sorted(((-(kept[q] @ v), i) for i, v in kept.items() if i != q))
            found[q] = [(i, -s) for s, i in scored[:k]]
    return found


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"], r["rank"]))
    return out


def test_topk_equals_brute_force_with_copies_and_ties(spark):
    rows = made(600) + [(1000 + i, made(1)[0][1], 0, 1) for i in range(100)] + EDGES + [(7000, [0.0] * 16, 0, 1)]
    want = brute(rows, 100, 10, lambda v: np.floor(1024 * v).astype(np.int64))
    got = answers(mtree.search(spark.createDataFrame(rows, SCHEMA)))
    assert got.keys() == want.keys()
    for q in want:
        assert [(i, s) for i, s, _ in got[q]] == [(i, int(s)) for i, s in want[q]]
        assert [r for *_, r in got[q]] == list(range(1, len(want[q]) + 1))


def test_topk_in_many_parts_and_blocks(spark, monkeypatch):
    for name, value in (("ROUTER_ROWS", 50), ("PART_ROWS", 30), ("QUERY_BLOCK", 3), ("PAGE", 4), ("FANOUT", 3), ("SAMPLE", 40)):
        monkeypatch.setattr(mtree, name, value)
    rows = made(500, seed=4)
    want = brute(rows, 10, 10, lambda v: np.floor(1024 * v).astype(np.int64))
    got = answers(mtree.search(spark.createDataFrame(rows, SCHEMA), every=10))
    assert {q: [(i, s) for i, s, _ in a] for q, a in got.items()} == {q: [(i, int(s)) for i, s in a] for q, a in want.items()}


def test_few_candidates_and_empty_tables(spark):
    got = answers(mtree.search(spark.createDataFrame(made(3), SCHEMA)))
    assert {q: len(a) for q, a in got.items()} == {0: 2}
    assert mtree.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mtree.search(spark.createDataFrame([EDGES[0], *EDGES[2:5]], SCHEMA)).count() == 0
    assert ann.search(spark.createDataFrame(EDGES[:5], SCHEMA)).count() == 0
    assert ann.search(spark.createDataFrame([], SCHEMA)).count() == 0
    assert {q: len(a) for q, a in answers(ann.search(spark.createDataFrame(made(3), SCHEMA))).items()} == {0: 2}


@pytest.mark.parametrize("size", [700, 40])
def test_subtree_search_is_exact_and_saves_distances(size):
    rng = np.random.default_rng(2)
    x = np.floor(1024 * np.concatenate([rng.normal(0, 0.05, (size, 8)) + 1, rng.normal(0, 0.05, (size, 8)) - 1]))
    bound = float((x * x).sum(axis=1).max())
    pages = mtree.build(0, 0, x, [[i] for i in range(len(x))], mtree.lift(x[:1], bound)[0], bound)
    tree = mtree.Subtree(pages, bound, True)
    for q in x[:5]:
        at, scores = tree.search(q, None, 10)
        got = sorted(mtree.best_ids(0, [tree.ids[i] for i in at], scores, 10))
        want = sorted((0, int(-s), i) for s, i in sorted((-(q @ v), i) for i, v in enumerate(x))[:10])
        assert got == want
    if size > mtree.PAGE:
        assert tree.computed < 5 * len(x)


def test_neighbours_recall_scores_and_order(spark):
    rows = made(2000, seed=7) + [(5000 + i, made(1)[0][1], 0, 1) for i in range(30)] + EDGES + [(8000, [0.0] * 16, 0, 1)]
    want = brute(rows, 20, 20, lambda v: v, zero=False)
    got = answers(ann.search(spark.createDataFrame(rows, SCHEMA)))
    assert got.keys() == want.keys()
    hits = sum(len({i for i, _ in want[q]} & {i for i, *_ in got[q]}) for q in want)
    assert hits / sum(map(len, want.values())) > 0.95
    vectors = {i: np.array((v + [0.0] * 16)[:16], np.float64) for i, v, *_ in rows if v and None not in v}
    for q, a in got.items():
        assert len(a) == 20 and [r for *_, r in a] == list(range(1, 21))
        assert [(-s, i) for i, s, _ in a] == sorted((-s, i) for i, s, _ in a)
        assert all(s == pytest.approx(vectors[q] @ vectors[i], abs=1e-12) for i, s, _ in a)


def test_neighbours_in_many_parts_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 20)
    rows = made(600, seed=8)
    one = answers(ann.search(spark.createDataFrame(rows, SCHEMA)))
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    assert answers(ann.search(spark.createDataFrame(rows, SCHEMA))) == one


def test_recall_over_fifty_thousand_rows(spark):
    n, d = 50_000, 48
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(300, d))
    x = (centres[rng.integers(0, 300, n)] + 0.6 * rng.normal(size=(n, d))).astype(np.float32)
    rows = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(n), "embedding": x.tolist()}), "vec_id long, embedding array<float>").repartition(8)
    got, asked = answers(ann.search(rows)), np.arange(0, n, 20)
    score = x[asked].astype(float) @ x.astype(float).T
    score[np.arange(len(asked)), asked] = -np.inf
    top = np.argpartition(-score, 20, axis=1)[:, :20]
    hits = [len({i for i, *_ in got[q]} & set(t)) for q, t in zip(asked.tolist(), top.tolist())]
    assert np.mean(hits) / 20 > 0.95


def test_integers_travel_in_few_bytes():
    for most, size in ((3, 2), (40_000, 4), (2**40, 8)):
        x = np.array([[1.0, -most], [0, most]])
        assert len(mtree.narrow(x)) == 1 + 4 * size and (mtree.widen(mtree.narrow(x), 2) == x).all()
