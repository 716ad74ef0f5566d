import zlib

import numpy as np
import pytest

from gleaner.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def corpus(n=300):
    rng = np.random.default_rng(0)
    rows, marks = [], []
    for i in range(n):
        good = i % 3 > 0
        words = [f"w{rng.integers(0, 500)}" for _ in range(40)] if good else ["BUY!!!", "$$$"] * 20
        rows.append((i, " ".join(words) + ("." if good else "%%%"), "en", "a"))
        marks.append((i, int(good), 0))
    return rows, marks


def test_held_out_scores_and_edges(spark, docs):
    rows, marks = corpus()
    rows += [(900, None), (901, ""), (902, "w1 w2 w3"), (902, "w1 w2 w3"), (None, "w5")]
    found = quality.score(docs(rows), spark.createDataFrame([*marks, (None, 1, 0), (900, None, 0)], LABELS)).collect()
    assert len(found) == len(rows)
    by_id = {r["doc_id"]: r for r in found}
    held = [m for m in marks if by_id[m[0]]["held_out"]]
    assert held and np.mean([by_id[i]["predicted"] == q for i, q, _ in held]) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found)
    assert by_id[900]["score"] == by_id[901]["score"] and by_id[None]["held_out"]


def test_without_labels_and_empty_tables(spark, docs):
    none = spark.createDataFrame([], LABELS)
    assert [r["score"] for r in quality.score(docs([(1, "a b c")]), none).collect()] == [0.5]
    assert quality.score(docs([]), none).count() == 0
    assert quality.keep(docs([(1, "a b c")]), none).count() == 1


def test_one_class_alone(spark, docs):
    rows, marks = corpus(60)
    found = quality.score(docs(rows), spark.createDataFrame([(i, 1, 0) for i, _, _ in marks], LABELS)).collect()
    assert min(r["score"] for r in found) > 0.9


def test_keep_leaves_columns(spark, docs):
    rows, marks = corpus()
    made = docs(rows)
    kept = quality.keep(made, spark.createDataFrame(marks, LABELS))
    assert kept.columns == made.columns
    ids = {r["doc_id"] for r in kept.collect()}
    good = {i for i, q, _ in marks if q}
    assert len(ids & good) > 0.97 * len(good) and len(ids - good) < 5


def test_normal_equations_match_direct_ridge(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, len(quality.STATISTICS)))
    y = (x[:, 0] > 0).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(v), False) for r, v in zip(x, y)], "x array<double>, label int, calibrates boolean").repartition(7)
    model = quality.train(rows, features=32)
    z = model.features(x)
    penalty = np.full(33, 1e-3 * 500 / 32)
    penalty[-1] = 0
    direct = np.linalg.solve(z.T @ z + np.diag(penalty) + 1e-9 * np.eye(33), z.T @ y)
    assert np.allclose(model.weights, direct, atol=1e-6)


def test_scores_equal_a_fit_by_hand(spark, docs):
    """The whole operator against NumPy on the driver: folds, standardising, Fourier features, ridge, bins, isotonic steps."""
    rows, marks = corpus(240)
    rows += [(900, None), (901, ""), (902, "w1 w2 w3"), (None, "w5 w6")]
    found = {(r["doc_id"], r["predicted"]): r["score"] for r in quality.score(docs(rows), spark.createDataFrame(marks, LABELS)).collect()}
    fold, label = (lambda i: zlib.crc32(str(i).encode()) % 5), {i: q for i, q, _ in marks}
    x = {r[0]: np.array(quality.statistics(r[1])) for r in rows}
    fit, held = [i for i in label if fold(i) not in (0, 1)], [i for i in label if fold(i) == 1]
    a, y = np.array([x[i] for i in fit]), np.array([label[i] for i in fit], float)
    rng, d = np.random.default_rng(7), a.shape[1]
    scale = np.where(a.std(axis=0) > 1e-6, a.std(axis=0), 1.0)
    frequencies, phases = rng.normal(0, 1 / np.sqrt(d), (d, 256)), rng.uniform(0, 2 * np.pi, 256)
    features = lambda v: np.append(np.cos(np.clip((v - a.mean(axis=0)) / scale, -6, 6) @ frequencies + phases) * np.sqrt(2 / 256), 1.0)
    z = np.array([features(v) for v in a])
    penalty = np.full(257, 1e-3 * len(fit) / 256)
    penalty[-1] = 0
    w = np.linalg.solve(z.T @ z + np.diag(penalty) + 1e-9 * np.eye(257), z.T @ y)
    bins: dict[int, list[int]] = {}
    for i in held:
        bins.setdefault(int(np.floor((np.clip(features(x[i]) @ w, -1, 2) + 1) / 3 * 1024)), []).append(label[i])
    at = sorted(bins)
    steps = quality.isotonic(np.array([np.mean(bins[b]) for b in at]), np.array([len(bins[b]) for b in at], float))
    for i, v in x.items():
        raw = features(v) @ w
        want = np.clip(0.999 * np.interp(raw, [(b + 0.5) / 1024 * 3 - 1 for b in at], steps) + 0.001 * np.clip((raw + 1) / 3, 0, 1), 0, 1)
        assert found[i, int(want >= 0.3)] == pytest.approx(want, abs=1e-6)


def test_isotonic_is_the_least_squares_monotone_fit():
    found = quality.isotonic(np.array([1.0, 0.0, 2.0, 1.0, 5.0]), np.array([1.0, 3.0, 1.0, 1.0, 1.0]))
    assert np.allclose(found, [0.25, 0.25, 1.5, 1.5, 5.0])
    assert len(quality.isotonic(np.zeros(0), np.zeros(0))) == 0
