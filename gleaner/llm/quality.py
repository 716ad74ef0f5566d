"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleaner import tables

from .common import batch, fold, materialise, slices, text_batches, where_text

STATISTICS = (
    "log_chars", "log_words", "word_length", "word_length_sd", "distinct_words", "commonest_word", "adjacent_repeats", "distinct_triples",
    "upper", "lower", "digit", "other_letters", "space", "stops", "marks", "symbols", "bars", "entropy", "distinct_lines", "line_words", "symbol_words", "upper_words",
)
_BYTES = np.arange(256)


def _of(chars: bytes) -> np.ndarray:
    return np.isin(_BYTES, list(chars))


_UPPER, _LOWER, _DIGIT, _OTHER = (_BYTES >= 65) & (_BYTES <= 90), (_BYTES >= 97) & (_BYTES <= 122), (_BYTES >= 48) & (_BYTES <= 57), _BYTES >= 128
_SPACE, _STOPS, _MARKS, _SYMBOLS, _BARS = _of(b" \t\n\r\x0b\x0c"), _of(b".,"), _of(b"!?;:"), _of(b"#$%&*@+=<>^~\\"), _of(b"|/_-")
_CLASSES = np.stack([_UPPER, _LOWER, _DIGIT, _OTHER, _SPACE, _STOPS, _MARKS, _SYMBOLS, _BARS]).astype(float)
_ENDS = frozenset("#$%&*!|@+=<>^~")


def statistics(text: str | None) -> list[float]:
    """The STATISTICS of one whole text; a null or empty text has zeros."""
    words = text.split() if text else []
    if not words:
        return [0.0] * len(STATISTICS)
    n = len(words)
    codes = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256).astype(float)
    total = codes.sum()
    p = codes[codes > 0] / total
    lengths = np.fromiter(map(len, words), np.int32, n)
    counts = Counter(words)
    triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    lines = text.split("\n")
    ends = sum(c for w, c in counts.items() if w[-1] in _ENDS)
    loud = sum(c for w, c in counts.items() if w.isupper())
    return [
        math.log1p(len(text)), math.log1p(n), float(lengths.mean()), float(lengths.std()),
        math.log1p(len(counts)) / math.log1p(n), max(counts.values()) / n, sum(map(eq, words, words[1:])) / n, triples,
        *(_CLASSES @ codes / total).tolist(), float(-(p * np.log2(p)).sum()),
        len(set(lines)) / len(lines), math.log1p(n / len(lines)), ends / n, loud / n,
    ]


@dataclass
class Model:
    """z = sqrt(2 / D) cos(scaled x . frequencies + phases), raw = z . weights + bias, score = the isotonic steps at raw."""

    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    levels: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def features(self, x: np.ndarray) -> np.ndarray:
        """Rows of D Fourier features and a constant."""
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        z = np.cos(x @ self.frequencies + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([z, np.ones((len(z), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), 0.5)
        raw = self.raw(x)
        steps = np.interp(raw, self.knots, self.levels) if len(self.knots) else np.clip(raw, 0, 1)
        # A thousandth of the raw score keeps the order within a step.
        return np.clip(0.999 * steps + 0.001 * np.clip((raw + 1) / 3, 0, 1), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing means nearest to values by weighted squares (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for v, w in zip(values.tolist(), weights.tolist(), strict=True):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([np.full(int(n), v) for v, _, n in blocks]) if blocks else np.zeros(0)


_ROWS = pa.schema([("i", pa.int32()), ("row", pa.binary())])


def _add(rows: DataFrame) -> DataFrame:
    """Sums vectors of equal i: every task keeps one for each i."""

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = np.frombuffer(row)
                total[i] = total[i] + row if i in total else row
        yield batch(_ROWS, list(total), [v.tobytes() for v in total.values()])

    return rows.repartition("i").mapInArrow(run, "i int, row binary")


def train(rows: DataFrame, features: int = 256, ridge: float = 1e-3, width: float = 1.0, seed: int = 7, bins: int = 1024) -> Model:
    """A model of rows (x array<double>, label int, calibrates boolean), all of them.

    Means, normal equations and calibration bins are sums over partitions, so that what
    reaches the driver depends on the number of features alone.
    """
    d = len(STATISTICS)
    fits, calibrates = rows.where("not calibrates"), rows.where("calibrates")

    def sums(batches):
        total = np.zeros((2, d + 1))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            total += np.column_stack([np.full(2, len(x)), np.stack([x.sum(axis=0), (x * x).sum(axis=0)])])
        yield batch(_ROWS, [0, 1], [row.tobytes() for row in total])

    (n, *first), (_, *second) = [np.frombuffer(r["row"]).tolist() for r in sorted(_add(fits.select("x").mapInArrow(sums, "i int, row binary")).collect(), key=lambda r: r["i"])] or [[0.0] * (d + 1)] * 2
    mean = np.array(first) / max(n, 1)
    scale = np.sqrt(np.maximum(np.array(second) / max(n, 1) - mean**2, 0))
    rng = np.random.default_rng(seed)
    model = Model(mean, np.where(scale > 1e-6, scale, 1.0), rng.normal(0, 1 / (width * math.sqrt(d)), (d, features)), rng.uniform(0, 2 * math.pi, features))
    if not n:
        return model
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def equations(batches):
        total = np.zeros((features + 1, features + 2))
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            if not len(x):
                continue
            z = sent.value.features(x)
            total += z.T @ np.column_stack([z, b.column(1).to_numpy(zero_copy_only=False)])
        if total.any():
            yield batch(_ROWS, np.arange(len(total), dtype=np.int32), [row.tobytes() for row in total])

    found = _add(fits.select("x", "label").mapInArrow(equations, "i int, row binary")).collect()
    system = np.array([np.frombuffer(r["row"]) for r in sorted(found, key=lambda r: r["i"])])
    a, y = system[:, :-1], system[:, -1]
    penalty = np.full(len(a), ridge * n / features)
    penalty[-1] = 0
    model.weights = np.linalg.solve(a + np.diag(penalty) + 1e-9 * np.eye(len(a)), y)

    sent = rows.sparkSession.sparkContext.broadcast(model)

    def binned(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy().reshape(-1, d)
            at = np.floor((np.clip(sent.value.raw(x), -1, 2) + 1) / 3 * bins) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), b.column(1)], names=["bin", "label"])

    steps = calibrates.select("x", "label").mapInArrow(binned, "bin long, label int").groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("mean")).collect()
    if steps:
        steps.sort(key=lambda r: r["bin"])
        model.knots = np.array([(r["bin"] + 0.5) / bins * 3 - 1 for r in steps])
        model.levels = isotonic(np.array([r["mean"] for r in steps]), np.array([r["n"] for r in steps], float))
    return model


_STATS = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("x", pa.list_(pa.float64()))])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])


def held_out(id_col: str = "doc_id", folds: int = 5, left: int = 0) -> Column:
    return F.coalesce(fold(id_col, folds) == left, F.lit(True))


def _matrix(texts: list[str | None]) -> np.ndarray:
    return np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, left: int = 0) -> DataFrame:
    """(doc_id, held_out, x): the statistics of every whole text."""
    text_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            flat = _matrix(b.column(2).to_pylist()).reshape(-1)
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(offsets, pa.array(flat, pa.float64()))], schema=_STATS)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, folds, left).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, x array<double>")


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", folds: int = 5, left: int = 0, **fit):
    """A broadcast model of measured, labelled rows that aren't held out; one fold more calibrates."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).where("label is not null")
    calibrates = fold("doc_id", folds) == (left + 1) % folds
    rows = stats.where("not held_out").join(known, "doc_id").select("x", "label", calibrates.alias("calibrates"))
    return stats.sparkSession.sparkContext.broadcast(train(materialise(rows, "labelled"), **fit))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, left: int = 0, threshold: float = 0.3, **fit) -> DataFrame:
    """Scores every whole text for quality: (doc_id, held_out, score, predicted).

    Learns from labelled rows whose crc32(id as text) modulo folds isn't ``left``: one fold
    calibrates, the others fit; a score sees the text alone. score, 0 to 1, is the
    calibrated probability of label 1, and predicted is 1 from threshold on. Null and
    empty texts are scored like any other, by statistics of zero. Without any label
    every score is 0.5. Rows of a null id or label teach nothing; repeated rows are each
    scored, alike; an empty table gives no rows; other columns are not read.
    """
    stats = materialise(measured(docs, id_col, text_col, folds, left), "statistics")
    sent = learn(stats, labels, id_col, label_col, folds, left, **fit)

    def predict(batches):
        for b in batches:
            x = b.column(2).flatten().to_numpy().reshape(-1, len(STATISTICS))
            s = sent.value.score(x) if len(x) else np.zeros(0)
            yield batch(_SCORED, b.column(0), b.column(1), s, (s >= threshold).astype(np.int32))

    return stats.mapInArrow(predict, "doc_id long, held_out boolean, score double, predicted int")


#: Labels of which the ids are sent to where texts are read; more are joined after statistics, by a shuffle of those.
FEW_LABELS = 500_000


def keep(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", folds: int = 5, left: int = 0, **fit) -> DataFrame:
    """Rows of docs that score ``threshold`` or more.

    Null and empty texts are scored like any other; repeated rows and rows of a null id
    are each decided; an empty table gives an empty one; without labels every row stays.
    Columns are unchanged, whatever their names; no text is shuffled. To learn, the rows
    of labelled ids alone are measured if a count says that those are few.
    """
    taught = docs.where(~held_out(id_col, folds, left)).select(F.col(id_col).cast("long").alias(id_col), text_col)
    known = labels.where(F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias(id_col)).distinct()
    if tables.few(known, FEW_LABELS):
        taught = taught.join(F.broadcast(known), id_col, "left_semi")
    sent = learn(measured(taught, id_col, text_col, folds, left), labels, id_col, label_col, folds, left, **fit)
    return where_text(docs, text_col, lambda texts: (sent.value.score(_matrix(texts)) >= threshold).tolist())
