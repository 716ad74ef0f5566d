"""Language identification: sparse multinomial regression on TF-IDF character n-grams.

Trained with follow-the-regularised-leader (FTRL-proximal, elastic-net penalties) and
calibrated by a temperature.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batch, first_of_groups, fold, materialise, slices, text_batches, where_text

#: Hash buckets that character n-grams share.
BUCKETS = 1 << 16
#: Lengths of n-grams.
ORDERS = 4
#: Rows of each label that weights are fitted on, rows of all labels together, and labels (the most frequent), at most: they bound the sample, and the model.
ROWS_PER_LABEL, SAMPLE_ROWS, MOST_LABELS = 500, 8000, 200
UNKNOWN = "und"
#: Characters of a text that are numbers at a time.
_PART = 1 << 20


@functools.cache
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000)


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the hashed n-grams of one whole text; empty if it has no letter.

    Text is lower-cased; whatever isn't a letter becomes one space, so that n-grams see
    where words begin and end.
    """
    lowered, total, tail, open_word = (text or "").lower(), np.zeros(0, np.int64), None, False
    for k in range(0, len(lowered), _PART):
        codes = np.frombuffer(lowered[k : k + _PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= open_word
        open_word = bool(letter[-1])
        stream = np.where(letter, codes, np.uint32(32))[keep]
        if not len(stream):
            continue
        if tail is None:
            stream, seen = np.concatenate(([np.uint32(32)], stream)), 0
        else:  # n-grams that began in the part before
            stream, seen = np.concatenate((tail, stream)), len(tail)
        total = _add_counts(total, stream, seen)
        tail = stream[1 - ORDERS :]
    if tail is None:
        return np.zeros(0, np.int64), np.zeros(0)
    if open_word:
        total = _add_counts(total, np.concatenate((tail, [np.uint32(32)])), len(tail))
    at = np.flatnonzero(total)
    return at, total[at]


def _add_counts(total: np.ndarray, stream: np.ndarray, seen: int) -> np.ndarray:
    """Adds the n-grams of a stream that end behind its first ``seen`` characters."""
    gram, found = np.zeros(len(stream), np.uint32), []
    for n in range(min(ORDERS, len(stream))):
        gram = gram[: len(stream) - n] * np.uint32(0x9E3779B1) + stream[n:] + np.uint32(n)
        found.append((gram[max(0, seen - n) :] * np.uint32(0x85EBCA6B)) >> np.uint32(16))
    counts = np.bincount(np.concatenate(found), minlength=BUCKETS)
    return total + counts if len(total) else counts


@dataclass
class Model:
    """labels in code point order; weights has a last row for the bias."""

    labels: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def features(self, at: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (1 + np.log(counts)) * self.idf[at]
        return np.append(at.astype(np.int32), np.int32(BUCKETS)), np.append(x / np.sqrt((x * x).sum()), 1.0).astype(np.float32)

    def logits(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        i, x = self.features(at, counts)
        return x @ self.weights[i]

    def predict(self, text: str | None) -> tuple[str, float]:
        at, counts = grams(text)
        if not len(at) or not self.labels:
            return UNKNOWN, 0.0
        p = softmax(self.logits(at, counts) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], n_labels: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4) -> np.ndarray:
    """Weights (BUCKETS + 1, n_labels) by FTRL-proximal over rows of (places, values, label); the bias isn't penalised by l1."""
    z, n = np.zeros((BUCKETS + 1, n_labels)), np.zeros((BUCKETS + 1, n_labels))

    def weights(zi, ni, free):
        w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
        w[free] = -zi[free] / ((beta + np.sqrt(ni[free])) / alpha + l2)
        return w

    order = np.arange(len(rows))
    for epoch in range(epochs):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            i, x, y = rows[k]
            zi, ni = z[i], n[i]
            w = weights(zi, ni, -1)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            more = ni + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(ni)) / alpha * w
            n[i] = more
    return weights(z, n, -1)


def best_temperature(logits: list[np.ndarray], labels: list[int]) -> float:
    """The temperature of least log loss, by golden section on its logarithm."""
    if not logits:
        return 1.0
    z, y = np.array(logits), np.array(labels)
    z = z - z.max(axis=1, keepdims=True)

    def loss(t: float) -> float:
        s = z / np.exp(t)
        return float((np.log(np.exp(s).sum(axis=1)) - s[np.arange(len(y)), y]).mean())

    lo, hi, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


_DF = pa.schema([("bucket", pa.int32()), ("df", pa.int64())])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies of all buckets over all rows of docs (text).

    A task sums its own rows first; at most BUCKETS + 1 numbers reach the driver.
    """

    def run(batches):
        df = np.zeros(BUCKETS + 1, np.int64)
        for b in slices(batches):
            for text in b.column(0).to_pylist():
                at, _ = grams(text)
                if len(at):
                    df[at] += 1
                    df[BUCKETS] += 1
        at = np.flatnonzero(df)
        yield batch(_DF, at.astype(np.int32), df[at])

    rows = docs.select("text").mapInArrow(run, "bucket int, df long").groupBy("bucket").agg(F.sum("df").alias("df")).collect()
    df = np.zeros(BUCKETS + 1)
    for bucket, n in rows:
        df[bucket] = n
    return np.log((1 + df[BUCKETS]) / (1 + df[:BUCKETS])) + 1


_SAMPLE = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.binary()), ("counts", pa.binary())])


def sample(docs: DataFrame, rows_per_label: int = ROWS_PER_LABEL) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Features of at most rows_per_label labelled rows of each label, those of least hashed id.

    Only ids are ranked, part by part, so that a label with most of the rows is no burden. The ids' number has a fixed bound, so they are broadcast.
    """
    ids = first_of_groups(docs.select("doc_id", "lang", F.xxhash64("doc_id").alias("mixed")), ["lang"], ["mixed", "doc_id"], rows_per_label)
    ids = materialise(ids.select("doc_id", "lang").distinct(), "sample").withColumnRenamed("lang", "picked")

    def run(batches):
        for b in slices(batches):
            found = [grams(t) for t in b.column(2).to_pylist()]
            yield batch(_SAMPLE, b.column(0), b.column(1), [a.astype("<u2").tobytes() for a, _ in found], [c.astype("<f4").tobytes() for _, c in found])

    texts = docs.join(F.broadcast(ids), "doc_id").where(F.col("lang") == F.col("picked")).select("doc_id", "lang", "text")
    found = texts.mapInArrow(run, "doc_id long, lang string, at binary, counts binary").where("length(at) > 0")
    rows = found.groupBy("doc_id", "lang").agg(F.min(F.struct("at", "counts")).alias("f")).collect()  # one of the rows of an id
    rows.sort(key=lambda r: (r["lang"], r["doc_id"]))
    return [(r["lang"], np.frombuffer(r["f"]["at"], "<u2"), np.frombuffer(r["f"]["counts"], "<f4")) for r in rows]


def train(docs: DataFrame, rows_per_label: int = ROWS_PER_LABEL, most_labels: int = MOST_LABELS, **penalties) -> Model:
    """A model of docs (doc_id, text, lang): document frequencies of every row, weights of a bounded sample.

    Of more than ``most_labels`` labels the most frequent are learned. A fifth of the sample is left out of the weights and sets the temperature.
    """
    docs = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    frequent = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_labels).collect()
    labels = sorted(r["lang"] for r in frequent)
    rows_per_label = max(1, min(rows_per_label, SAMPLE_ROWS // max(1, len(labels))))
    if not labels:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS + 1, 0)))
    model = Model(labels, inverse_frequencies(docs), np.zeros((BUCKETS + 1, len(labels))))
    place = {x: i for i, x in enumerate(labels)}
    rows = sample(docs.where(F.col("lang").isin(labels)), rows_per_label)
    kept = [(*model.features(at, c), place[lang]) for k, (lang, at, c) in enumerate(rows) if k % 5 != 4 or len(rows) < 20]
    left = [(at, c, place[lang]) for k, (lang, at, c) in enumerate(rows) if k % 5 == 4 and len(rows) >= 20]
    model.weights = ftrl(kept, len(labels), **penalties)
    model.temperature = best_temperature([model.logits(at, c) for at, c, _ in left], [y for *_, y in left])
    return model


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])


def held_out(id_col: str = "doc_id", folds: int = 4, left: int = 2) -> Column:
    """Rows that training never sees; a null id is one of them."""
    return F.coalesce(fold(id_col, folds) == left, F.lit(True))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, left: int = 2, rows_per_label: int = ROWS_PER_LABEL, most_labels: int = MOST_LABELS, **penalties):
    """A broadcast model of the text and non-null language of rows whose crc32(id as text) modulo folds isn't ``left``."""
    text_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = train(source.where(~held_out("doc_id", folds, left)), rows_per_label, most_labels, **penalties)
    model.weights = model.weights.astype(np.float32)
    return docs.sparkSession.sparkContext.broadcast(model)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, left: int = 2, rows_per_label: int = ROWS_PER_LABEL, most_labels: int = MOST_LABELS, **penalties) -> DataFrame:
    """Predicts the language of every whole text: (doc_id, held_out, lang_pred, score).

    Learns from text and non-null language of rows whose crc32(id as text) modulo folds
    isn't ``left``: document frequencies of all of them, weights of at most rows_per_label
    of each label and SAMPLE_ROWS in all; of more than most_labels labels the most frequent
    are learned. Predictions see the text alone. score is the calibrated probability of
    the label predicted. A null or empty text, or one without a letter, is ``und`` with
    score 0, as is everything if there is nothing to learn from; an empty table gives no
    rows; repeated rows are each predicted, alike; ids may be null; other columns are not read.
    """
    sent = learn(docs, id_col, text_col, lang_col, folds, left, rows_per_label, most_labels, **penalties)

    def run(batches):
        for b in slices(batches):
            found = [sent.value.predict(t) for t in b.column(2).to_pylist()]
            yield batch(_PREDICTED, b.column(0), b.column(1), [x for x, _ in found], [p for _, p in found])

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col, folds, left).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def keep(docs: DataFrame, least: float = 0.3, text_col: str = "text", **columns) -> DataFrame:
    """Rows of docs in a known language: not ``und``, and predicted with a probability of ``least`` or more.

    Null and empty texts and those without a letter go; repeated rows and rows of a null id
    are each decided; an empty table gives an empty one. Columns are unchanged, whatever
    their names; each row is decided where it is read, so no text is shuffled. Without any
    language to learn from, every row with a letter stays.
    """
    sent = learn(docs, text_col=text_col, **columns)

    def known(text: str | None) -> bool:
        if not sent.value.labels:
            return bool(len(grams(text)[0]))
        return sent.value.predict(text)[1] >= least

    return where_text(docs, text_col, lambda texts: [known(t) for t in texts])
