"""From scores of labels to spans: what a pluggable scorer returns is decoded here."""

from __future__ import annotations

import numpy as np

from gleaner.schema import ADDRESS_LABELS, Component

from .spans import MOST_ENTITY_TOKENS

DETECTOR_KINDS = ("person", "org", "address")
_FLOOR = float(np.log(np.finfo(np.float32).tiny))


def softmax(logits: np.ndarray) -> np.ndarray:
    x = np.asarray(logits, np.float32)
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _moves(n: int) -> np.ndarray:
    """0 where a label may follow another, else minus infinity; label 0 is outside, odd ones begin, even ones continue their kind."""
    labels = np.arange(n)
    kind = (labels - 1) // 2
    continues = (labels > 0) & (labels % 2 == 0)
    fits = (labels[:, None] > 0) & (kind[:, None] == kind[None])
    return np.where(continues[None] & ~fits, -np.inf, 0.0).astype(np.float32)


def viterbi(probabilities: np.ndarray, masked: np.ndarray, paragraph: np.ndarray) -> np.ndarray:
    """The likeliest labels in which what continues a span continues one: outside where masked, nothing across paragraphs."""
    p = np.asarray(probabilities, np.float32)
    n, k = p.shape
    logs = np.maximum(np.log(np.where(np.isnan(p) | (p <= 0), np.finfo(np.float32).tiny, p)), np.float32(_FLOOR))
    moves = _moves(k)
    fresh = np.where((np.arange(k) > 0) & (np.arange(k) % 2 == 0), -np.inf, 0.0).astype(np.float32)
    score, back = np.zeros(k, np.float32), np.zeros((n, k), np.int64)
    for t in range(n):
        emit = np.where(np.arange(k) == 0, 0.0, -np.inf).astype(np.float32) if masked[t] else logs[t]
        if t == 0:
            score = emit + fresh
        else:
            step = np.broadcast_to(fresh, (k, k)) if paragraph[t] else moves
            all_scores = score[:, None] + emit[None] + step
            back[t] = all_scores.argmax(axis=0)
            score = all_scores.max(axis=0)
        best = score.max()
        if np.isfinite(best):
            score = score - best
    out = np.zeros(n, np.int64)
    if n:
        out[-1] = int(score.argmax())
        for t in range(n - 1, 0, -1):
            out[t - 1] = back[t, out[t]]
    return out


def spans_of(probabilities: np.ndarray, labels: np.ndarray, paragraph: np.ndarray, kinds: tuple[str, ...] = DETECTOR_KINDS) -> list[tuple[str, int, int, float]]:
    """(kind, first, last, mean probability) of each run that begins and goes on with one kind; too long ones go."""
    out, previous, n = [], 0, len(labels)
    runs: list[list[int]] = []
    for t in range(n):
        label = int(labels[t])
        if t and paragraph[t]:
            previous = 0
        if label and label % 2 == 0 and previous and (previous - 1) // 2 == (label - 1) // 2:
            runs[-1].append(t)
        elif label:
            runs.append([t])
        previous = label
    for run in runs:
        if len(run) <= MOST_ENTITY_TOKENS:
            p = np.nan_to_num(np.asarray(probabilities, np.float32)[run, labels[run]], nan=0.0)
            out.append((kinds[(int(labels[run[0]]) - 1) // 2], run[0], run[-1], float(p.sum(dtype=np.float32) / np.float32(len(run)))))
    return out


def decode_detector(probabilities: np.ndarray, masked: np.ndarray, paragraph: np.ndarray) -> list[tuple[str, int, int, float]]:
    return spans_of(probabilities, viterbi(probabilities, masked, paragraph), paragraph)


def decode_parser(probabilities: np.ndarray) -> list[tuple[int, float]]:
    """The likeliest label of each row that may follow the one before, with its probability."""
    p = np.nan_to_num(np.asarray(probabilities, np.float32), nan=0.0)
    moves, out, previous = _moves(p.shape[1]), [], 0
    for row in p:
        best = int((row + moves[previous]).argmax())
        out.append((best, float(row[best])))
        previous = best
    return out


def components(token_spans: list[tuple[int, int]], decoded: list[tuple[int, float]]) -> list[Component]:
    """Components of an address from its labels, each with the mean probability of its tokens."""
    groups: list[tuple[int, list[tuple[int, int]], list[float]]] = []
    previous = 0
    for span, (label, p) in zip(token_spans, decoded, strict=True):
        if label and label % 2 == 0 and previous and (previous - 1) // 2 == (label - 1) // 2:
            groups[-1][1].append(span)
            groups[-1][2].append(p)
        elif label:
            groups.append((label, [span], [p]))
        previous = label
    return [Component(ADDRESS_LABELS[(label - 1) // 2], spans[0][0], spans[-1][1], sum(p) / len(p)) for label, spans, p in groups]


def encode_bio(token_spans: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[int]:
    """Labels of tokens from spans (start, end, kind index); a span that cuts a token is an error."""
    out = [0] * len(token_spans)
    for start, end, kind in spans:
        inside = [i for i, (a, b) in enumerate(token_spans) if a < end and start < b]
        if not inside or token_spans[inside[0]][0] < start or token_spans[inside[-1]][1] > end:
            raise ValueError(f"span {start}..{end} isn't made of whole tokens")
        for i in inside:
            out[i] = 2 + 2 * kind
        out[inside[0]] = 1 + 2 * kind
    return out


def quantise(weights: np.ndarray, axis: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(int8 values, float scale of each channel along axis): the largest absolute weight over 127, halves to even."""
    w = np.asarray(weights, np.float32)
    other = tuple(i for i in range(w.ndim) if i != axis)
    scale = np.abs(w).max(axis=other) / np.float32(127)
    shape = [1] * w.ndim
    shape[axis] = -1
    safe = np.where(scale > 0, scale, 1).reshape(shape)
    return np.clip(np.rint(w / safe), -127, 127).astype(np.int8), scale.astype(np.float32)


def dequantise(values: np.ndarray, scale: np.ndarray, axis: int = 0) -> np.ndarray:
    shape = [1] * values.ndim
    shape[axis] = -1
    return values.astype(np.float32) * scale.reshape(shape)
