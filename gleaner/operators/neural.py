"""A tagger over token features in NumPy, and the scorer that decodes what it, or any other function of features, returns.

No weights are shipped. Bundles are safetensors files of int8 tensors with a float scale for
each channel; arrays of floats work as well.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import numpy as np

from gleaner.functions.offsets import byte_offsets
from gleaner.schema import Component, Entity

from . import decode, postal, spans
from .features import Config, Features, featurize
from .tokens import tokenize

#: Fixed values of the shipped contract.
PARSER_DILATIONS, DETECTOR_DILATIONS = (1, 2, 4, 8), (1, 2, 4, 8, 16, 1, 64)
EPSILON, MARGIN, OVERLAP, MOST_HEADER = 1e-5, 96, 448, 64 * 1024
PARSER_LABELS, DETECTOR_LABELS = 23, 7


class BundleError(ValueError):
    """A bundle that doesn't hold what it has to."""


def read_bundle(data: bytes, checksum: str | None = None) -> tuple[dict[str, str], dict[str, np.ndarray]]:
    """(metadata, tensors) of a safetensors file: a small header, tensors that tile the rest exactly, and a digest if one is expected."""
    if checksum and f"sha256-{hashlib.sha256(data).hexdigest()}" != checksum.strip().lower():
        raise BundleError("checksum differs")
    n = int.from_bytes(data[:8], "little")
    if len(data) < 8 or n > MOST_HEADER or 8 + n > len(data):
        raise BundleError("no header of a possible length")
    try:
        header = json.loads(data[8 : 8 + n])
        entries = [(name, e["dtype"], tuple(e["shape"]), *e["data_offsets"]) for name, e in header.items() if name != "__metadata__"]
    except (ValueError, KeyError, TypeError, AttributeError) as problem:
        raise BundleError("malformed header") from problem
    body, tensors, at = data[8 + n :], {}, 0
    for name, dtype, shape, begin, end in sorted(entries, key=lambda e: (e[3], e[4])):
        kind = {"I8": np.dtype("i1"), "F32": np.dtype("<f4")}.get(dtype)
        if kind is None or begin != at or end > len(body) or end - begin != kind.itemsize * int(np.prod(shape, dtype=np.int64)):
            raise BundleError(f"tensor {name} has no place")
        tensors[name], at = np.frombuffer(body[begin:end], kind).reshape(shape), end
    if at != len(body):
        raise BundleError("tensors don't cover the file")
    return header.get("__metadata__") or {}, tensors


@dataclass(frozen=True)
class Model:
    """What a model directory holds: metadata and tensors, verified, and the hints that requests without any get."""

    metadata: dict
    tensors: dict[str, np.ndarray]
    country_hint: tuple[str, ...]


def read_model(folder: str, runtime: str | None = None) -> Model:
    """The model of a directory: bundle.json names one file in it, its sha256 and maybe its size and runtime; whatever doesn't fit is an error."""
    manifest_path = Path(folder, "bundle.json")
    try:
        manifest = json.loads(manifest_path.read_bytes())
        name, digest, size, metadata = manifest["file"], manifest["sha256"], manifest.get("bytes"), manifest.get("metadata") or {}
    except (OSError, ValueError, KeyError, TypeError, AttributeError) as problem:
        raise BundleError(f"{manifest_path}: {problem!r}") from problem
    if runtime is not None and manifest.get("runtime") != runtime:
        raise BundleError(f"{manifest_path}: runtime {manifest.get('runtime')!r} is not {runtime!r}")
    if not re.fullmatch("[0-9A-Fa-f]{64}", str(digest)):
        raise BundleError(f"{manifest_path}: sha256 is no digest")
    if not isinstance(name, str) or name in ("", ".", "..") or Path(name).name != name:
        raise BundleError(f"{manifest_path}: {name!r} names no file of the directory")
    try:
        data = Path(folder, name).read_bytes()
    except OSError as problem:
        raise BundleError(str(problem)) from problem
    if size is not None and size != len(data):
        raise BundleError(f"{name}: {len(data)} bytes instead of {size}")
    own, tensors = read_bundle(data, f"sha256-{digest}")
    return Model({**own, **metadata}, tensors, ("US",) if metadata.get("detector_input_policy") == "known_us" else ())


def weights(tensors: dict[str, np.ndarray], name: str, axis: int = 0) -> np.ndarray:
    """A tensor as floats, scaled by channel if it is int8."""
    if name not in tensors:
        raise BundleError(f"no tensor {name}")
    w = tensors[name]
    return decode.dequantise(w, tensors[f"{name}.scale"], axis) if w.dtype == np.int8 else w.astype(np.float32)


def embedding_mean(table: np.ndarray, ids: list[tuple[int, ...]]) -> np.ndarray:
    """The mean of rows id + 1 of each list of ids; zeros for none. Row 0 is padding."""
    out = np.zeros((len(ids), table.shape[1]), np.float32)
    for i, own in enumerate(ids):
        if own:
            out[i] = table[np.asarray(own) + 1].mean(axis=0)
    return out


def convolve(x: np.ndarray, w: np.ndarray, bias: np.ndarray, dilation: int) -> np.ndarray:
    """A dilated convolution of the same length; w is (out, in, taps)."""
    half, n = (w.shape[2] - 1) // 2, len(x)
    out = np.broadcast_to(bias, (n, w.shape[0])).astype(np.float32)
    for k in range(w.shape[2]):
        shift = (k - half) * dilation
        a, b = max(0, -shift), min(n, n - shift)
        if a < b:
            out[a:b] += x[a + shift : b + shift] @ w[:, :, k].T
    return out


def channel_rms(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).mean(axis=1, keepdims=True) + np.float32(EPSILON))


@dataclass
class Tagger:
    """Embeddings, a projection, residual blocks of dilated convolutions and a head."""

    ngram: np.ndarray
    script: np.ndarray
    shape: np.ndarray
    proj: tuple[np.ndarray, np.ndarray]
    blocks: list[tuple[np.ndarray, np.ndarray]]
    head: tuple[np.ndarray, np.ndarray]
    dilations: tuple[int, ...]
    flag_bits: int = 23
    rms: bool = False

    @classmethod
    def load(cls, tensors: dict[str, np.ndarray], net: str, dilations: tuple[int, ...], flag_bits: int = 23, rms: bool = False) -> Tagger:
        pair = lambda n: (weights(tensors, f"{net}.{n}.weight"), weights(tensors, f"{net}.{n}.bias"))
        tables = [weights(tensors, f"{net}.embed.{n}", 1) for n in ("ngram", "script", "shape")]
        return cls(*tables, pair("proj"), [pair(f"block{i}") for i in range(len(dilations))], pair("head"), dilations, flag_bits, rms)

    def __call__(self, found: list[Features]) -> np.ndarray:
        """Logits, a row for each token."""
        if any(f.flags >> self.flag_bits for f in found):
            raise BundleError("features have flags that this network doesn't know")
        bits = np.array([[(f.flags >> b) & 1 for b in range(self.flag_bits)] for f in found], np.float32).reshape(len(found), self.flag_bits)
        x = np.hstack([embedding_mean(self.ngram, [f.ngram_ids for f in found]), self.script[[f.script for f in found]], self.shape[[f.shape for f in found]], bits])
        h = x @ self.proj[0].T + self.proj[1]
        for (w, bias), dilation in zip(self.blocks, self.dilations, strict=True):
            h = h + np.maximum(convolve(h, w, bias, dilation), 0)
            if self.rms:
                h = channel_rms(h)
        out = h @ self.head[0].T + self.head[1]
        if not np.isfinite(out).all():
            raise BundleError("the network returned numbers that aren't finite")
        return out


Score = Callable[[list[Features]], np.ndarray]


@dataclass
class LogitScorer:
    """A scorer for plans.api from two functions of features to logits: windows, decoding and postal rules around them."""

    detector: Score
    parser: Score
    config: Config = field(default_factory=lambda: Config(buckets=32_768))
    tab_cells: bool = True
    margin: int = MARGIN
    overlap: int = OVERLAP

    def detect(self, text: str, rules: list[Entity], regions: list[str], mask: spans.Mask | None) -> list[Entity]:
        tokens = tokenize(text)
        found = featurize(tokens, [(e.start, e.end) for e in rules], None, self.config, mask.contains if mask else None, self.tab_cells)
        kept = spans.retained(tokens)
        before = spans.breaks(tokens, kept)
        hidden = [found[i].has("masked") for i in kept]
        masked = [h or found[i].has("in_rule_span") for h, i in zip(hidden, kept, strict=True)]
        places = byte_offsets(text)
        at = {b: c for c, b in enumerate(places)}
        bounds = [(at[tokens[i].start], at[tokens[i].end]) for i in kept]
        out = []
        for w in spans.windows(before, overlap=self.overlap, masked=hidden if mask else None):
            inside = slice(w.start, w.end)
            p = decode.softmax(self.detector([found[i] for i in kept[inside]]))
            paragraph = [b == 3 and n > 0 for n, b in enumerate(before[inside])]
            labels = decode.viterbi(p, masked[inside], paragraph)
            decoded = decode.spans_of(p, labels, paragraph)
            for step in (postal.join, postal.separate):
                decoded = step(text, bounds[inside], p, labels, masked[inside], paragraph, decoded)
            for kind, first, last, sure in decoded:
                if w.trusts(w.start + first, w.start + last, self.margin):
                    start, end = bounds[w.start + first][0], bounds[w.start + last][1]
                    end = postal.zip_end(text, start, end) if kind == "address" else end
                    out.append(Entity(kind, places[start], places[end], sure, "model"))
        return out

    def parse(self, text: str, country: str | None) -> list[Component]:
        tokens = tokenize(text)
        kept = spans.retained(tokens)
        if not kept:
            return []
        found = featurize(tokens, config=self.config)
        p = decode.softmax(self.parser([found[i] for i in kept]))
        return decode.components([(tokens[i].start, tokens[i].end) for i in kept], decode.decode_parser(p))
