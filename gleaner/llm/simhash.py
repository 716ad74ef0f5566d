"""SimHash near-duplicate groups by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, batch, materialise, slices, text_batches
from .graph import components

SEED = 42
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_PLACE = np.arange(8, dtype=np.int64) * 256
_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprint(text: bytes | None, size: int = 4) -> int:
    """The 64-bit SimHash of one UTF-8 text, unsigned.

    Lower-cases A-Z, takes words between ASCII white space and hashes every run of
    ``size`` words, repeats included; with fewer words, the whole sequence; with none
    (a null text too) the fingerprint is 0. A bit is 1 if set in over half the hashes.
    """
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts, stops, strict=True)], np.uint64)
    counts = np.zeros(2048, np.int64)
    for k in range(0, n, 1 << 16):
        part = hashes[k : k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8) + _PLACE
        counts += np.bincount(part.ravel(), minlength=2048)
    ones = np.einsum("pv,vb->pb", counts.reshape(8, 256), _BITS).ravel()
    return int(_POWERS[2 * ones > n].sum(dtype=np.uint64))


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(doc_id, fp) for every row; fp holds the unsigned bits in a long. Reads two columns, keeps no state."""
    text_batches(docs.sparkSession)

    def run(batches):
        for b in slices(batches):
            found = np.array([fingerprint(t, size) for t in as_bytes(b.column(1))], np.uint64)
            yield batch(_FP, b.column(0), found.view(np.int64))

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, width: int = 64) -> list[int]:
    """All signed 64-bit patterns of at most radius set bits."""
    found, layer = [0], [(0, -1)]
    for _ in range(radius):
        layer = [(m | 1 << i, i) for m, last in layer for i in range(last + 1, width)]
        found += [m for m, _ in layer]
    return [m - (1 << 64) if m >> 63 else m for m in found]


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints, by the whole ball around each.

    Each fingerprint emits every variant within half the radius, and the variants are
    shuffled. Whoever shares a variant is within the radius of each other, as two halves
    make a whole, so that a star to the least one links them without any pair being
    tried. This takes 2081 rows a fingerprint for radius 4, so links() keeps it for
    fingerprints in crowded neighbourhoods.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    ball = F.array(*[F.lit(m).cast("long") for m in masks(radius // 2)])
    out = fps.select("fp", F.explode(F.transform(ball, lambda m: F.col("fp").bitwiseXOR(m))).alias("variant"))
    least = out.groupBy("variant").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    return out.join(least, "variant").where("fp <> a").select("a", F.col("fp").alias("b")).distinct()


#: Members of a key that are compared with each other; beyond, comparing costs more than their whole balls.
CROWD = 4096
_SMALL = 24
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _split(x: np.ndarray, side: np.ndarray) -> np.ndarray:
    """The half of each fingerprint that its key is of; side 0 is the high half."""
    return np.where(side == 0, x >> np.uint64(32), x & np.uint64(0xFFFFFFFF))


def _canonical(keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a key is the one that reports the pair: of the half that differs in two bits or fewer
    (the high one if both do), the variant between them that is least by the lowest differing bit."""
    side, variant = keys >> np.uint64(32), keys & np.uint64(0xFFFFFFFF)
    high = np.bitwise_count((a ^ b) >> np.uint64(32)) <= 2
    ha, hb = _split(a, side), _split(b, side)
    x = ha ^ hb
    n, low = np.bitwise_count(x), x & (~x + np.uint64(1))
    want = np.where(n == 0, ha, np.where(n == 1, np.minimum(ha, hb), np.minimum(ha ^ low, hb ^ low)))
    return (variant == want) & ((side == 0) == high)


def _pairs(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within runs of equal keys; keys are sorted, and fingerprints within each."""
    left, right = [], []
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts, sizes = np.concatenate(([0], cuts)), np.diff(np.concatenate(([0], cuts, [len(keys)])))
    small = np.repeat(sizes <= _SMALL, sizes)
    k, f = keys[small], fps[small]
    for s in range(1, _SMALL):
        i = np.flatnonzero(k[s:] == k[:-s])
        if not len(i):
            break
        a, b = f[i], f[i + s]
        near = np.bitwise_count(a ^ b) <= radius
        a, b, i = a[near], b[near], i[near]
        own = _canonical(k[i], a, b)
        left.append(a[own])
        right.append(b[own])
    for start, size in zip(starts[sizes > _SMALL].tolist(), sizes[sizes > _SMALL].tolist(), strict=True):
        rest = fps[start : start + size]
        while len(rest) > 1:  # a component of the run at a time, each as a star
            root, todo, rest = rest[0], [rest[0]], rest[1:]
            while todo and len(rest):
                near = np.bitwise_count(rest ^ todo.pop()) <= radius
                if near.any():
                    found, rest = rest[near], rest[~near]
                    left.append(np.full(len(found), root))
                    right.append(found)
                    todo.extend(found.tolist())
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """Links (a, b) among distinct fingerprints that join all that radius joins, by balls of half words.

    Of two fingerprints within radius 4, one 32-bit half differs in two bits or fewer. So
    each half emits all its variants within half of that, one bit (33 a half, 66 in all,
    where whole words take 2081), and the variants are shuffled. Those that meet under a
    variant are verified over all 64 bits. Under a variant with more than CROWD
    fingerprints nothing is compared: those go to ball_links, whose cost is in
    proportion to their number. No task holds more than CROWD fingerprints of one key.
    """
    if radius != 4:
        return ball_links(fps, radius)
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i).cast("long") for i in range(32)])
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    keys = F.concat(F.transform(flips, lambda m: high.bitwiseXOR(m)), F.transform(flips, lambda m: low.bitwiseXOR(m) + F.lit(1 << 32)))
    out = fps.select("fp", F.explode(keys).alias("key"))

    def run(batches):
        none = np.zeros(0, np.int64)
        keys, fps, hot = none, none, None

        def links_of(k, f):
            a, b = _pairs(k.view(np.uint64), f.view(np.uint64), radius)
            return batch(_LINK, a.view(np.int64), b.view(np.int64))

        for b in batches:
            keys = np.concatenate((keys, b.column(0).to_numpy()))
            fps = np.concatenate((fps, b.column(1).to_numpy()))
            if hot is not None:  # the rest of a crowd
                more = int(np.searchsorted(keys, hot, "right"))
                yield batch(_LINK, fps[:more], fps[:more])
                keys, fps = keys[more:], fps[more:]
                if not len(keys):
                    continue
                hot = None
            first = int(np.searchsorted(keys, keys[-1]))
            whole, members = keys[:first], fps[:first]
            if len(keys) - first > CROWD:
                hot = keys[-1]
                yield batch(_LINK, fps[first:], fps[first:])
                keys, fps = none, none
            else:
                keys, fps = keys[first:], fps[first:]
            if len(whole):
                size = np.unique_counts(whole).counts
                crowd = np.repeat(size > CROWD, size)
                if crowd.any():
                    yield batch(_LINK, members[crowd], members[crowd])
                    whole, members = whole[~crowd], members[~crowd]
                if len(whole):
                    yield links_of(whole, members)
        if len(keys):
            yield links_of(keys, fps)

    met = out.repartition("key").sortWithinPartitions("key", "fp").select("key", "fp").mapInArrow(run, "a long, b long").distinct()
    met = materialise(met, "links")
    found, crowded = met.where("a <> b"), met.where("a = b").select(F.col("a").alias("fp"))
    return found if crowded.isEmpty() else found.unionByName(ball_links(crowded, radius))


def _placed(fps: DataFrame, radius: int) -> DataFrame:
    """(fp, root, component_id) of each distinct fingerprint; root is the least fingerprint of its component.

    Copies share a fingerprint, so that only distinct fingerprints are linked: a group of
    copies, however large, is one row there, found by a combined grouped minimum.
    """
    reps = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "distinct")
    roots = components(links(reps.select("fp"), radius))
    placed = reps.join(roots, reps.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    return placed.join(named, "root").select("fp", "root", "component_id")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """Near-duplicate groups: (doc_id, fp, component_id), one row for each row of docs.

    Fingerprints link at ``radius`` or fewer differing bits, and component_id is the least
    doc_id that links lead to, its own included. Null and empty texts have fingerprint 0
    and link like any other. Repeated rows stay and share a component; a null doc_id stays
    and never names a component unless all of the component are null. An empty table gives
    an empty result; other columns of docs are never looked at, whatever their names.
    """
    fps = materialise(fingerprints(docs, id_col, text_col, size), "fingerprints")
    return fps.join(_placed(fps, radius).drop("root"), "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp: str = "fp"):
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")


_KEYED = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64()), ("body", pa.int64())])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, radius: int = 4) -> DataFrame:
    """One row of docs for each near-duplicate group, columns unchanged: the one whose id names it.

    Of several rows with that id, the one of least fingerprint and text hash stays; so it
    is in a group without any id. Ids, fingerprints and hashes alone are shuffled to
    decide; texts move once, to be met by those that stay.
    """

    def run(batches):
        for b in slices(batches):
            found = np.array([fingerprint(t, size) for t in as_bytes(b.column(1))], np.uint64)
            yield batch(_KEYED, b.column(0), found.view(np.int64), b.column(2))

    text_batches(docs.sparkSession)
    names, doc_id, text = docs.columns, F.col(id_col).cast("long"), F.col(text_col).cast("string")
    keyed = docs.select(doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("body")).mapInArrow(run, "doc_id long, fp long, body long")
    fps = materialise(keyed, "fingerprints")
    least = fps.groupBy("doc_id", "fp").agg(F.min("body").alias("body"))
    named = least.join(_placed(fps, radius), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    one = named.groupBy("root").agg(F.min(F.struct("doc_id", "fp", "body")).alias("k"))
    keys = ["__known", "__id", "__body"]
    one = one.select(F.col("k.doc_id").isNotNull().alias(keys[0]), F.coalesce("k.doc_id", F.lit(0)).alias(keys[1]), F.col("k.body").alias(keys[2]))
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    rows = docs.select(row, doc_id.isNotNull().alias(keys[0]), F.coalesce(doc_id, F.lit(0)).alias(keys[1]), F.xxhash64(text).alias(keys[2]))
    kept = rows.join(one, keys, "left_semi").dropDuplicates(keys)
    return kept.select(*[F.col("row").getField(c).alias(c) for c in names])
