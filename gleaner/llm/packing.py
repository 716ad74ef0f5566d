"""Sum-of-squares packing of tokenised documents into sequences of a fixed length."""

from __future__ import annotations

import functools
import json
import math
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, text_batches

#: The byte-level pre-tokenisation that vocabularies of this kind are made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Chunks whose ids each Python worker remembers at once.
REMEMBERED = 300_000
_SPACED = re.compile(r" \s")


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def _packed(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit bytes."""
    if sys.byteorder == "little":
        return array("I", ids).tobytes()
    return np.array(ids, "<u4").tobytes()


class Encoder(dict):
    """Ids of texts, as little-endian unsigned 32-bit bytes, equal to the tokenizer file's own.

    Text is cut before single spaces, where a token of this kind of vocabulary always
    begins, and the ids of each chunk are remembered. What this can't cut safely (runs of
    white space, special tokens written out) or is outside the Latin letters, whose
    classes all libraries agree on, goes to the tokenizer library whole.
    """

    def __init__(self, path: str):
        import tiktoken

        super().__init__()
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = _byte_letters()
        ranks = {bytes(map(letters.__getitem__, s)): i for s, i in vocab.items() if s not in self.special}
        pair = lambda m: m.replace(" ", "", 1) if isinstance(m, str) else "".join(m)
        if any(vocab[pair(m)] != 256 + i for i, m in enumerate(merges)):
            raise ValueError("ids of this vocabulary aren't in the order of its merges")
        self.fast = tiktoken.Encoding("gleaner", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    @functools.cached_property
    def exact(self):
        """The tokenizer library's own encoder; it takes memory, so it is read when it is needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def whole(self, text: str) -> bytes:
        if text.isascii() or max(text) < "ɐ":
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.exact.encode(text, add_special_tokens=False).ids
        return _packed(ids)

    def __missing__(self, chunk: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        found = self.whole(" " + chunk)
        if len(chunk) < 64:
            self[chunk] = found
        return found

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return _packed(self.exact.encode(text, add_special_tokens=False).ids)
        if text.endswith(" ") or _SPACED.search(text):
            return self.whole(text)
        first, *rest = text.split(" ")
        return (self.whole(first) if first else b"") + b"".join(map(self.__getitem__, rest))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cut(n: int, capacity: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole ones, and before them what is over."""
    return ([n % capacity] if n % capacity else []) + [capacity] * (n // capacity)


_TOKENS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("crcs", pa.list_(pa.int64())), ("ids", pa.binary())])


def tokenise(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, crcs, ids): token counts with the end id, a crc32 for each piece, and the ids if asked for."""
    text_batches(docs.sparkSession)
    tokenizer, end = tokenizer or default_tokenizer(), np.array([end_id], "<u4").tobytes()

    def run(batches):
        encode = encoder(tokenizer).encode
        for b in slices(batches):
            counts, crcs, offsets, ids = [], [], [0], []
            for text in b.column(1).to_pylist():
                data = (encode(text) if text else b"") + end
                counts.append(len(data) // 4)
                at = 0
                for n in cut(len(data) // 4, capacity):
                    crcs.append(zlib.crc32(memoryview(data)[at : (at := at + 4 * n)]))
                offsets.append(len(crcs))
                ids.append(data if with_ids else None)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(crcs, pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), lists, pa.array(ids, pa.binary())], schema=_TOKENS)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, n_tokens long, crcs array<long>, ids binary")


class SumOfSquares:
    """Open bins counted by residual gap; each item goes where the sum of squared counts ends least.

    Taking an open bin of gap g for an item of size s changes the sum by 2 (N[g-s] - N[g] + 1),
    or by 1 - 2 N[s] if it fills the bin. Ties go to the smallest gap. A new bin is opened
    only for what fits in no open one: letting it compete, as the rule for items that
    arrive at random does, leaves bins open that large items never fill again (4 % more
    sequences than tokens need instead of 0.7 %, for items in decreasing order).
    """

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.counts = np.zeros(capacity + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, size: int) -> tuple[int, int]:
        """(bin, offset in it)."""
        top, counts = self.capacity, self.counts
        if size < top:
            held = counts[size:top]
            change = 2 * (counts[: top - size] - held) + 2
            change[0] -= 1
            change[held == 0] = 1 << 60
            j = int(change.argmin())
            if held[j]:
                gap, left = j + size, j
                k = self.bins[gap].pop()
                counts[gap] -= 1
                self._open(left, k)
                return k, top - gap
        k, self.opened = self.opened, self.opened + 1
        self._open(top - size, k)
        return k, 0

    def _open(self, gap: int, k: int) -> None:
        if gap:
            self.counts[gap] += 1
            self.bins[gap].append(k)


_PIECES = pa.schema([(n, pa.int64()) for n in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")])
PIECES = "doc_id long, piece long, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(tokens: DataFrame, capacity: int = 1024, shard_docs: int = 50_000) -> DataFrame:
    """Places the pieces of tokenised documents: one row a piece, with its sequence and offset.

    Documents are dealt by a hash among as many shards as shard_docs gives; a shard's are
    placed one after another by decreasing size of what is over, in one pass that remembers
    open bins only, so that a rerun of a lost task makes the same rows. Sequence ids are
    unique over shards.
    """
    n = tokens.count()
    shards = max(1, math.ceil(n / shard_docs))

    def run(batches):
        from pyspark import TaskContext

        bins, base = SumOfSquares(capacity), TaskContext.get().partitionId() << 40
        for b in batches:
            rows = [[] for _ in _PIECES]
            for doc, count, crcs in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                start = 0
                for piece, (size, crc) in enumerate(zip(cut(count, capacity), crcs, strict=True)):
                    sequence, offset = bins.place(size)
                    for column, value in zip(rows, (doc, piece, start, size, crc, base + sequence, offset), strict=True):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], schema=_PIECES)

    dealt = tokens.select("doc_id", "n_tokens", "crcs").repartition(shards, F.xxhash64("doc_id", "n_tokens", "crcs"))
    over = F.pmod(F.col("n_tokens") - 1, F.lit(capacity))
    return dealt.sortWithinPartitions(over.desc(), "n_tokens", "doc_id", "crcs").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, shard_docs: int = 50_000, **columns) -> DataFrame:
    """Packs every document into sequences of at most ``capacity`` tokens: one row a piece.

    A document is its ids and then end_id; only one longer than capacity is cut, into
    whole pieces and, first, what is over. Null and empty texts are end_id alone; repeated
    rows (and repeated or null ids) are packed each; an empty table gives no rows; other
    columns are not read. Text is tokenised once and only counts and checksums move on.
    """
    return pack(materialise(tokenise(docs, tokenizer, capacity, end_id, **columns).drop("ids"), "tokens"), capacity, shard_docs)


def sequences(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, end_id: int = 2, shard_docs: int = 50_000, **columns) -> DataFrame:
    """The packed sequences themselves: (sequence_id, n_tokens, ids array<long>, doc_ids array<long>).

    Every row is packed as pack_documents() says; ids may be repeated or null.
    """
    tokens = tokenise(docs, tokenizer, capacity, end_id, with_ids=True, **columns).withColumn("row", F.monotonically_increasing_id())
    tokens = materialise(tokens, "tokens")
    placed = pack(tokens.select(F.col("row").alias("doc_id"), "n_tokens", "crcs"), capacity, shard_docs).withColumnRenamed("doc_id", "row")
    parts = placed.join(tokens.select("row", "doc_id", "ids"), "row").select("sequence_id", "offset", "doc_id", F.expr("substring(ids, int(4 * start + 1), int(4 * length))").alias("part"))
    whole = parts.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "doc_id", "part"))).alias("parts"))
    # Each id is four little-endian bytes, eight hex digits.
    joined = F.concat_ws("", F.transform("parts", lambda p: F.hex(p["part"])))
    byte = lambda h, i, k: F.substring(h, i * F.lit(8) + F.lit(1 + 2 * k), F.lit(2))
    ids = F.transform(F.sequence(F.lit(0), (F.length("h") / 8 - 1).cast("int")), lambda i: F.conv(F.concat(*[byte(F.col("h"), i, k) for k in (3, 2, 1, 0)]), 16, 10).cast("long"))
    return whole.withColumn("h", joined).select("sequence_id", (F.length("h") / 8).cast("long").alias("n_tokens"), ids.alias("ids"), F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"))
